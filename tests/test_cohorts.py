from pyspark.sql import functions as F

from panelweave.operators import cohorts as C


def test_state_changes(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, "a"), (2, 1, None)], "k long, t int, s string")
    rows = {(r.k, r.t): (r.changed, r.n_changes, r.last_of_state) for r in C.state_changes(df, ["k"], "t", "s").collect()}
    assert rows == {(1, 1): (False, 0, 4), (1, 2): (False, 0, 4), (1, 3): (True, 1, 3), (1, 4): (True, 2, 4), (2, 1): (False, 0, 1)}


def test_cohort_membership(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (3, None)], "p long, s string")
    rows = {r.p: (r.ever, r.only, r.n) for r in C.cohort_membership(df, "p", F.col("s") == "x").collect()}
    assert rows == {1: (True, False, 2), 2: (True, True, 1), 3: (False, False, 1)}


def test_period_median_split(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (None, 5), (2, None)], "t int, v int")
    rows = sorted(C.period_median_split(df, "t", "v").collect(), key=str)
    assert [(r.t, r.v, r.above) for r in rows] == [(1, 1, False), (1, 2, False), (1, 3, True), (2, None, None), (None, 5, False)]


def test_pair_rates_and_empty(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 1, "b"), (1, 2, "a"), (1, 3, None)], "y int, e int, i string")
    (r,) = C.pair_rates(df, ["e"], "i", ["y"]).collect()
    assert (r.item1, r.item2, r.n_both, r.n_entities, round(r.rate, 4)) == ("a", "b", 1, 3, 0.3333)
    assert C.pair_rates(df.limit(0), ["e"], "i", ["y"]).collect() == []


def test_widest_pair(spark):
    df = spark.createDataFrame([(1, "abc"), (1, "abd"), (1, "xyz"), (2, "q"), (3, None)], "k int, v string")
    assert {r.k: r.widest for r in C.widest_pair(df, ["k"], "v").collect()} == {1: 3, 2: 0, 3: None}


def test_precedence_joint_and_means(spark):
    df = spark.createDataFrame([(1, 1, 1, 2.0), (1, 0, None, 4.0), (2, 0, 0, None)], "k int, a int, b int, v double")
    rules = [("unknown", F.col("b").isNull(), F.lit(None).cast("int")), ("both", (F.col("a") == 1) & (F.col("b") == 1), F.lit(1))]
    rows = df.select(C.precedence(rules).alias("o"), C.joint_outcome(F.col("a"), F.col("b")).alias("j")).collect()
    assert [(r.o.value, r.o.reason, r.j) for r in rows] == [(1, "both", "joint"), (None, "unknown", "missing"), (None, None, "neither")]
    means = {r.k: (r["mean"], r.se, r.n, r.n_entities) for r in C.conditional_means(df, ["k"], "a", F.lit(True), "v").collect()}
    assert means == {1: (3.0, 1.0, 2, 2), 2: (None, None, 0, 0)}
