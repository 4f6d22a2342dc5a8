"""Joins on pairs: what is worked out once, what is shuffled, and the same pairs as brute force."""

import itertools

from pyspark.sql import functions as F

from panelweave.operators import identity as I
from panelweave.operators import joins as J
from panelweave.operators import linkage as L
from panelweave.operators import pair_records as R
from panelweave.operators import pair_stages as S
from panelweave.operators import similarity_joins as X
from panelweave.operators import verbs as V
from panelweave.plans import registry


def above_join(df):
    """The optimised plan from its result down to the last join."""
    return df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_any_key_pairs_are_not_grouped(spark):
    """Each pair once, ids with several values included, and no aggregation of pairs."""
    left = [(1, "a", 1), (1, "b", 2), (2, "b", None), (3, None, 7), (4, "c", 2)]
    right = [(10, "b", 1), (10, "a", 2), (11, "c", 7), (12, None, None), (13, "b", 2), (13, "b", 2)]
    a, b = spark.createDataFrame(left, "i int, n string, z int"), spark.createDataFrame(right, "j int, n string, z int")
    got = J.any_key_join(a, b, "i", "j", ["n", "z"])
    want = {}
    for (i, n, z), (j, m, y) in itertools.product(left, right):
        agree = {k for k, x, w in (("n", n, m), ("z", z, y)) if x is not None and x == w}
        if agree:
            want.setdefault((i, j), set()).update(agree)
    assert sorted((r.i, r.j, r.agree) for r in got.collect()) == sorted((*k, sorted(v)) for k, v in want.items())
    assert "Aggregate" not in above_join(got)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_best_token_sort_meets_texts_once(spark):
    """Rows that repeat a text make no pairs; ties go to the smallest right id of all."""
    a = spark.createDataFrame([(i, "k", "ab cd" if i % 2 else "xy") for i in range(6)], "id int, k string, a string")
    b = spark.createDataFrame([("k", "cd ab", 9), ("k", "ab cd", 4), ("k", "ab cd", 3), ("k", "qq", 1)], "k string, b string, other int")
    got = J.best_token_sort(a, b, ["k"], "id", "a", "b", "other")
    assert sorted((r.id, r.other, r.b, r.score) for r in got.collect()) == [(i, 3, "ab cd", 100.0) for i in (1, 3, 5)]
    assert plan(got).count("Aggregate") >= 3


def test_levenshtein_join_compares_texts_once(spark):
    rows = [(i, "k" if i < 8 else None, t) for i, t in enumerate(["abc", "abc", "abd", None, "xyz", "abc", "", "xyzzy", "abc"])]
    a, b = spark.createDataFrame(rows, "i int, k string, a string"), spark.createDataFrame(rows, "j int, k string, b string")
    got = J.levenshtein_join(a, b, ["k"], "a", "b", 1)
    near = lambda x, y: x is not None and y is not None and (x == y or {x, y} == {"abc", "abd"})
    want = [(i, j) for i, k, x in rows for j, m, y in rows if k and m and near(x, y)]
    assert sorted((r.i, r.j) for r in got.collect()) == sorted(want) and "Aggregate" in plan(got)
    left = J.levenshtein_join(a, b, ["k"], "a", "b", 1, "left")
    assert {r.i for r in left.filter("j is null").collect()} == {3, 8} and left.count() == len(want) + 2


def test_fuzzy_left_join_compares_texts_once(spark):
    rows = [(0, "k", "ab", "cd"), (1, "k", "ab", "cd"), (2, "k", "ax", "cd"), (3, "k", None, "cd"), (4, None, "ab", "cd"), (5, "k", "zzzz", "cd")]
    a, b = spark.createDataFrame(rows, "i int, k string, f string, l string"), spark.createDataFrame(rows[:4], "j int, k string, f string, l string")
    got = J.fuzzy_left_join(a, b, ["k"], "i", [("f", "f", 1), ("l", "l", 0)], "j")
    want = [(i, j, int(i // 2 != j // 2)) for i in range(3) for j in range(3)] + [(i, None, None) for i in (3, 4, 5)]
    assert sorted(map(str, ((r.i, r.j, r.distance) for r in got.collect()))) == sorted(map(str, want)) and "Aggregate" in plan(got)


def test_second_blocks_make_no_first_pairs(spark):
    """Against all pairs: null keys, ids with several blocks."""
    rows = [(1, "s", 1, "a", "x"), (1, None, 2, "b", "y"), (2, "s", 2, "a", "x"), (2, "t", 1, "b", "y"), (3, "s", 1, "a", "x"), (4, "u", 1, "a", None), (None, "s", 1, "a", "x"), (5, "v", 3, "b", "y"), (5, "v", 3, "a", "x")]
    df = spark.createDataFrame(rows, "id int, st string, ph int, k string, l string")
    blocks = lambda i, at: {(r[at], r[at + 1]) for r in rows if r[0] == i and r[at] is not None and r[at + 1] is not None}
    want = [(i, j, *min(blocks(i, 3) & blocks(j, 3))) for i, j in itertools.combinations(range(1, 6), 2) if blocks(i, 3) & blocks(j, 3) and not blocks(i, 1) & blocks(j, 1)]
    got = S.second_blocks(df, "id", ["st", "ph"], ["k", "l"])
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and "Aggregate" not in above_join(got)


def test_components_broadcast_no_nodes(spark):
    """Joins on nodes are merged, so that no table of nodes passes the driver."""
    c = spark.createDataFrame([(i, i) for i in range(40)], "k int, id int")
    links = c.filter("k % 4 < 2").select(F.col("k").alias("a"), (F.col("k") + 1).alias("b"))
    got = L.relabel_to_max(c, "id", links, "a", "b")
    assert {(r.k, r.id) for r in got.collect()} == {(k, k - k % 4 + 2 if k % 4 <= 2 else k) for k in range(40)}
    assert plan(got).count("strategy=merge") >= 2


def test_text_scalars_of_long_ids(spark, tmp_path):
    """Ids of seven digits: not in the query, as in its SQL, and whole in the other."""
    rows = [(7, "a-b", "x", "Brand#3"), (123456, "c", "c", "b"), (1234567, "d e", "f", "4")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    padded = lambda q: sorted(r.padded for r in registry.queries()[q](spark, str(tmp_path)).collect())
    assert padded("q_text_scalars") == ["000007", "123456"] and padded("q_text_scalars_whole") == ["000007", "123456", "1234567"]


def test_nearest_place_meets_once(spark):
    """Repeated places: the smallest right id stands for one, and every left row has its answer."""
    a = spark.createDataFrame([(i, 10.0, 179.9 if i < 4 else None) for i in range(5)], "i int, y double, x double")
    b = spark.createDataFrame([(9, 10.0, -179.9, "p"), (3, 10.0, -179.9, "q"), (1, 10.0, -179.0, "r"), (0, None, 1.0, "s")], "j int, y2 double, x2 double, t string")
    got = J.nearest_point(a, b, "i", "y", "x", "j", "y2", "x2", 400.0)
    assert sorted((r.i, r.j, r.t) for r in got.collect()) == [(i, 3, "q") for i in range(4)]
    assert "min_by" in plan(got)


def test_part_names_each_pair_once(spark):
    rows = [(1, "a-b"), (2, "B"), (2, "b-c"), (1, "b"), (3, "a"), (3, None), (4, "a--a"), (5, "c")]
    low = [(i, n.lower()) for i, n in rows if n]
    want = {(min(i, j), max(i, j), m) for i, n in low for j, m in low if i != j and "-" in n and m and m in n.split("-")}
    got = I.part_names(spark.createDataFrame(rows, "i int, n string"), "i", "n")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and "Aggregate" not in above_join(got)


def test_natural_join_deals_frequent_keys(spark):
    a = spark.createDataFrame([(None if i % 3 == 0 else i % 3, "n", i) for i in range(9)], "k long, n string, i int")
    b = spark.createDataFrame([(None, "n", 1), (1, "n", 2), (1, "m", 3), (1, None, 4)], "k long, n string, j int")
    got = V.natural_join(a, b)
    assert got.columns == ["k", "n", "i", "j"] and "strategy=merge" in plan(got)
    assert {(r.i, r.j) for r in got.collect()} == {(i, {0: 1, 1: 2, 2: None}[i % 3]) for i in range(9)} and got.count() == 9


def test_tasks_of_pairs_follow_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(J, "TASK_ROWS", 50)
    n = registry.table(spark, sf, "lineitem").count() // 50
    assert "RepartitionByExpression [id1" in plan(registry.queries()["q_cohold_pairs"](spark, sf)) and f", {n}" in plan(registry.queries()["q_cohold_pairs"](spark, sf))


def test_rules_are_one_chain_and_blocks_are_dealt(spark):
    df = spark.createDataFrame([(i, "b") for i in range(30)] + [(99, None), (None, "b")], "i int, b string")
    p = J.block_pairs(df, ["b"], "i", dealt=True).select("id1", "id2")
    assert sorted(tuple(r) for r in p.collect()) == list(itertools.combinations(range(30), 2)) and "strategy=merge" in plan(p)
    got = L.apply_rules(p.withColumn("x", F.when(F.col("id1") > 2, F.col("id1"))), [[("SAME", F.col("x") == 7)], [("DIFFERENT", F.col("x") < 9), ("SAME", F.col("id2") == 29)]])
    for r in got.collect():
        assert (r.label, r.stage) == (("SAME", 1) if r.id1 == 7 else ("DIFFERENT", 2) if 2 < r.id1 < 9 else ("SAME", 2) if r.id2 == 29 else ("UNDECIDED", None))
    assert plan(got).count("= 7)") == 1


def test_block_features_shuffle_no_pair(spark):
    """Blocks of several chunks, null names, values, ids and keys, long names; the same as features of pairs that were made before."""
    rows = [(i if i % 50 else None, "ab"[i % 2] if i % 31 else None, None if i % 41 == 0 else f"f{i % 5}", None if i % 37 == 0 else f"Name {i * 7919 % 1000}" * (9 if i % 29 == 0 else 1), [None, "x", "yz"][i % 3]) for i in range(620)]
    df = spark.createDataFrame(rows + [(7, "b", "f2", "a", "q")], "id long, k string, first string, last string, p string")
    got = L.block_features(df, ["k"], "id", "first", "last", ["k", "p"])
    want = L.pair_features(J.block_pairs(df, ["k"], "id").select("id1", "id2"), df, "id", "first", "last", ["k", "p"])
    names = ["id1", "id2", "first_lev", "last_lev", "first_jw", "last_jw", "shared_k", "shared_p", "total_shared", "nickname"]
    rows = sorted(map(str, got.select(names).collect()))
    assert rows == sorted(map(str, want.select(names).collect())) and len(rows) > 80_000
    tree = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in tree.split("MapInArrow")[0]


def test_record_features_are_made_where_pairs_are(spark):
    """Ids with several blocks, without records of a year, title, state or name; what a pair is told by hand; no shuffle of pairs."""
    schema = "id long, year int, first string, last string, old_first string, old_last string, title string, name string, entity string, system string, address string, zip string, state int, gender string, kind string, block string"
    rec = lambda i, year, first, last, title, state, block: (i, year, first, last, first, last, title, *["v"] * 5, state, "F", "k", block)
    rows = [
        rec(1, 1, "maria", "lee", "x", 5, "b"), rec(1, 2, "maria", "lee", "y", 6, "c"), rec(1, 2, "maria", "lee", "x", 6, "c"), rec(2, 2, "mari", "lea", "z", 7, "b"), rec(2, 2, "mari", "lea", "y", 7, "c"),
        rec(3, 4, "maria", "lee", "z", 5, "b"), rec(4, None, None, "q", "x", None, "b"), rec(None, 1, "a", "b", "x", 5, "b"), rec(5, 1, "m", None, None, None, "c"), rec(6, 2, "m", None, "x", 1, None), rec(2, 3, "mari", "lea", "x", None, "b"),
    ]
    r = spark.createDataFrame(rows, schema)
    tables = spark.createDataFrame([("maria", "mari")], "name1 string, name2 string"), spark.createDataFrame([("maria", "mr"), ("mari", "mr")], "name string, code string"), spark.createDataFrame([(6, 7, 100.5), (7, 6, 100.5)], "a int, b int, miles double")
    got = R.block_record_features(r, "block", *tables, ["x"], ["y"])
    rows = {(x.id1, x.id2): x for x in got.collect()}
    assert got.count() == len(rows) and set(rows) == {(1, 2), (1, 3), (1, 4), (1, 5), (2, 3), (2, 4), (2, 5), (3, 4)}
    a, b = rows[1, 2], rows[1, 3]
    # In year 2 titles x, y meet y, z: y goes with x in one of its four rows, z with y in one of two.
    assert (a.nick, a.same_code, a.apart_years, a.miles, a.overlap, a.first_lev, a.last_lev, a.p_diff) == (True, True, 1, 100.5, 1, 1, 1, None) and a.p_same == 0.25
    assert (b.nick, b.apart_years, b.miles, b.overlap, b.p_same) == (False, 0, 0.0, 0, None)
    assert rows[1, 4].first_lev is None and rows[1, 4].p_same is None and rows[1, 4].p_diff is None
    pairs = spark.createDataFrame(list(rows), "id1 long, id2 long")
    assert sorted(map(str, R.record_features(pairs, r, *tables, ["x"], ["y"]).collect())) == sorted(map(str, rows.values()))
    assert "Aggregate" not in above_join(got) and got._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0].count("Exchange") == 0


def test_resolution_carries_no_features(spark, monkeypatch):
    """What a pass keeps of a pair is two ids, bits, a label and a stage, and features that go with counts of pairs; labels as told rule by rule."""
    kept = []
    monkeypatch.setattr(R, "durable", lambda df: kept.append(df.columns) or df.localCheckpoint())
    stages = {1: [("SAME", "x = 1"), ("DIFFERENT", "x = 2 and y > 0")], 2: [("DIFFERENT", "y < 0 and not linked1 and not linked2"), ("SAME", "y = 5 and (linked1 or linked2)")], 3: [("SAME", "linked1 and pairs1 >= z")]}
    rows = [(1, 2, 1, 0, 9, 0), (1, 3, 0, 5, 9, 0), (4, 5, 0, 5, 9, 0), (6, 7, 0, -1, 9, 0), (6, 8, None, None, 9, 0), (1, 9, 0, -1, 1, 0), (10, 11, 2, 1, 0, 0)]
    f = spark.createDataFrame(rows, "id1 long, id2 long, x int, y int, z int, unread int")
    got = {(r.id1, r.id2): (r.label, r.stage) for r in R.resolve_in_stages(f, (1, 2, 3), stages).collect()}
    assert got == {(1, 2): ("SAME", 1), (1, 3): ("SAME", 2), (4, 5): ("UNDECIDED", None), (6, 7): ("DIFFERENT", 2), (6, 8): ("UNDECIDED", None), (1, 9): ("SAME", 3), (10, 11): ("DIFFERENT", 1)}
    assert all(set(c) <= {"id1", "id2", "_held0", "z", "label", "stage"} for c in kept)


def test_quantiles_use_one_sketch(spark):
    """A sketch that each branch of the plan works out anew may differ between them; the value is that of the sorted column."""
    df = spark.range(0, 20_001, 1, 24).select((F.col("id") * 7919 % 20_001).cast("double").alias("v"))
    got = V.exact_quantiles(df, [], "v", [0.5, 0.25])
    assert "percentile" not in plan(got) and got.first().q == [10_000.0, 5_000.0]


def test_similar_texts_shuffle_no_candidates(spark):
    """Several chunks of each side; texts that meet are compared where they meet."""
    word = lambda i: "".join("abcdefgh"[i // 8**k % 8] for k in range(5))
    a, b = spark.createDataFrame([(word(i * 7),) for i in range(1500)], "a string"), spark.createDataFrame([(word(i * 11),) for i in range(1200)], "b string")
    got = X.similar_texts(a, b, "a", "b", 0.95, weight=0.0)
    assert {(r._a, r._b) for r in got.collect()} == {(word(i),) * 2 for i in {i * 7 for i in range(1500)} & {i * 11 for i in range(1200)}}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]


def test_aligned_join_spreads_frequent_values(spark):
    """Texts that met are worked out once, and a frequent pair of values makes its rows in several tasks; ids without a value and repeated rows count as before."""
    rows = [(i, "ab", "cd") for i in range(700)] + [(i, "zz", "cd") for i in range(700, 900)] + [(900, "ba", "cxd"), (901, None, "cd"), (902, "ab", None), (900, "ba", "cxd"), (None, "ab", "cdd"), (903, "", "c")]
    a = spark.createDataFrame(rows, "i int, f string, l string").repartition(1)
    b = a.toDF("j", "g", "m")
    got = X.aligned_join(a, b, "i", "j", ["f", "l"], ["g", "m"], 1)
    assert plan(got).count("ArrowEvalPython") == 2
    found = got.withColumn("p", F.spark_partition_id()).collect()
    n = {(x, y): sum(1 for r in found if (r.distance0, r.distance1) == (x, y)) for x, y in {(r.distance0, r.distance1) for r in found}}
    # (0, 0): both groups with themselves, the repeated row four times, two single rows; (1, 1): swapped and a letter more, with the group and with the row without an id.
    assert n == {(0, 0): 700 * 700 + 200 * 200 + 4 + 1 + 1, (0, 1): 2 * 700, (1, 1): 2 * 2 * 700 + 4}
    assert len({r.p for r in found if r.i is not None and r.i < 700 and r.j is not None and r.j < 700}) > 3


def test_rule_chain_is_compiled_apart(spark, sf):
    """The chain of rules isn't fused into one method too large to be compiled, and fractions are no decimals."""
    got = registry.queries()["q_pair_stages"](spark, sf)
    tree = got._jdf.queryExecution().executedPlan().toString()
    chain = [line for line in tree.splitlines() if "CASE WHEN coalesce(" in line]
    assert chain and not any("*(" in line for line in chain) and "decimal" not in tree
    labels = L.apply_rules(spark.createDataFrame([(None, 1), (2, None), (3, 3)], "x int, y int"), [[("SAME", F.col("x") == 3)], [("DIFFERENT", F.col("y") == 1)]])
    assert {(r.x, r.label, r.stage) for r in labels.collect()} == {(None, "DIFFERENT", 2), (2, "UNDECIDED", None), (3, "SAME", 1)}


def test_second_pass_leaves_no_pair_out(spark, tmp_path):
    """Ids of one name and title meet whatever their remainders; chunks of a block meet too, each pair once."""
    rows = [(4 * i, "red bolt" if i < 3 else "old ring", "LARGE", f"Brand#{i}", i) for i in range(5)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = registry.queries()["q_second_pass"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1, "redLARGE", "bolt"), (0, 2, "redLARGE", "bolt"), (1, 2, "redLARGE", "bolt"), (3, 4, "oldLARGE", "ring")]
    many = spark.range(2500).selectExpr("id", "id % 7 as s", "'k' as k", "id % 2 as l")
    found = S.second_blocks(many, "id", ["s"], ["k", "l"])
    want = sum(1 for i in range(2500) for j in range(i + 2, 2500, 2) if (j - i) % 7)
    assert found.count() == want == found.distinct().count() and found.filter("id1 >= id2 or id1 % 2 <> id2 % 2 or l <> id1 % 2 or id1 % 7 = id2 % 7").count() == 0


def test_decided_pairs_are_written_once(spark, monkeypatch):
    """A pass writes the pairs that it judged and no others; conditions are compiled apart from what makes the features."""
    kept = []
    monkeypatch.setattr(R, "durable", lambda df: kept.append((df.localCheckpoint(), plan(df))) or kept[-1][0])
    stages = {1: [("SAME", "x = 1"), ("DIFFERENT", "x = 2")], 2: [("DIFFERENT", "x = 3 and not linked1")], 3: [("SAME", "linked1 and x > 3")]}
    f = spark.createDataFrame([(10 * k, 10 * k + 1, k) for k in range(6)], "id1 long, id2 long, x int")
    got = {r.id1: (r.label, r.stage) for r in R.resolve_in_stages(f, (1, 2, 3), stages).collect()}
    assert got == {0: ("UNDECIDED", None), 10: ("SAME", 1), 20: ("DIFFERENT", 1), 30: ("DIFFERENT", 2), 40: ("UNDECIDED", None), 50: ("UNDECIDED", None)}
    assert [t.count() for t, _ in kept] == [6, 4, 3] and all("aggregate(" in p for _, p in kept)


def test_record_features_compare_chunks(spark):
    """Chunks of one block and several blocks of an id, each pair once, the same as of pairs that were made before; no row of an id is made for a pair."""
    schema = "id long, year int, first string, last string, old_first string, old_last string, title string, name string, entity string, system string, address string, zip string, state int, gender string, kind string, block string"
    word = lambda n: "".join("aeiorst"[n // 7**k % 7] for k in range(4))
    rows = []
    for n in range(1300):
        i, first, last = n * 37 % 1000, word(n * 37 % 1000 % 40), word(n * 37 % 1000 % 300)
        rows.append((i, n % 5 or None, first if i % 17 else None, last, first, last if i % 19 else "x" + last, "xyzw"[n % 4] if n % 13 else None, f"n{n % 7}", None, "s", f"a{i % 200}", f"z{n % 3}", n % 6 if n % 11 else None, "FM"[n % 2] if n % 3 else None, "kl"[i % 2], f"b{n % 2}" if n % 29 else None))
    r = spark.createDataFrame(rows, schema)
    names = spark.createDataFrame([(word(k), word(k + 1)) for k in range(0, 40, 3)], "name1 string, name2 string")
    tables = names, names.toDF("name", "code"), spark.createDataFrame([(a, b, 100.25 * a + b) for a in range(6) for b in range(6) if a != b], "a int, b int, miles double")
    got = R.block_record_features(r, "block", *tables, ["x"], ["y"])
    tree = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in tree and "ArrowEvalPython" not in tree.split("SortMergeJoin")[0]
    by_id = {}
    for x in rows:
        by_id.setdefault(x[0], set()).update([x[-1]] if x[-1] else [])
    few = sorted(i for i in by_id if i % 9 == 0)
    want = [(i, j) for i, j in itertools.combinations(few, 2) if by_id[i] & by_id[j]]
    near = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in x]) for x in df.collect())
    found = got.filter("id1 % 9 = 0 and id2 % 9 = 0")
    assert near(found) == near(R.record_features(spark.createDataFrame(want, "id1 long, id2 long"), r, *tables, ["x"], ["y"]))
    assert got.count() == sum(1 for i, j in itertools.combinations(by_id, 2) if by_id[i] & by_id[j])


def test_any_key_pairs_are_made_as_lists(spark):
    """Several chunks of a value; a pair is no row of a join; ids with several values, one text of what agrees."""
    a = spark.range(1500).selectExpr("id as i", "id % 3 as n", "if(id % 5 = 0, null, id % 40) as z").union(spark.range(30).selectExpr("id", "7 as n", "id as z"))
    b = spark.range(2300).selectExpr("id as j", "if(id % 7 = 0, null, id % 4) as n", "id % 50 as z").union(spark.range(20).selectExpr("id", "7 as n", "1 as z"))
    got = J.any_key_join(a, b, "i", "j", ["n", "z"], ";")
    tree = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(_qs" in tree and "_rows1" in tree.split("MapInArrow")[1]
    pairs = None
    for k in ("n", "z"):
        p = a.select("i", k).join(b.select("j", k), k).select("i", "j", F.lit(k).alias("k")).distinct()
        pairs = p if pairs is None else pairs.union(p)
    want = pairs.groupBy("i", "j").agg(F.array_join(F.array_sort(F.collect_list("k")), ";").alias("agree"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 700_000


def test_a_block_is_compared_in_several_tasks(spark):
    """Chunks of one large block are dealt into tasks; edit distances of texts that begin alike."""
    df = spark.range(1700).selectExpr("id", "'b' as k", "'f' as first", "concat('Name#0000', id % 90) as last", "'s' as p")
    got = L.block_features(df, ["k"], "id", "first", "last", ["p"]).withColumn("t", F.spark_partition_id())
    assert got.count() == 1700 * 1699 // 2 and got.select("t").distinct().count() > 1
    assert got.filter(F.col("last_lev") != F.levenshtein(F.concat(F.lit("Name#0000"), F.col("id1") % 90), F.concat(F.lit("Name#0000"), F.col("id2") % 90))).count() == 0
