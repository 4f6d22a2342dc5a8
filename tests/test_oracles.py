"""Every registered query against its SQL, value by value, and estimators and scores against brute force."""

import decimal
import itertools
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.functions import text as T
from panelweave.operators import estimation as E
from panelweave.operators import identity as I
from panelweave.operators import joins as J
from panelweave.operators import panel as P
from panelweave.operators import verbs as V
from panelweave.plans import registry


def plain(v):
    if v is None or isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return str(round(float(v), 4) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def con(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{sf}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf, con, name):
    got, want = registry.queries()[name](spark, sf), con.sql(registry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_quantiles_of_hot_and_tied_groups(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in rng.normal(size=3000)] + [("tied", 5.0)] * 500 + [("tied", 7.0)] + [("one", 2.0), ("none", None), (None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.q for r in V.exact_quantiles(df, ["k"], "v", [0.0, 0.05, 0.5, 0.95, 1.0]).collect()}
    for k in ("hot", "tied", "one", None):
        want = np.quantile([v for g, v in rows if g == k], [0.0, 0.05, 0.5, 0.95, 1.0])
        assert np.allclose(got[k], want, atol=1e-12), k
    assert "none" not in got
    assert V.exact_quantiles(df.limit(0), [], "v", [0.5]).count() == 0


def test_codes_are_alphabetical(spark):
    values = [f"v{i:05d}" for i in np.random.default_rng(2).permutation(2000)]
    got = V.codes(spark.createDataFrame([(v,) for v in [*values, None, values[0]]], "v string"), "v", "c").collect()
    order = {v: i for i, v in enumerate(sorted(values), 1)}
    assert all(r.c == order.get(r.v) for r in got) and len(got) == 2002


def test_token_sort_brute_force(spark):
    def common(a, b):
        best = 0
        for n in range(len(a) + 1):
            for part in itertools.combinations(a, n):
                it = iter(b)
                if all(x in it for x in part):
                    best = max(best, n)
        return best

    pairs = [("ba cd", "dc ab"), ("x y", "y x"), ("abc", "acb"), ("a", ""), ("one", "eno"), ("ab cd ef", "ef ab cd")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.token_sort_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in got:
        x, y = (" ".join(sorted(t.split())) for t in (r.a, r.b))
        assert abs(r.r - (200.0 * common(x, y) / (len(x) + len(y)) if x or y else 100.0)) < 1e-9
    a, b = spark.createDataFrame([(1, "k", "main st"), (2, "k", None), (3, None, "x")], "id int, k string, a string"), spark.createDataFrame([("k", "st main", 9), ("k", "other", 8), ("k", None, 7)], "k string, b string, other int")
    assert [(r.id, r.other, r.score) for r in J.best_token_sort(a, b, ["k"], "id", "a", "b", "other").collect()] == [(1, 9, 100.0)]


def test_event_study_by_group(spark):
    """Two groups with effects of their own are both recovered in one regression; cohorts that differ add to the variance."""
    data = []
    for u in range(60):
        cohort = {0: 4, 1: 6}.get(u % 3)
        group = None if cohort is None else "ab"[u // 3 % 2]
        for t in range(10):
            effect = {"a": 2.0, "b": 5.0}.get(group, 0.0) if cohort is not None and t >= cohort else 0.0
            data.append((u, t, cohort, group, u * 0.3 + t * 0.5 + effect))
    df = spark.createDataFrame(data, "u int, t int, c int, g string, y double")
    fit = E.event_study(df, "u", "t", "c", "y", 2, split="g")
    effects = dict(zip(fit.names, fit.b))
    for g, size in (("a", 2.0), ("b", 5.0)):
        assert all(abs(effects[f"{g}:t{k}"] - (size if k >= 0 else 0.0)) < 1e-6 for k in (-2, 0, 1, 2))
    # Without noise all variance is that of the shares: cohorts with effects 1 and 3, each half of the treated.
    mixed = [(u, t, c, g, u + t + (0.0 if c is None or t < c else 1.0 if c == 4 else 3.0)) for u, t, c, g, _ in data]
    fit = E.event_study(spark.createDataFrame(mixed, "u int, t int, c int, g string, y double"), "u", "t", "c", "y", 2)
    se = dict(zip(fit.names, fit.se))
    n = len({u for u, _, c, _, _ in data if c is not None})
    assert abs(dict(zip(fit.names, fit.b))["t0"] - 2.0) < 1e-6 and abs(se["t0"] - 1.0 / np.sqrt(n)) < 1e-6


def test_names_within_edits_are_all_found(spark):
    """Pieces lose no pair: against all pairs of random words."""
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abc"), rng.integers(0, 9))) for _ in range(120)})

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    left = spark.createDataFrame([(w, w, "k") for w in words] + [(None, None, "k")], "i string, f string, l string")
    got = {(r.i, r.j) for r in I.two_column_join(left, left.withColumnRenamed("i", "j"), "i", "j", ["f", "l"], ["f", "l"]).collect()}
    assert got == {(a, b) for a in words for b in words if edits(a, b) <= 2}
    codes = spark.createDataFrame([(w, 99) for w in words], "code string, n int")
    near = {(r.a, r.b) for r in I.code_edges(codes, "code", "n", spark.createDataFrame([], "a string, b string, similarity double")).collect()}
    assert near == {(min(a, b), max(a, b)) for a in words for b in words if a != b and len(a) > 6 and len(b) > 3 and edits(a, b) <= 2}


def test_blocks_are_split_by_a_further_key(spark):
    df = spark.createDataFrame([(i, "big", i % 2) for i in range(10)] + [(20, "s", 0), (21, "s", 1), (None, "s", 1)], "i int, b string, c int")
    assert J.block_pairs(df, ["b"], "i", largest=5, then=["c"]).count() == 2 * 10 + 1
    with pytest.raises(ValueError):
        J.block_pairs(df, ["b"], "i", largest=5)
    assert {(r.b, r.ids, r.pairs) for r in J.block_sizes(df, ["b"], "i").collect()} == {("big", 10, 45), ("s", 2, 1)}


def test_values_before_and_grid(spark):
    df = spark.createDataFrame([("k", 1, "b"), ("k", 2, "a"), ("k", 3, "b"), ("k", 4, None), ("k", 5, "c")], "k string, t int, v string")
    assert [r.x for r in P.values_before(df, ["k"], "t", "v", "x").orderBy("t").collect()] == [[], ["b"], ["a", "b"], ["a", "b"], ["a", "b"]]
    assert P.expand_grid(df, ["t", "v"]).count() == 5 * 4


def test_jdbc_source(spark):
    """An in-memory database of the driver's JVM, where its driver comes with Spark."""
    from panelweave.sources import files

    url = "jdbc:derby:memory:panel;create=true"
    try:
        spark.createDataFrame([(i, f"n{i}") for i in range(20)], "K int, NAME string").write.jdbc(url, "PEOPLE", mode="overwrite", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    except Exception as e:  # noqa: BLE001
        if "ClassNotFound" not in str(e):
            raise
        pytest.skip("no database driver")
    got = files.jdbc(spark, url, "PEOPLE", key="K", bounds=(0, 20), parts=4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert got.rdd.getNumPartitions() == 4 and sorted(r.K for r in got.collect()) == list(range(20))


def test_keyword_hits_edges(spark):
    """Short and long phrases, words across a boundary, null, empty and repeated rows."""
    texts = [(1, "The quick, brown fox jumps"), (1, "over it"), (2, "quick brownish fox"), (3, ""), (4, None), (None, "a quick brown fox"), (5, "fox"), (6, "fox fox fox fox quick")]
    phrases = [(10, "quick brown FOX"), (11, "Fox"), (12, "over it"), (13, "quick brown fox jumps"), (14, "fox fox fox fox"), (15, "..."), (16, None), (17, "quick brown"), (18, "fox fox fox fox fox")]
    docs = spark.createDataFrame(texts, "d long, t string")
    got = {tuple(r) for r in J.keyword_hits(docs, spark.createDataFrame(phrases, "k long, p string"), "d", "t", "k", "p").collect()}
    words = lambda v: " " + " ".join(re.findall(r"\w+", (v or "").lower())) + " "
    assert got == {(d, k) for d, t in texts for k, p in phrases if words(p).strip() and words(p) in words(t)}
    assert J.keyword_hits(docs, spark.createDataFrame([], "k long, p string"), "d", "t", "k", "p").count() == 0
