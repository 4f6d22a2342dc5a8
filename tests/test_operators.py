"""Hand-made cases for the operators that SQL oracles don't reach, and their edge rules."""

import math
import os

import pytest
from pyspark.sql import functions as F

from panelweave.functions import text as T
from panelweave.functions.double_metaphone import double_metaphone
from panelweave.operators import estimation as E
from panelweave.operators import joins as J
from panelweave.operators import linkage as L
from panelweave.operators import panel as P
from panelweave.operators import verbs as V
from panelweave.plans import registry
from panelweave.sources import files


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_text(spark):
    df = spark.createDataFrame([("North First Street-12", "Smith, Jr", "dr. John (Jack) Q. Doe, MD, Chief", "12345-6789", "00012", "Ñandú")], "a string, b string, c string, z string, i string, n string")
    got = df.select(T.standard_address(F.col("a")), T.drop_suffixes(F.col("b")), T.person_parts(F.col("c")), T.nickname(F.col("c")), T.zip5(F.col("z")), T.strip_zeros(F.col("i")), T.ascii_fold(F.col("n")), T.to_number(F.col("a"))).first()
    assert got[0] == "n 1st st 12" and got[1] == "Smith" and got[3] == "Jack" and got[4:] == ("12345", "12", "Nandu", None)
    assert got[2].last == "Doe" and got[2].title == "MD, Chief"
    assert T.jaro("", "") == 1.0 and T.jaro("a", "") == 0.0 and abs(T.jaro("martha", "marhta") - 0.944444) < 1e-5
    assert double_metaphone("Knight") == double_metaphone("Night") and double_metaphone("Philip") == double_metaphone("Filip")


def test_checked_join(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (None, "n")], "k int, a string"), spark.createDataFrame([(1, "p"), (3, "q"), (None, "m")], "k int, b string")
    assert sorted(r["_merge"] for r in V.checked_join(a, b, ["k"]).collect()) == [1, 1, 2, 2, 3]
    assert sorted(r["_merge"] for r in V.checked_join(a, b, ["k"], null_safe=True).collect()) == [1, 2, 3, 3]
    with pytest.raises(V.CheckFailed):
        V.checked_join(a, b.union(b), ["k"], "1:1")
    with pytest.raises(V.CheckFailed):
        V.checked_join(a, b, ["k"], check=[3])


def test_panel(spark):
    df = spark.createDataFrame([("e", 1, "a"), ("e", 2, None), ("e", 3, "a"), ("e", 5, "b"), ("f", 1, None)], "k string, t int, v string")
    assert [r.g for r in P.guarded_lag(df, ["k"], "t", "v", "g").orderBy("k", "t").collect()] == [None, "a", None, None, None]
    assert [r.g for r in P.fill(df, ["k"], "t", "v", "g").orderBy("k", "t").collect()] == ["a", "a", "a", "b", None]
    assert rows(P.gap_periods(df, ["k"], "t")) == [("e", 4)] and rows(P.longest_run(df, ["k"], "t")) == [("e", 3), ("f", 1)]
    assert P.densify(df, ["k"], "t").count() == 6


def test_components(spark):
    edges = [(i, i + 1) for i in range(10)] + [(20, 21), (21, 22), (22, 20), (30, 30), (20, 21), (None, 5)]
    got = {r.node: (r.component, r.component_max, r["size"]) for r in L.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got[10] == (0, 10, 11) and got[21] == (20, 22, 3) and got[30] == (30, 30, 1)


def test_polygon_and_distance(spark):
    square = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)]
    polys = spark.createDataFrame([("s", [{"x": x, "y": y} for x, y in square])], "id string, ring array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 1.0), (3, None, 1.0)], "p int, x double, y double")
    assert [r.p for r in J.polygon_join(pts, polys, "x", "y", "ring", 0.7).collect()] == [1]
    a = spark.createDataFrame([(1, 0.0, 179.99), (2, 89.9, 10.0), (3, None, None)], "id int, lat double, lon double")
    b = spark.createDataFrame([(7, 0.0, -179.99), (8, 89.9, -170.0)], "other int, lat2 double, lon2 double")
    got = {r.id: r.other for r in J.nearest_point(a, b, "id", "lat", "lon", "other", "lat2", "lon2", 30.0).collect()}
    assert got == {1: 7, 2: 8}


def test_event_study_recovers_constant_effect(spark):
    data = []
    for u in range(40):
        cohort = {0: 4, 1: 6}.get(u % 4)
        for t in range(10):
            data.append((u, t, cohort, u * 0.3 + t * 0.5 + (2.0 if cohort is not None and t >= cohort else 0.0)))
    fit = E.event_study(spark.createDataFrame(data, "u int, t int, c int, y double"), "u", "t", "c", "y", 3)
    effects = dict(zip(fit.names, fit.b))
    assert all(abs(effects[f"t{k}"] - (2.0 if k >= 0 else 0.0)) < 1e-6 for k in (-3, -2, 0, 1, 2))
    mean, _ = E.combine(fit, {"t0": 0.5, "t1": 0.5})
    assert math.isclose(mean, 2.0, abs_tol=1e-6)


def test_sources(spark, tmp_path):
    (tmp_path / "x2001.csv").write_text("A,B b\n1,2\n")
    (tmp_path / "x2003.csv").write_text("a,c\n5,6\n")
    (tmp_path / "names.csv").write_text("Bob,Robert,NA\nann\n")
    got = files.yearly_csv(spark, str(tmp_path), "x", range(2000, 2005))
    assert got.columns == ["a", "b_b", "year", "c"] and got.count() == 2
    lists = files.ragged_csv(spark, str(tmp_path / "names.csv"))
    assert rows(files.equivalent_pairs(lists)) == [("bob", "robert"), ("robert", "bob")]
    assert "\\begin{tabular}" in files.latex_table(got) and files.sheet_name("a/b" * 20)[:3] == "a b"


def test_stream_equals_batch(spark, sf, tmp_path):
    from panelweave.streaming.counts import windowed_counts

    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    q = windowed_counts(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").count() == windowed_counts(batch).count()


def test_queries_match_oracles(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{sf}/{t}'")
    for name, f in registry.queries().items():
        got = f(spark, sf)
        n = got.count()
        if name in registry.oracle_sql():
            want = con.sql(registry.oracle_sql()[name])
            assert sorted(got.columns) == sorted(want.columns), name
            assert n == len(want.fetchall()), name


@pytest.mark.parametrize("name", ["q_any_key_join_whole", "q_keyword_hits_whole", "q_checked_join_audit_whole", "q_unpivot_whole"])
def test_whole_table_queries(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("supplier", "customer", "benchmark", "documents", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = registry.queries()[name](spark, sf), con.execute(registry.oracle_sql()[name]).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and want


def test_whole_components(spark, sf):
    edges = {(r.l_suppkey, 1000000 + r.l_partkey) for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for node in near:
        if node not in want:
            found, todo = {node}, [node]
            while todo:
                new = near[todo.pop()] - found
                found |= new
                todo += new
            want |= {x: (min(found), max(found), len(found)) for x in found}
    got = {r.node: (r.component, r.component_max, r["size"]) for r in registry.queries()["q_components_whole"](spark, sf).collect()}
    assert got == want


def test_components_with_hub(spark):
    """A star with thousands of leaves, a long chain and isolated pairs, against union of sets; hubs are dealt out."""
    from panelweave.operators import graphs

    rows_ = [(5000, i) for i in range(1000, 4000)] + [(i, i + 1) for i in range(6000, 6300)] + [(9000 + 2 * i, 9001 + 2 * i) for i in range(50)] + [(1000, 6100), (None, 1), (3, 3)]
    got = {r.node: r.component for r in graphs.star_components(spark.createDataFrame(rows_, "a long, b long"), "a", "b").collect()}
    assert got[5000] == 1000 and got[3999] == 1000 and got[6300] == 1000 and got[9003] == 9002 and got[3] == 3 and len(got) == 3001 + 301 + 100 + 1
    assert graphs.star_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
