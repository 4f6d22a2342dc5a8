"""Blocks of names from their graphs, rare names, shape files: brute force in plain Python and odd rows."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelweave.functions.double_metaphone import double_metaphone
from panelweave.operators import name_graphs as N
from panelweave.plans import graph_queries as G
from panelweave.plans import registry
from panelweave.sources import shapes


def test_blocks_by_sound(spark, sf):
    rows, names = G.first_names(spark, sf)
    kinds, dictionary = {(r.name, r.kind) for r in names.collect()}, defaultdict(set)
    for r in rows.collect():
        dictionary[r.row].add(r.name)
    want = {}
    for kind in ("F", "M"):
        code = {n: double_metaphone(n)[0] for n, k in kinds if k == kind}
        component = {c: c for c in code.values()}
        changed = True
        while changed:
            changed = False
            for held in dictionary.values():
                codes = [code[n] for n in held if n in code]
                least = min((component[c] for c in codes), default=None)
                for c in codes:
                    changed |= component[c] != least
                    component[c] = least
        sizes = defaultdict(int)
        for c in component.values():
            sizes[c] += 1
        giant = min(sizes, key=lambda c: (-sizes[c], c))
        part = {c: f"l:{c[:1].upper()}" if component[c] == giant else f"c:{component[c]}" for c in component}
        least = {p: min(c for c in part if part[c] == p) for p in part.values()}
        numbers = {p: i for i, (_, p) in enumerate(sorted((c, p) for p, c in least.items()))}
        shift = 0 if kind == "F" else 1 + max(b for *_, b in want.values())
        want |= {(n, kind): (c, part[c], numbers[part[c]] + shift) for n, c in code.items()}
    got = {(r.name, r.kind): (r.code, r.part, r.block) for r in registry.queries()["q_name_blocks_by_sound"](spark, sf).collect()}
    assert got == want


def test_name_graph_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "unused"), (2, "b"), (2, "c"), (2, "b"), (None, "a"), (None, "d"), (3, None), (3, ""), (4, "d")], "row int, name string")
    names = spark.createDataFrame([(x,) for x in ("a", "b", "c", "d", "d", "", None)], "name string")
    assert {tuple(r) for r in N.name_graph(names, rows).collect()} == {("a", "b"), ("b", "c")}
    empty = N.name_blocks(names.limit(0).withColumn("kind", F.lit("F")), rows, names.selectExpr("name", "name as code"))
    assert empty.count() == 0 and empty.columns == ["name", "kind", "code", "part", "block"]


def test_rare_names_by_pattern(spark):
    """The same frequencies are rare enough for a name of one state, not for one of many."""
    rows = []
    for k in range(40):  # first names from 2 to 22 ids, two ids each name
        first = f"f{int(k ** 0.5)}"
        rows += [(2 * k, first, f"l{k}", "x", 2000), (2 * k + 1, first, f"l{k}", "x", 2001)]
    rows += [(900, "f3", "one", "x", 2000), (901, "f3", "one", "x", 2003), (901, "f3", "one", "x", 2003), (902, "f3", "year", "x", 2000), (903, "f3", "year", "y", 2001), (904, "f3", "many", "x", 2000), (905, "f3", "many", "y", 2000)]
    rows += [(906, None, "one", "x", 2000), (907, "new", None, "x", 2000), (908, "new", "alone", "x", 2000)]
    df = spark.createDataFrame(rows, "id int, f string, l string, s string, y int")
    confirmed = df.filter("id < 80")
    got = {(r.f, r.l): (r.pattern, r.rare, r.new_id) for r in N.rare_name_ids(df, confirmed, "id", "f", "l", "s", "y").collect()}
    assert got["f3", "one"] == ("one_state", True, 901) and got["f3", "year"] == ("state_a_year", True, 903) and got["f3", "many"] == ("many_states", False, None)
    assert got["f5", "l30"] == ("one_state", False, None)
    assert ("new", "alone") not in got and len(got) == 43
    assert N.rare_name_ids(df.limit(0), confirmed, "id", "f", "l", "s", "y").count() == 0


def test_shape_files_round_trip(spark, tmp_path):
    square = lambda x, y, r: [(x - r, y - r), (x - r, y + r), (x + r, y + r), (x + r, y - r), (x - r, y - r)]
    areas = {"A1": [square(0, 0, 10), square(0, 0, 5)[::-1], square(0, 0, 2)], "ümlaut": [square(100, 50, 1)], "": [square(-7, -7, 0.5), square(20, 20, 1)]}
    (tmp_path / "one.zip").write_bytes(shapes.pack_shapes([("A1", areas["A1"]), ("ümlaut", areas["ümlaut"])]))
    (tmp_path / "two.zip").write_bytes(shapes.pack_shapes([("", areas[""])]))
    (tmp_path / "none.zip").write_bytes(shapes.pack_shapes([]))
    (tmp_path / "note.txt").write_text("no archive")
    found = shapes.shapes(shapes.archives(spark, str(tmp_path)))
    got = {r.id: [[(p.x, p.y) for p in ring] for ring in r.rings] for r in found.collect()}
    assert got == {k or None: [[tuple(map(float, p)) for p in ring] for ring in v] for k, v in areas.items()}
    points = spark.createDataFrame([(1, 0.0, 0.5), (2, 3.0, 0.5), (3, 7.0, 0.5), (4, 11.0, 0.5), (5, 100.5, 50.2), (6, 20.5, 20.5), (7, None, 1.0)], "k int, x double, y double")
    for tile in (0.7, 4.0, 1000.0):
        assert {(r.k, r.id) for r in shapes.rings_join(points, found, "x", "y", "rings", tile).collect()} == {(1, "A1"), (3, "A1"), (5, "ümlaut"), (6, None)}


def test_broken_shape_files_raise():
    whole = shapes.pack_shapes([("a", [[(0, 0), (0, 1), (1, 1)]])])
    import io
    import zipfile

    shp = zipfile.ZipFile(io.BytesIO(whole)).read("area/shapes.shp")
    assert len(list(shapes.polygon_records(shp))) == 1
    for broken in (shp[:-3], b"\0" * 200):
        with pytest.raises(ValueError):
            list(shapes.polygon_records(broken))
    with pytest.raises(KeyError):
        shapes.table_values(zipfile.ZipFile(io.BytesIO(whole)).read("area/shapes.dbf"), "missing")


def test_claims_are_closed_and_overturned(spark):
    """An accepted name closes its group; of several entities that one owner has in a period only its usual one stays; open claims fill from neighbours."""
    from panelweave.operators import claims as C

    schema = "id long, period long, owner long, kind int, system string, sim double, clean_sim double, near_sim double, same_name boolean, same_city boolean"
    row = lambda i, p, o, kind, sim=0.0, same=False: (i, p, o, kind, None, sim, sim, 0.0, same, False)
    rows = [row(1, p, 7, 2, 1.0, True) for p in range(4)] + [row(2, 0, 7, 1, 0.99)]  # closed by 1
    rows += [row(3, 1, 8, 2, 1.0, True), row(3, 2, 8, 1), row(3, 3, 8, 2, 1.0, True)]  # between equal neighbours
    rows += [row(4, 1, 9, 1), row(5, 1, None, 1), row(6, None, 9, 1, 0.9)]
    got = {(r.id, r.period): (r.value, r.step) for r in C.settle_claims(spark.createDataFrame(rows, schema)).collect()}
    assert got[1, 0] == (7, "second kind by name") and got[2, 0] == (0, "second kind by name")
    assert got[3, 1][0] == got[3, 2][0] == 8 and got[3, 2][1] == "between equal neighbours"
    assert len(got) == len(rows)
    steps = [C.Step("all", [], "owner"), next(s for s in C.STEPS if s.name == "usual entity of several")]
    taken = spark.createDataFrame([row(1, p, 7, 1) for p in range(6)] + [row(2, 0, 7, 1)], schema)
    assert {(r.id, r.period): r.value for r in C.settle_claims(taken, steps).collect()} == {(1, p): 7 for p in range(6)} | {(2, 0): 0}


def test_settled_claims_write_what_steps_read(spark, sf, monkeypatch):
    """A step writes no table for flags that one holds already, and the query's claims carry no names or addresses through the steps."""
    from panelweave.operators import claims as C

    written = []
    keep = C.stored
    monkeypatch.setattr(C, "stored", lambda df: written.append(df.columns) or keep(df))
    step = next(s for s in C.STEPS if s.name == "usual entity of the owner")
    rows = [(1, 0, 7, 7), (1, 1, 7, 7), (1, 2, 7, None), (2, 0, 7, 0), (3, 0, 8, None)]
    got = C.settle_claims(spark.createDataFrame(rows, "id long, period long, owner long, value long"), [step])
    assert {(r.id, r.period): r.value for r in got.collect()} == {(1, 0): 7, (1, 1): 7, (1, 2): 7, (2, 0): 0, (3, 0): None}
    assert len(written) == 3
    seen = []
    monkeypatch.setattr(C, "settle_claims", lambda claims: seen.append(claims.columns) or claims.selectExpr("id", "period", "owner", "0 as value", "'' as step"))
    registry.queries()["q_settled_claims"](spark, sf)
    assert set(seen[0]) == {"id", "period", "owner", "kind", "system", "sim", "clean_sim", "near_sim", "same_name", "same_city"}


def test_claims_are_scored_as_by_sql(spark, tmp_path):
    """Similarities to the last bit: addresses with letters of two bytes, and a prefix whose weight is rounded once."""
    duckdb = pytest.importorskip("duckdb")
    names = [(1, "J. Gunimaren", "berleyströmtan197@mail.example.com"), (2, "Joolto Gunimaren", "berleyströmtan768@example.net"), (3, "M. Rennirenson", None), (4, "Mari Rennirenson", "strömhamgulo0@post.example.org")]
    rows = [(i, i + i % 2, "web", name, mail, "c", 1, "retail", 5) for i, name, mail in names] + [(5, 4, "web", "Mari Rennirenson", "strömhamgulo839@example.net", "c", 1, "retail", 5)]
    c = spark.createDataFrame(rows, "client_id long, master_id long, source string, name string, email string, city string, nation_id int, segment string, m int")
    c.withColumn("updated_at", F.make_timestamp(F.lit(2024), "m", F.lit(1), F.lit(0), F.lit(0), F.lit(0))).drop("m").write.parquet(str(tmp_path / "clients.parquet"))
    spark.createDataFrame([(1, None, None, None)], "client_id long, valid_at timestamp, segment string, city string").write.parquet(str(tmp_path / "client_changes.parquet"))
    con = duckdb.connect()
    for t in ("clients", "client_changes"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    columns = ["id", "sim", "near_sim"]
    want = sorted(con.sql(f"with {G._CLAIMS} select {', '.join(columns)} from claims").fetchall())
    assert sorted(tuple(r) for r in G.claims(spark, str(tmp_path)).select(columns).collect()) == want and len(want) == 5
    assert dict((i, s) for i, s, _ in want)[1] > 0.88 and dict((i, n) for i, _, n in want)[1] > 0.875
