"""Graphs of names and of their sounds, and blocks of names from them; names that several ids share, judged by their rarity."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import connected_components, durable
from .identity import block_numbers, split_giant


def name_graph(names: DataFrame, rows: DataFrame, name: str = "name", row: str = "row") -> DataFrame:
    """Edges (a, b), a < b, of names that stand in one row of a dictionary (``row``, ``name``), among the ``names`` in use.

    A row's names are joined to its smallest, which connects the same names as
    all its pairs would, in as many edges as it has names.  Null and empty names
    are none.
    """
    used = names.select(F.col(name).alias("b")).filter("trim(b) <> ''").distinct()
    held = rows.select(F.col(row).alias("_row"), F.col(name).alias("b")).filter("_row is not null").distinct().join(used, "b")
    least = held.groupBy("_row").agg(F.min("b").alias("a"))
    return held.join(least, "_row").filter("a < b").select("a", "b").distinct()


def code_graph(names: DataFrame, edges: DataFrame, codes: DataFrame, name: str = "name") -> DataFrame:
    """The name graph with each name drawn together with all of its code (``name``, ``code``): edges (a, b), a <= b, and one of each code with itself."""
    c = codes.select("name", "code").filter("code is not null")
    own = names.select(F.col(name).alias("name")).distinct().join(c, "name").select(F.col("code").alias("a"), F.col("code").alias("b"))
    side = lambda k: c.select(F.col("name").alias(k), F.col("code").alias(f"_{k}"))
    drawn = edges.join(side("a"), "a").join(side("b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    return own.union(drawn).distinct()


def name_blocks(names: DataFrame, rows: DataFrame, codes: DataFrame, name: str = "name", kind: str = "kind", first: str = "F", groups: DataFrame | None = None) -> DataFrame:
    """``name``, ``kind``, ``code``, ``part`` and ``block`` of each name of a kind.

    For each kind: its name graph, the graph of codes, its components; the largest
    component is taken apart (``split_giant``); parts are numbered by their
    smallest code, and those of other kinds follow the numbers of ``first``.
    """
    used = names.select(F.col(name).alias("name"), F.col(kind).alias("kind")).filter("trim(name) <> '' and kind is not null").distinct()
    out = None
    for value in sorted(r[0] for r in used.select("kind").distinct().collect()):
        mine = used.filter(F.col("kind") == value)
        graph = code_graph(mine, name_graph(mine, rows), codes)
        parts = split_giant(connected_components(graph, "a", "b").select(F.col("node").alias("code"), "component"), "code", "component", groups)
        coded = mine.join(codes.select("name", "code"), "name").join(parts.select("code", "part"), "code")
        out = coded if out is None else out.unionByName(coded)
    if out is None:
        return used.selectExpr("name", "kind", "cast(null as string) as code", "cast(null as string) as part", "cast(null as long) as block").limit(0)
    least = out.groupBy("kind", "part").agg(F.min("code").alias("_least"))
    numbers = numbered(least, ["kind"], ["_least", "part"])
    return block_numbers(out.join(numbers, ["kind", "part"]), "kind", "_number", first).select("name", "kind", "code", "part", "block")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``_number`` from 0 within the keys, null keys included, in the given order; ranges of the order are numbered apart, so that no task holds a key's rows."""
    ranged = df.repartitionByRange(*[F.col(c) for c in (*keys, *order)]).sortWithinPartitions(*keys, *order)
    placed = ranged.withColumn("_piece", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    placed = durable(placed)
    counts = placed.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy("_row")) - 1
    starts = starts.withColumnsRenamed({c: f"_of{i}" for i, c in enumerate([*keys, "_piece"])})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of{i}")) for i, c in enumerate([*keys, "_piece"])])
    out = placed.withColumn("_at", within).join(starts, same).withColumn("_number", F.col("_start") + F.col("_at"))
    return out.drop("_piece", "_row", "_at", "_start", *[f"_of{i}" for i in range(len(keys) + 1)])


#: By the pattern of a name's states, the quantiles under which its first and last name are both rare; any pair of them will do.
RARITY = {"one_state": ((0.75, 0.5), (0.9, 0.25)), "state_a_year": ((0.75, 0.5),), "many_states": ((0.15, 0.1),)}


def rare_name_ids(df: DataFrame, confirmed: DataFrame, id_col: str, first: str, last: str, state: str, year: str, rarity: dict = RARITY) -> DataFrame:
    """Names (``first``, ``last``) of several ids: ``pattern``, ``rare``, ``new_id``.

    A name is of one state, of one state in each year, or of many states in some
    year; its pattern says how rare it must be for its ids to be one person.
    Frequencies are shares of names among the ``confirmed`` ids (a name not seen
    there has 0), quantiles those over the different names of several or single ids.
    A rare name takes the id of its latest year (ties: the smallest), others none.
    Rows without a name, and names of one id, are left out.
    """
    d = df.filter(F.col(first).isNotNull() & F.col(last).isNotNull())

    def shares(c: str, out: str) -> DataFrame:
        pairs = confirmed.filter(F.col(first).isNotNull() & F.col(last).isNotNull()).select(id_col, c).distinct()
        total = F.broadcast(pairs.agg(F.count("*").alias("_t")))  # one row
        return pairs.groupBy(c).agg(F.count("*").alias("_n")).join(total, F.lit(True)).select(c, (F.col("_n") / F.col("_t")).alias(out))

    names = d.select(first, last).distinct().join(shares(first, "_f"), first, "left").join(shares(last, "_l"), last, "left").fillna(0.0, ["_f", "_l"])
    cuts = sorted({(c, q) for pairs in rarity.values() for f, l in pairs for c, q in (("_f", f), ("_l", l))})
    at = {k: f"_q{i}" for i, k in enumerate(cuts)}
    quantiles = F.broadcast(names.agg(*[F.expr(f"percentile({c}, {q})").alias(at[c, q]) for c, q in cuts]))  # one row
    yearly = d.groupBy(first, last, year).agg(F.count_distinct(state).alias("_k")).groupBy(first, last).agg(F.max("_k").alias("_most"))
    latest = F.min(F.struct((-F.col(year)).alias("y"), F.col(id_col).alias("i"))).getField("i")
    per = d.groupBy(first, last).agg(F.count_distinct(id_col).alias("n_ids"), F.count_distinct(state).alias("_states"), latest.alias("_latest")).filter("n_ids > 1").join(yearly, [first, last])
    pattern = F.when(F.col("_most") > 1, "many_states").when(F.col("_states") == 1, "one_state").when(F.col("_states") > 1, "state_a_year")
    per = per.withColumn("pattern", pattern).join(names, [first, last]).join(quantiles, F.lit(True))
    rare = F.lit(False)
    for value, pairs in rarity.items():
        for f, l in pairs:
            rare = rare | ((F.col("pattern") == value) & (F.col("_f") < F.col(at["_f", f])) & (F.col("_l") < F.col(at["_l", l])))
    rare = F.coalesce(rare, F.lit(False))
    return per.select(first, last, "n_ids", "pattern", rare.alias("rare"), F.when(rare, F.col("_latest")).alias("new_id"))
