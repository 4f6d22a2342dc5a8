"""Data verbs with declared null and tie rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import durable
from .joins import SALTS, spread_join


class CheckFailed(ValueError):
    """An invariant of the data does not hold."""


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    found = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if found:
        raise CheckFailed(f"{list(keys)} is not unique: {found[0]}")
    return df


def assert_exhaustive(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    found = df.filter(~F.coalesce(F.col(column).isin(list(values)), F.lit(False))).select(column).limit(1).collect()
    if found:
        raise CheckFailed(f"{column} has {found[0][0]!r}")
    return df


def assert_row_count(df: DataFrame, n: int) -> DataFrame:
    if (m := df.count()) != n:
        raise CheckFailed(f"{m} rows, not {n}")
    return df


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], card: str = "1:1", keep: Sequence[int] = (1, 2, 3), check: Sequence[int] | None = None, null_safe: bool = False) -> DataFrame:
    """Full join with ``_merge`` (1 left only, 2 right only, 3 both).

    ``card`` is 1:1, m:1 or 1:m, and a side said to be unique is tested first;
    ``check`` are the only outcomes allowed.  Null keys match nothing unless
    ``null_safe``.  Columns of the right that the left has are left out.
    """
    if card[0] == "1":
        assert_unique(left, on)
    if card[-1] == "1":
        assert_unique(right, on)
    extra = [c for c in right.columns if c not in left.columns]
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in on], *extra, F.lit(True).alias("_right"))
    match = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) if null_safe else F.col(k) == F.col(f"_r_{k}") for k in on]
    j = left.withColumn("_left", F.lit(True)).join(r, reduce(lambda a, b: a & b, match), "full")
    merge = F.when(F.col("_left") & F.col("_right"), 3).when(F.col("_left"), 1).otherwise(2)
    out = j.withColumn("_merge", merge).select(*[F.coalesce(k, f"_r_{k}").alias(k) for k in on], *[c for c in left.columns if c not in on], *extra, "_merge")
    if check is not None:
        bad = out.filter(~F.col("_merge").isin(list(check))).limit(1).collect()
        if bad:
            raise CheckFailed(f"_merge is {bad[0]['_merge']}")
    return out.filter(F.col("_merge").isin(list(keep)))


def merge_audit(joined: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return joined.groupBy(*by, "_merge").agg(F.count("*").alias("n"))


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """On all common columns; null matches null.

    Inner and left joins on columns of the same type, floating ones apart, have one
    text as their key, so that few values with many rows are dealt into tasks.
    """
    on = [c for c in left.columns if c in right.columns]
    kinds = [(left.schema[c].dataType, right.schema[c].dataType) for c in on]
    if how in ("inner", "left") and all(a == b and a.typeName() in ("byte", "short", "integer", "long", "string", "date", "boolean") for a, b in kinds):
        key = F.to_json(F.struct(*on)).alias("_k")
        l = left.select("*", key, F.pmod(F.xxhash64(*[f.name for f in left.schema if f.dataType.typeName() != "map"]), F.lit(SALTS)).cast("int").alias("_salt"))
        dealt = right.select(*[c for c in right.columns if c not in on], key, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        return spread_join(l, dealt, ["_k", "_salt"], how).drop("_k", "_salt")
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(r, match, how).drop(*[f"_r_{c}" for c in on])


def waterfall(df: DataFrame, strategies: Sequence[tuple[DataFrame, Sequence[str]]], value: str) -> DataFrame:
    """``value`` from the first strategy that has one, and ``strategy``, its number (null if none).

    Each strategy is a table, unique on its keys after nulls, and the keys; the
    smallest value stands if a table repeats a key.
    """
    out, found = df, []
    for k, (t, on) in enumerate(strategies, 1):
        one = t.groupBy(*on).agg(F.min(value).alias(f"_v{k}"))
        out = out.join(one, list(on), "left")
        found.append(F.col(f"_v{k}"))
    step = reduce(lambda a, kv: a.when(kv[1].isNotNull(), kv[0]), enumerate(found[1:], 2), F.when(found[0].isNotNull(), 1))
    return out.withColumn(value, F.coalesce(*found)).withColumn("strategy", step).drop(*[f"_v{k}" for k in range(1, len(found) + 1)])


def split_by(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that fulfil a condition, and the rest, nulls included."""
    held = F.coalesce(condition, F.lit(False))
    return df.filter(held), df.filter(~held)


def keep_groups(df: DataFrame, keys: Sequence[str], condition: Column, how: str = "any") -> DataFrame:
    """Whole groups of which any or all rows fulfil a condition (null: not)."""
    held = F.coalesce(condition, F.lit(False))
    test = (F.bool_or if how == "any" else F.bool_and)(held).over(Window.partitionBy(*keys))
    return df.withColumn("_keep", test).filter("_keep").drop("_keep")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], ties: bool = False) -> DataFrame:
    """One row for each key, or all tied ones; the order must be total for one."""
    rank = (F.rank if ties else F.row_number)().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def top_with_average_ranks(df: DataFrame, keys: Sequence[str], value: str, n: int) -> DataFrame:
    """Rows whose rank by falling value is at most n, ties given their mean rank in ``rank``."""
    by = Window.partitionBy(*keys)
    low = F.rank().over(by.orderBy(F.desc(value)))
    same = F.count("*").over(Window.partitionBy(*keys, value))
    return df.withColumn("rank", low + (same - 1) / 2.0).filter(F.col("rank") <= n)


def mode_per_group(df: DataFrame, keys: Sequence[str], value: str, ties: str = "min") -> DataFrame:
    """``mode``, ``n``, ``share`` of the most frequent non-null value; ``ties``: min, max or null."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    by = Window.partitionBy(*keys)
    order = F.desc(value) if ties == "max" else F.asc(value)
    ranked = (
        counts.withColumn("_rank", F.row_number().over(by.orderBy(F.desc("n"), order)))
        .withColumn("_second", F.lead("n").over(by.orderBy(F.desc("n"), order))).withColumn("share", F.col("n") / F.sum("n").over(by))
    )
    mode = F.when(F.col("_second") == F.col("n"), None).otherwise(F.col(value)) if ties == "null" else F.col(value)
    return ranked.filter("_rank = 1").select(*keys, mode.alias("mode"), "n", "share")


def dominant(df: DataFrame, keys: Sequence[str], value: str, least: float = 0.75) -> DataFrame:
    """The unique mode if its share is ``least`` or more, else null."""
    m = mode_per_group(df, keys, value, "null")
    return m.select(*keys, F.when(F.col("share") >= least, F.col("mode")).alias("dominant"), "share")


def argmax(df: DataFrame, keys: Sequence[str], of: str, by: str) -> DataFrame:
    """``of`` where ``by`` is greatest, the least ``of`` on ties; null ``by`` is no candidate."""
    ranked = df.filter(F.col(by).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by), F.asc(of))))
    return ranked.filter("_r = 1").select(*keys, F.col(of).alias("argmax"), F.col(by).alias("max"))


def conditional_distinct(condition: Column, value: Column) -> Column:
    return F.count_distinct(F.when(condition, value))


def distinct_with_null(value: str) -> Column:
    """Distinct values, null as one of them."""
    return F.count_distinct(value) + F.max(F.when(F.col(value).isNull(), 1).otherwise(0))


def share_in_group(df: DataFrame, group: Sequence[str], item: Sequence[str]) -> DataFrame:
    """``n`` rows of each item, and their ``share`` in the group."""
    n = df.groupBy(*group, *item).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*group)))


def common_values(df: DataFrame, block: str, member: str, value: str) -> DataFrame:
    """Values that every member of a block has."""
    d = df.select(block, member, value).distinct()
    members = d.groupBy(block).agg(F.count_distinct(member).alias("_m"))
    return d.groupBy(block, value).agg(F.count("*").alias("_n")).join(members, block).filter("_n = _m").select(block, value)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], pieces: int = 64) -> DataFrame:
    """The keys and ``q``, an array of exact quantiles (linear between neighbours); null values don't count, null keys are a group.

    A sketch cuts each group into ``pieces``; the different values are counted in
    these, and only the pieces that hold a wanted place are put in order, so no
    task holds a whole group, be it the table.  The sketch is kept: it depends on
    the order in which its parts arrive, and pieces that are counted by one sketch
    and put in order by another would give wrong places.
    """
    names = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    k = [F.col(c).alias(n) for c, n in zip(keys, names)] or [F.lit(0).alias("_k0")]
    v = df.select(*k, F.col(value).alias("_v")).filter("_v is not null")
    places = ", ".join(str(i / pieces) for i in range(1, pieces))
    cuts = durable(v.groupBy(*names).agg(F.expr(f"approx_percentile(_v, array({places}), 1000)").alias("_cuts"), F.count("*").alias("_n")))
    match = lambda other, on: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in on])
    right = lambda t, on: t.withColumnsRenamed({c: f"_r{c}" for c in on})
    d = v.groupBy(*names, "_v").agg(F.count("*").alias("_m")).join(right(cuts, names), match(cuts, names)).drop(*[f"_r{c}" for c in names])
    d = d.withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))))
    per = d.groupBy(*names, "_b").agg(F.sum("_m").alias("_in"), F.first("_n").alias("_n"))
    per = per.withColumn("_before", F.coalesce(F.sum("_in").over(Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), place.cast("long").alias("at"), weight.alias("w")) for i, q in enumerate(shares) for h in [(F.col("_n") - 1) * F.lit(float(q))]
                       for place, weight in ((F.floor(h), 1 - (h - F.floor(h))), (F.floor(h) + 1, h - F.floor(h)))])
    hits = per.withColumn("_x", F.explode(wanted)).select(*names, "_b", "_before", "_x.*").filter("w > 0 and at >= _before").join(right(per.select(*names, "_b", "_in"), [*names, "_b"]), match(per, [*names, "_b"]))
    hits = hits.filter(F.col("at") < F.col("_before") + F.col("_in")).select(*names, "_b", "_before", "i", "at", "w")
    run = Window.partitionBy(*names, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    pieces_ = hits.select(*names, "_b").distinct()
    inside = d.join(right(pieces_, [*names, "_b"]), match(pieces_, [*names, "_b"]), "left_semi").withColumn("_upto", F.sum("_m").over(run))
    found = inside.join(right(hits, [*names, "_b"]), match(hits, [*names, "_b"])).filter("_before + _upto > at and _before + _upto - _m <= at")
    one = found.groupBy(*names, "i").agg(F.sum(F.col("_v").cast("double") * F.col("w")).alias("x"))
    out = one.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("q"))
    return out.select(*[F.col(n).alias(c) for c, n in zip(keys, names)], "q")


def median_split(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Each entity's median, the median of those, and ``above`` (strictly; null without a median)."""
    per = durable(df.groupBy(entity).agg(F.expr(f"percentile(`{value}`, 0.5)").alias("median")))
    cut = exact_quantiles(per, [], "median", [0.5]).select(F.col("q")[0].alias("cut"))
    return per.join(F.broadcast(cut)).select(entity, "median", "cut", (F.col("median") > F.col("cut")).alias("above"))  # one row


def winsorise(df: DataFrame, keys: Sequence[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Values drawn in to their group's quantiles (linear); null stays null; rows with a null key go."""
    cuts = exact_quantiles(df, keys, value, [low, high]).select(*keys, F.col("q").alias("_c"))
    inside = F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), F.col("_c")[0]), F.col("_c")[1]))
    return df.join(cuts, list(keys)).withColumn(value, inside).drop("_c")


def margins(df: DataFrame, sets: Sequence[Sequence[str]], measures: dict[str, str]) -> DataFrame:
    """Several groupings in one pass; ``measures``: name to SQL aggregate."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    cells = [[F.col(c) for c in s] for s in sets]
    return df.groupingSets(cells, *[F.col(c) for c in names]).agg(*[F.expr(e).alias(n) for n, e in measures.items()])


def pivot_wide(df: DataFrame, keys: Sequence[str], name: str, values: Sequence, cell: Column, fill=None) -> DataFrame:
    out = df.groupBy(*keys).pivot(name, list(values)).agg(cell)
    return out if fill is None else out.fillna(fill)


def pivot_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def prioritised(columns: Sequence[str], order: Sequence[str]) -> Column:
    """The first of ``order`` that any column has, else the first non-null column."""
    held = F.array(*columns)
    out = None
    for v in order:
        test = F.coalesce(F.array_contains(held, v), F.lit(False))
        out = F.when(test, v) if out is None else out.when(test, v)
    return out.otherwise(F.coalesce(*columns))


def row_mean(columns: Sequence[str]) -> Column:
    n = row_nonmissing(columns)
    return F.when(n > 0, row_total(columns) / n)


def row_total(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])


def row_nonmissing(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """n rows by a hash order of the key, of the table or of each group."""
    order = (F.xxhash64(F.col(key), F.lit(seed)), F.col(key))
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return not a.exceptAll(b).head(1) and not b.exceptAll(a).head(1)


def bins(value: Column, edges: Sequence[float]) -> Column:
    """Right-closed interval number, from 0; null outside."""
    out = None
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        test = (value > a) & (value <= b)
        out = F.when(test, k) if out is None else out.when(test, k)
    return out


def apply_to_strings(df: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({c: f(F.col(c)) for c, t in df.dtypes if t == "string"})


def codes(df: DataFrame, value: str, code: str) -> DataFrame:
    """Alphabetical integer codes from 1; null has none.

    The different values are dealt into ranges, numbered in each, and shifted by
    the sizes of the ranges before.
    """
    d = durable(df.select(value).filter(F.col(value).isNotNull()).distinct().repartitionByRange(F.col(value)).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    shift = d.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(value))
    numbered = d.withColumn("_place", place).join(F.broadcast(shift), "_range").select(value, (F.col("_place") + F.col("_shift")).cast("int").alias(code))
    return df.join(numbered, value, "left")
