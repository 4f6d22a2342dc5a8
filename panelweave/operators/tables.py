"""Small verbs on tables: selection by name, collapse, tabulation, several-value pivots, recoding, transposing, row reductions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_names(df: DataFrame, starts: str | None = None, ends: str | None = None, matches: str | None = None, without: Sequence[str] = (), first: Sequence[str] = ()) -> DataFrame:
    """Columns that fulfil all of the tests, less ``without``; ``first`` come first whatever the tests say."""
    held = [c for c in df.columns if (starts is None or c.startswith(starts)) and (ends is None or c.endswith(ends)) and (matches is None or re.search(matches, c)) and c not in without]
    return df.select(*[F.col(f"`{c}`") for c in [*first, *[c for c in held if c not in first]]])


def last_wins(rules: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """A chain of unguarded replacements: the last rule that holds decides; a null condition doesn't hold."""
    out = None
    for condition, value in reversed(rules):
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row for each key (null is a key): the first by ``order``, which must be total."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def duplicates_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys have so many ``copies``: ``keys`` and ``surplus`` rows beyond the first."""
    n = df.groupBy(*keys).agg(F.count("*").alias("copies"))
    return n.groupBy("copies").agg(F.count("*").alias("keys"), F.sum(F.col("copies") - 1).alias("surplus"))


def row_index(df: DataFrame, name: str, order: Sequence[Column | str], within: Sequence[str]) -> DataFrame:
    """Row numbers from 1 within a group, by a total order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))


def right_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """All right rows, with the left's columns where a key meets one; null keys meet none."""
    return left.join(right, list(on), "right")


def left_only_pairs(left: DataFrame, right: DataFrame, a: str, b: str, block: Sequence[str] = ()) -> DataFrame:
    """Pairs of the left, brought to a < b, that the right doesn't have whichever way round, in the same block."""
    key = lambda df: df.select(*block, F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()
    return key(left).join(key(right), [*block, a, b], "left_anti")


def lookup(df: DataFrame, column: str, table: dict, name: str, default=None) -> DataFrame:
    """A value from a small dictionary; null and unknown values take ``default``."""
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return df.withColumn(name, F.coalesce(F.try_element_at(entries, F.col(column)), F.lit(default)))


def collapse(df: DataFrame, keys: Sequence[str], stats: dict[str, tuple[str, str]], order: str | None = None, weight: str | None = None) -> DataFrame:
    """``stats``: name to (statistic, column).

    ``mean`` and ``sum`` are weighted if there is a ``weight``; ``rawsum`` never
    is; ``count`` counts non-null values, ``max`` and ``min`` leave nulls out,
    ``firstnm`` is the first non-null value by ``order``, ties to the smaller
    value.  A sum over nulls only is 0, a mean of none is null.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    made = {
        "mean": lambda c: F.sum(F.col(c) * w) / F.sum(F.when(F.col(c).isNotNull(), w)), "sum": lambda c: F.coalesce(F.sum(F.col(c) * w), F.lit(0.0)), "rawsum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
        "count": F.count, "max": F.max, "min": F.min,
        "firstnm": lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(order), F.col(c))))[c],
    }
    return df.groupBy(*keys).agg(*[made[s](c).alias(n) for n, (s, c) in stats.items()])


def two_way(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts of rows by two variables, with ``total``; ``values`` of the columns are given, others count in the total only."""
    cells = [F.count(F.when(F.col(column) == v, 1)).alias(str(v)) for v in values]
    return df.groupBy(row).agg(*cells, F.count("*").alias("total"))


def weighted_counts(df: DataFrame, keys: Sequence[str], weight: str, name: str = "n") -> DataFrame:
    """The group's summed weight beside each row; a null weight counts nothing."""
    return df.withColumn(name, F.coalesce(F.sum(weight).over(Window.partitionBy(*keys)), F.lit(0)))


def concentration(df: DataFrame, keys: Sequence[str], n: str, full: int = 3) -> DataFrame:
    """Sum of (n / full) squared over a group's rows, as ``weight``: 1 where one row holds all ``full`` periods."""
    return df.groupBy(*keys).agg(F.sum(F.col(n) * F.col(n) / F.lit(float(full * full))).alias("weight"))


def row_greatest(columns: Sequence[str]) -> Column:
    """The greatest non-null value of the columns; null if all are."""
    return F.greatest(*[F.col(c) for c in columns]) if len(columns) > 1 else F.col(columns[0])


def across(df: DataFrame, keys: Sequence[str], columns: Sequence[str], f: Callable[[Column], Column], name: str = "{}") -> DataFrame:
    """One aggregate of many columns, named by a pattern."""
    return df.groupBy(*keys).agg(*[f(F.col(c)).alias(name.format(c)) for c in columns])


def top_union(df: DataFrame, keys: Sequence[str], item: str, n: int) -> DataFrame:
    """Items among the n most frequent of any group, ties given their mean rank: ``item`` and ``groups``, in how many."""
    counts = df.groupBy(*keys, item).agg(F.count("*").alias("_n"))
    low = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("_n")))
    same = F.count("*").over(Window.partitionBy(*keys, "_n"))
    return counts.withColumn("_r", low + (same - 1) / 2.0).filter(F.col("_r") <= n).groupBy(item).agg(F.count("*").alias("groups"))


def append_labelled(parts: dict[str, DataFrame], label: str) -> DataFrame:
    """Tables one below the other by column name, missing columns null, with a label each."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn(label, F.lit(n)) for n, t in parts.items()])


def exactly_one(a: Column, b: Column) -> Column:
    """One condition holds and the other doesn't; null: not."""
    return F.coalesce(a, F.lit(False)) != F.coalesce(b, F.lit(False))


def pivot_several(df: DataFrame, keys: Sequence[str], name: str, values: Sequence, cells: dict[str, Column], fill=None) -> DataFrame:
    """One column ``<cell>_<value>`` for each aggregate in ``cells`` and each of ``values``; ``fill`` for what is null."""
    out = df.groupBy(*keys).pivot(name, list(values)).agg(*[c.alias(n) for n, c in cells.items()])
    pairs = {(f"{v}_{n}" if len(cells) > 1 else f"{v}"): f"{n}_{v}" for v in values for n in cells}
    out = out.withColumnsRenamed(pairs)
    return out if fill is None else out.fillna(fill, subset=list(pairs.values()))


def name_array(df: DataFrame, keys: Sequence[str], value: str, most: int) -> DataFrame:
    """A key's different values in order as columns ``<value>_1`` and so on up to ``most``, and ``n``, how many there are."""
    a = df.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("_a"))
    return a.select(*keys, F.size("_a").alias("n"), *[F.get("_a", F.lit(i)).alias(f"{value}_{i + 1}") for i in range(most)])


def transpose(df: DataFrame, key: str, values: Sequence, columns: Sequence[str], name: str = "variable") -> DataFrame:
    """Columns as rows: one row for each of ``columns``, one column for each of ``values`` of the key, which must be unique."""
    long = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([key], list(columns), name, "_v")
    return long.groupBy(name).pivot(key, list(values)).agg(F.max("_v"))


def recode(c: Column, table: dict, otherwise: Column | None = None) -> Column:
    """Values replaced by a small dictionary, in which None stands for null; others stay, or take ``otherwise``."""
    out = None
    for old, new in table.items():
        test = c.isNull() if old is None else c == F.lit(old)
        out = F.when(test, F.lit(new)) if out is None else out.when(test, F.lit(new))
    rest = c if otherwise is None else otherwise
    return rest if out is None else out.otherwise(rest)


def null_if(c: Column, values: Sequence) -> Column:
    """Null where the value is one of these."""
    return F.when(~c.isin(list(values)), c) if values else c


def near(a: Column, b: Column, within: float = 1.5e-8) -> Column:
    """Whether two numbers differ by less than ``within``; null if either is."""
    return F.abs(a - b) < within


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same different values."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def contains_all(a: Column, b: Column) -> Column:
    """Whether array a holds every value of b."""
    return F.size(F.array_except(b, a)) == 0


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns stacked to one list of strings: ``value`` and ``n``; nulls don't count."""
    stacked = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("value"))
    return stacked.filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))


def first_where(df: DataFrame, keys: Sequence[str], order: str, condition: Column, value: str) -> DataFrame:
    """``first``: the value in the first row by ``order`` that fulfils the condition (ties: the smaller value); null if none does."""
    found = F.min(F.when(condition, F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(found.v.alias("first"))


def levels(df: DataFrame, column: str, most: int = 10_000) -> list:
    """A column's different non-null values in order, for loops on the driver; raises over ``most``."""
    found = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has over {most} values")
    return sorted(found)


def distinct_rounded(df: DataFrame, columns: Sequence[str], places: int = 5) -> DataFrame:
    """Different rows after these columns are rounded."""
    return df.withColumns({c: F.round(c, places) for c in columns}).distinct()


def most_frequent(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """The n most frequent combinations, ties by the values."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns).limit(n)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def next_pairs(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """A key's (value, next value) pairs of neighbouring periods with a value: all combinations of the two periods' different values."""
    once = df.filter(F.col(value).isNotNull()).select(key, time, value).distinct()
    periods = once.select(key, time).distinct().withColumn("_next", F.lead(time).over(Window.partitionBy(key).orderBy(time)))
    a = once.join(periods, [key, time]).select(key, "_next", F.col(value).alias("prev"))
    b = once.select(key, F.col(time).alias("_next"), F.col(value).alias("next"))
    return a.join(b, [key, "_next"]).select(key, F.col("_next").alias(time), "prev", "next")


def least_probability(pairs: DataFrame, keys: Sequence[str], table: DataFrame) -> DataFrame:
    """For each key the least looked-up ``p`` of its (prev, next) pairs; pairs that the table lacks don't count, a key without any has null."""
    return pairs.join(table.select("prev", "next", "p"), ["prev", "next"], "left").groupBy(*keys).agg(F.min("p").alias("least"))


def column_audit(df: DataFrame) -> DataFrame:
    """For each string column: values, those with characters beyond ASCII, those with spaces at an end, those with control characters."""
    names = [c for c, t in df.dtypes if t == "string"]
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.count(F.col(c)).alias("n"), F.count(F.when(F.col(c).rlike(r"[^\x00-\x7F]"), 1)).alias("n_beyond_ascii"), F.count(F.when(F.trim(F.col(c)) != F.col(c), 1)).alias("n_padded"), F.count(F.when(F.col(c).rlike(r"\p{Cc}"), 1)).alias("n_control")).alias(f"s{i}") for i, c in enumerate(names)])
    return one.select(F.inline(F.array(*[f"s{i}" for i in range(len(names))])))
