"""Cohort and co-occurrence summaries over panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def state_changes(df: DataFrame, keys: Sequence[str], time: str, state: str) -> DataFrame:
    """``changed`` (differs from the row before, null-safe; the first row hasn't), ``n_changes`` so far, ``last_of_state`` (last period of the key in this state)."""
    w = Window.partitionBy(*keys).orderBy(time)
    first = F.row_number().over(w) == 1
    out = df.withColumn("changed", ~first & ~F.lag(state).over(w).eqNullSafe(F.col(state)))
    return out.withColumns({
        "n_changes": F.sum(F.col("changed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "last_of_state": F.max(time).over(Window.partitionBy(*keys, state)),
    })


def cohort_membership(df: DataFrame, person: str, condition: Column) -> DataFrame:
    """One row for each person: ``ever`` (some row fulfils the condition), ``only`` (all do); a null condition doesn't hold."""
    held = F.coalesce(condition, F.lit(False))
    return df.groupBy(person).agg(F.bool_or(held).alias("ever"), F.bool_and(held).alias("only"), F.count("*").alias("n"))


def period_median_split(df: DataFrame, time: str, value: str) -> DataFrame:
    """``above``: strictly over the median of the period; null without a value.

    The medians are counted over different values and joined back, one row for each period; rows without a period are a group of their own.
    """
    medians = df.groupBy(time).agg(F.median(value).alias("_median"))
    m = medians.withColumnRenamed(time, "_time")
    joined = df.join(m, df[time].eqNullSafe(m["_time"])).drop("_time")
    return joined.withColumn("above", F.col(value) > F.col("_median")).drop("_median")


def pair_rates(df: DataFrame, entity: Sequence[str], item: str, by: Sequence[str]) -> DataFrame:
    """For each period or category: in what share of entities two items occur together (``item1`` < ``item2``, ``n_both``, ``n_entities``, ``rate``).

    Items of an entity count once; the items must be few (titles, states), as pairs are made within an entity.  Entities with a null key count in ``n_entities`` but have no pairs.
    """
    once = df.select(*by, *entity, item).dropDuplicates()
    sizes = once.select(*by, *entity).distinct().groupBy(*by).agg(F.count("*").alias("n_entities"))
    keys = list(dict.fromkeys([*by, *entity]))
    a = once.filter(F.col(item).isNotNull()).withColumnRenamed(item, "item1")
    b = once.filter(F.col(item).isNotNull()).withColumnRenamed(item, "item2")
    both = a.join(b, keys).filter("item1 < item2").groupBy(*by, "item1", "item2").agg(F.count("*").alias("n_both"))
    return both.join(sizes, list(by)).withColumn("rate", F.col("n_both") / F.col("n_entities"))


def widest_pair(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The greatest edit distance between two different values of a group (0 for one value; null for none, or under a null key): ``widest``."""
    once = df.select(*keys, value).dropDuplicates()
    pairs = once.join(once.withColumnRenamed(value, "_other"), list(keys), "left").filter(f"`{value}` is null or _other is null or `{value}` <= _other")
    return pairs.groupBy(*keys).agg(F.max(F.levenshtein(value, "_other")).alias("widest"))


def precedence(outcomes: Sequence[tuple[str, Column, Column]]) -> Column:
    """A struct (``value``, ``reason``) from the first rule whose condition holds; rules are (reason, condition, value).

    A null condition doesn't hold; a rule may hold with a null value, which then
    stands, as a period that must stay unknown does.  Both null if none holds.
    """
    value = reason = None
    for name, condition, result in outcomes:
        value = F.when(condition, result) if value is None else value.when(condition, result)
        reason = F.when(condition, F.lit(name)) if reason is None else reason.when(condition, F.lit(name))
    return F.struct(value.alias("value"), reason.alias("reason"))


def joint_outcome(a: Column, b: Column) -> Column:
    """Two 0/1 outcomes as one label: joint, first, second, neither; missing if either is null."""
    return (
        F.when(a.isNull() | b.isNull(), "missing").when((a == 1) & (b == 1), "joint").when(a == 1, "first").when(b == 1, "second").otherwise("neither")
    )


def conditional_means(df: DataFrame, keys: Sequence[str], entity: str, condition: Column, value: str) -> DataFrame:
    """``mean``, ``se`` (sd by the root of n; null under two values), ``n``, ``n_entities`` of the non-null values under a condition, by key; all keys stay."""
    v = F.when(condition, F.col(value))
    out = df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("_sd"), F.count(v).alias("n"), F.countDistinct(F.when(v.isNotNull(), F.col(entity))).alias("n_entities"))
    return out.withColumn("se", F.when(F.col("n") > 1, F.col("_sd") / F.sqrt("n"))).drop("_sd")
