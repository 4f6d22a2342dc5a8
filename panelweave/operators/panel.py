"""Operators on entity-year panels: one row for each key and period, periods as integers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(keys: Sequence[str], time: str):
    return Window.partitionBy(*keys).orderBy(time)


def guarded_lag(df: DataFrame, keys: Sequence[str], time: str, value: str, name: str, k: int = 1) -> DataFrame:
    """The value k rows before, null unless that row is exactly k periods earlier."""
    w = _over(keys, time)
    return df.withColumn(name, F.when(F.lag(time, k).over(w) == F.col(time) - k, F.lag(value, k).over(w)))


def calendar_lag(df: DataFrame, keys: Sequence[str], time: str, value: str, name: str, k: int = 1) -> DataFrame:
    """The value of the period k before (after, if negative), if that period has a row."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).cast("long")).rangeBetween(-k, -k)
    return df.withColumn(name, F.max(value).over(w))


def fill(df: DataFrame, keys: Sequence[str], time: str, value: str, name: str, how: str = "agree") -> DataFrame:
    """Fill nulls: ``forward``, ``backward``, or ``agree``: both neighbours equal, or only one there.  Never overwrites."""
    w = _over(keys, time)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    found = {"forward": before, "backward": after}.get(how)
    if found is None:
        found = F.when(before.isNull(), after).when(after.isNull() | (before == after), before)
    return df.withColumn(name, F.coalesce(F.col(value), found))


def fill_single_gap(df: DataFrame, keys: Sequence[str], time: str, value: str, name: str) -> DataFrame:
    """A null between two equal neighbours of the same key takes their value."""
    w = _over(keys, time)
    a, b = F.lag(value).over(w), F.lead(value).over(w)
    return df.withColumn(name, F.coalesce(F.col(value), F.when(a == b, a)))


def spells(df: DataFrame, keys: Sequence[str], time: str, state: str) -> DataFrame:
    """Runs of one state in consecutive periods: ``spell`` number, ``begin``, ``end``, ``length``, ``censored_left``, ``censored_right``."""
    w = _over(keys, time)
    new = F.when((F.lag(time).over(w) == F.col(time) - 1) & F.lag(state).over(w).eqNullSafe(F.col(state)), 0).otherwise(1)
    numbered = df.withColumn("_new", new).withColumn("spell", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    by = Window.partitionBy(*keys)
    runs = numbered.groupBy(*keys, "spell", state).agg(F.min(time).alias("begin"), F.max(time).alias("end"), F.count("*").alias("length"))
    return runs.withColumn("censored_left", F.col("begin") == F.min("begin").over(by)).withColumn("censored_right", F.col("end") == F.max("end").over(by))


def longest_run(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """The most consecutive periods of each key; repeated periods count once."""
    d = df.select(*keys, time).filter(F.col(time).isNotNull()).distinct()
    islands = d.withColumn("_island", F.col(time) - F.row_number().over(_over(keys, time)))
    return islands.groupBy(*keys, "_island").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.max("_n").alias("longest_run"))


def gap_periods(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Single missing periods: x and x + 2 are there, x + 1 is not."""
    d = df.select(*keys, time).distinct()
    return d.withColumn("_next", F.lead(time).over(_over(keys, time))).filter(F.col("_next") == F.col(time) + 2).select(*keys, (F.col(time) + 1).alias("gap"))


def densify(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """A row for each period between a key's first and last; new rows hold nulls."""
    span = df.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    grid = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias(time))
    return grid.join(df, [*keys, time], "left")


def expand_grid(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All combinations of the columns' distinct values, nulls included: that many rows is what is asked for."""
    domains = [df.select(c).distinct() for c in columns]
    out = domains[0]
    for d in domains[1:]:
        out = out.crossJoin(d)
    return out


def future_any(df: DataFrame, keys: Sequence[str], time: str, condition: Column, name: str) -> DataFrame:
    """Whether a condition holds in any later period; null if there is no later row."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).cast("long")).rangeBetween(1, Window.unboundedFollowing)
    return df.withColumn(name, F.max(F.coalesce(condition, F.lit(False))).over(w))


def running(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """``running_sum``, ``running_max``, ``skipped`` (the row before isn't the period before)."""
    w = _over(keys, time)
    r = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"running_sum": F.sum(value).over(r), "running_max": F.max(value).over(r), "skipped": F.col(time) != F.lag(time).over(w) + 1})


def values_before(df: DataFrame, keys: Sequence[str], time: str, value: str, name: str) -> DataFrame:
    """The sorted set of a key's values in strictly earlier rows; nulls are no values.

    Only a value's first row enters the frame, so its size follows the different values.
    """
    w = _over(keys, time)
    first = F.row_number().over(Window.partitionBy(*keys, value).orderBy(time)) == 1
    marked = df.withColumn("_first", F.when(first, F.col(value)))
    return marked.withColumn(name, F.array_sort(F.collect_list("_first").over(w.rowsBetween(Window.unboundedPreceding, -1)))).drop("_first")


def first_event(df: DataFrame, keys: Sequence[str], time: str, condition: Column, name: str, prefer: tuple[int, int] | None = None) -> DataFrame:
    """The first period with the condition, one within ``prefer`` before any other."""
    w = Window.partitionBy(*keys)
    first = F.min(F.when(condition, F.col(time))).over(w)
    if prefer:
        first = F.coalesce(F.min(F.when(condition & F.col(time).between(*prefer), F.col(time))).over(w), first)
    return df.withColumn(name, first)


def event_sample(df: DataFrame, keys: Sequence[str], time: str, event: Column, reach: int = 2) -> DataFrame:
    """Event-time sample: ``event_time``, ``relative``, ``never``, ``balanced`` (all of -reach..reach seen, no other event among them)."""
    w = Window.partitionBy(*keys)
    held = F.coalesce(event, F.lit(False))
    out = first_event(df.withColumn("_e", held), keys, time, F.col("_e"), "event_time")
    near = F.abs(F.col(time) - F.col("event_time")) <= reach
    out = out.withColumn("relative", F.col(time) - F.col("event_time")).withColumn("never", F.col("event_time").isNull())
    seen = F.size(F.collect_set(F.when(near, F.col(time))).over(w))
    others = F.count(F.when(near & F.col("_e") & (F.col(time) != F.col("event_time")), 1)).over(w)
    return out.withColumn("balanced", ~F.col("never") & (seen == 2 * reach + 1) & (others == 0)).drop("_e")


def turnover(df: DataFrame, keys: Sequence[str], time: str, holder: str) -> DataFrame:
    """``changed``: 1 if the holder differs from the period before, null if that is missing or a holder unknown."""
    out = guarded_lag(df, keys, time, holder, "_before")
    return out.withColumn("changed", (F.col("_before") != F.col(holder)).cast("int")).drop("_before")


def status_flags(df: DataFrame, keys: Sequence[str], time: str, status: str, levels: Sequence[str]) -> DataFrame:
    """For each level: now, before (guarded), entered, left, constant."""
    out = guarded_lag(df, keys, time, status, "_s")
    columns = {}
    for v in levels:
        n = v.lower().replace(" ", "_")
        now, was = F.col(status) == v, F.col("_s") == v
        columns |= {f"is_{n}": now.cast("int"), f"to_{n}": (now & ~was).cast("int"), f"from_{n}": (was & ~now).cast("int"), f"stays_{n}": (now & was).cast("int")}
    return out.withColumns(columns).drop("_s")


def career_moves(df: DataFrame, person: str, time: str, employer: str, role: str, system: str | None = None) -> DataFrame:
    """Sets of roles and employers of a person and period against the period before:
    ``internal`` (same employer, new role), ``external`` (new employer), ``lateral`` (new employer, no new role), ``within_system``.
    """
    sets = [F.array_sort(F.collect_set(employer)).alias("_e"), F.array_sort(F.collect_set(role)).alias("_r"), F.array_sort(F.collect_set(system or employer)).alias("_y")]
    p = df.groupBy(person, time).agg(*sets)
    for c in "ery":
        p = guarded_lag(p, [person], time, f"_{c}", f"_{c}0")
    both, new_e, new_r = F.col("_e0").isNotNull(), F.size(F.array_except("_e", "_e0")) > 0, F.size(F.array_except("_r", "_r0")) > 0
    return p.select(
        person, time, F.when(both, ((~new_e) & new_r).cast("int")).alias("internal"), F.when(both, (new_e & new_r).cast("int")).alias("external"),
        F.when(both, (new_e & ~new_r).cast("int")).alias("lateral"), F.when(both, (new_e & F.arrays_overlap("_y", "_y0")).cast("int")).alias("within_system"),
    )


def transition_probabilities(df: DataFrame, keys: Sequence[str], time: str, state: str) -> DataFrame:
    """P(state | state one period before), from guarded lags."""
    t = guarded_lag(df, keys, time, state, "prev").filter(F.col("prev").isNotNull() & F.col(state).isNotNull())
    n = t.groupBy("prev", F.col(state).alias("next")).agg(F.count("*").alias("n"))
    return n.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("prev")))


def sequences(df: DataFrame, person: str, time: str, state: str, rank: dict[str, int], periods: Sequence[int]) -> DataFrame:
    """Wide state sequences by relative period: the best-ranked state, ``Missing`` inside a person's span, ``Out of Sample`` beyond."""
    order = F.coalesce(*[F.when(F.col(state) == s, r) for s, r in rank.items()], F.lit(len(rank) + 1))
    one = df.withColumn("_k", F.row_number().over(Window.partitionBy(person, time).orderBy(order, state))).filter("_k = 1").select(person, time, state)
    full = densify(one, [person], time).withColumn(state, F.coalesce(state, F.lit("Missing")))
    full = full.withColumn("_t", F.col(time) - F.min(time).over(Window.partitionBy(person)))
    wide = full.groupBy(person).pivot("_t", list(periods)).agg(F.first(state))
    return wide.select(person, *[F.coalesce(F.col(str(p)), F.lit("Out of Sample")).alias(f"t{p}") for p in periods])
