"""Outcomes of panels: staffing, roles, careers, trajectories, ownership, event dummies and scaled effects."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import guarded_lag, longest_run
from .verbs import mode_per_group


def staffing_shares(df: DataFrame, keys: Sequence[str], tier: str, role: str, status: str, active: str = "Active", absent: str = "Position does not exist") -> DataFrame:
    """For each key and tier: roles that exist (any status but ``absent`` and null), those with someone in them, and their ``share`` (null if none exists); a role counts once, as active if any of its rows is."""
    r = df.groupBy(*keys, tier, role).agg(F.bool_or(F.col(status) == active).alias("_on"), F.bool_or(F.col(status) != absent).alias("_is"))
    out = r.groupBy(*keys, tier).agg(F.count(F.when(F.col("_is"), 1)).alias("n_exist"), F.count(F.when(F.col("_is") & F.col("_on"), 1)).alias("n_active"))
    return out.withColumn("share", F.try_divide(F.col("n_active").cast("double"), F.nullif(F.col("n_exist").cast("double"), F.lit(0.0))))


def people_per_role(df: DataFrame, keys: Sequence[str], person: str, role: str) -> DataFrame:
    """Different people, different roles and people for each role, of rows with both."""
    d = df.filter(F.col(person).isNotNull() & F.col(role).isNotNull())
    out = d.groupBy(*keys).agg(F.count_distinct(person).alias("people"), F.count_distinct(role).alias("roles"))
    return out.withColumn("per_role", F.col("people") / F.col("roles"))


def first_match(df: DataFrame, keys: Sequence[str], tests: Sequence[Column], name: str) -> DataFrame:
    """1 for the rows that fulfil the first test any row of their group fulfils, 0 for others: a later test serves only groups without an earlier one; null: not."""
    w = Window.partitionBy(*keys)
    held = [F.coalesce(t, F.lit(False)) for t in tests]
    out = df.withColumns({f"_t{k}": h for k, h in enumerate(held)})
    found = None
    for k in range(len(tests)):
        any_ = F.max(f"_t{k}").over(w)
        found = F.when(any_, F.col(f"_t{k}")) if found is None else found.when(any_, F.col(f"_t{k}"))
    return out.withColumn(name, found.otherwise(F.lit(False)).cast("int")).drop(*[f"_t{k}" for k in range(len(tests))])


def role_counts(df: DataFrame, keys: Sequence[str], role: str, most: int = 3) -> DataFrame:
    """``n_roles`` different roles of a key, and indicators ``roles_1`` to ``roles_<most>``, the last one for so many or more."""
    n = df.groupBy(*keys).agg(F.count_distinct(role).alias("n_roles"))
    capped = F.least(F.col("n_roles"), F.lit(most))
    return n.withColumns({f"roles_{k}": (capped == k).cast("int") for k in range(1, most + 1)})


def change_outcomes(df: DataFrame, keys: Sequence[str], time: str, holder: str, reach: int = 3) -> DataFrame:
    """``<holder>_lag1`` and so on (null unless just so many periods earlier), ``changed_within_<k>``: another holder than
    in one of the k periods before, null unless all of them are there and known; ``filled`` and ``vacated``: from null to a
    holder and back, against the period before.
    """
    out = df
    for k in range(1, reach + 1):
        out = guarded_lag(out, keys, time, holder, f"{holder}_lag{k}", k)
    w = Window.partitionBy(*keys).orderBy(time)
    for k in range(2, reach + 1):
        lags = [F.col(f"{holder}_lag{j}") for j in range(1, k + 1)]
        known = reduce(lambda a, b: a & b, [x.isNotNull() for x in lags]) & F.col(holder).isNotNull()
        out = out.withColumn(f"changed_within_{k}", F.when(known, reduce(lambda a, b: a | b, [x != F.col(holder) for x in lags]).cast("int")))
    there = F.lag(time).over(w) == F.col(time) - 1
    before = F.lag(holder).over(w).isNull()
    return out.withColumns({"filled": F.when(there, (before & F.col(holder).isNotNull()).cast("int")), "vacated": F.when(there, (~before & F.col(holder).isNull()).cast("int"))})


def moves(df: DataFrame, person: str, time: str, employer: str, role: str, system: str, consecutive: bool = True) -> DataFrame:
    """Moves of a person between periods: ``internal_promotion`` (no new employer, a new role), ``external_promotion``,
    ``lateral`` (new employer; with or without a new role), ``across_system`` (new employer, no system in common), ``gap`` periods.

    Against the period before if ``consecutive`` (null where it is missing), else against the last one that there is.
    """
    p = df.groupBy(person, time).agg(*[F.array_sort(F.collect_set(c)).alias(n) for c, n in ((employer, "_e"), (role, "_r"), (system, "_y"))])
    w = Window.partitionBy(person).orderBy(time)
    p = p.withColumns({f"{c}0": F.lag(c).over(w) for c in ("_e", "_r", "_y")} | {"gap": F.col(time) - F.lag(time).over(w)})
    there = F.col("gap") == 1 if consecutive else F.col("gap").isNotNull()
    new_e, new_r = F.size(F.array_except("_e", "_e0")) > 0, F.size(F.array_except("_r", "_r0")) > 0
    flag = lambda c: F.when(there, c.cast("int"))
    return p.select(person, time, "gap", flag(~new_e & new_r).alias("internal_promotion"), flag(new_e & new_r).alias("external_promotion"), flag(new_e & ~new_r).alias("lateral"), flag(new_e & ~F.arrays_overlap("_y", "_y0")).alias("across_system"))


def trajectories(df: DataFrame, keys: Sequence[str], time: str, size: str, system: str, flags: Sequence[str]) -> DataFrame:
    """What comes later for each row: ``exists_later``, the greatest later ``size`` as ``max_later``, ``same_system_later`` (every known later one is the row's), and ``<flag>_later`` (any); null without later rows, but ``exists_later``."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).cast("long")).rangeBetween(1, Window.unboundedFollowing)
    low, high = F.min(system).over(w), F.max(system).over(w)
    return df.withColumns({
        "exists_later": F.count(F.lit(1)).over(w) > 0, "max_later": F.max(size).over(w), "same_system_later": (low == F.col(system)) & (high == F.col(system)),
        **{f"{f}_later": F.max(F.col(f)).over(w) for f in flags},
    })


def ownership(df: DataFrame, id_col: str, time: str, system: str, campus: str, parent: str) -> DataFrame:
    """``owner`` and ``owner_from``: a row's own system; else the most frequent of its campus in the period; else its parent's in the period; else the most frequent of the id in all periods (ties: the smaller)."""
    c = mode_per_group(df.filter(F.col(campus).isNotNull()), [campus, time], system).select(campus, time, F.col("mode").alias("_c"))
    p = df.filter(F.col(system).isNotNull()).groupBy(F.col(id_col).alias(parent), time).agg(F.min(system).alias("_p"))
    m = mode_per_group(df, [id_col], system).select(id_col, F.col("mode").alias("_m"))
    out = df.join(c, [campus, time], "left").join(p, [parent, time], "left").join(m, id_col, "left")
    ways = {"own": system, "campus": "_c", "parent": "_p", "usual": "_m"}
    how = F.coalesce(*[F.when(F.col(v).isNotNull(), n) for n, v in ways.items()])
    return out.withColumn("owner", F.coalesce(*ways.values())).withColumn("owner_from", how).drop("_c", "_p", "_m")


def event_dummies(df: DataFrame, relative: str, reach: int, baseline: int = -1) -> DataFrame:
    """``lead<k>`` and ``lag<k>``: 0/1 for each relative time within ``reach``, ends joined, the baseline left out; rows without an event have 0 in all."""
    r = F.greatest(F.lit(-reach), F.least(F.lit(reach), F.col(relative)))
    name = lambda k: f"lead{-k}" if k < 0 else f"lag{k}"
    return df.withColumns({name(k): F.when(F.col(relative).isNotNull(), (r == k).cast("int")).otherwise(0) for k in range(-reach, reach + 1) if k != baseline})


def component_shares(effects: DataFrame, term: str, component: str, value: str, total: str) -> DataFrame:
    """Each component's value against that of the component named ``total`` at the same term; null where that is 0 or missing."""
    t = effects.filter(F.col(component) == total).select(term, F.col(value).alias("_t"))
    return effects.filter(F.col(component) != total).join(t, term, "left").withColumn("share", F.try_divide(F.col(value).cast("double"), F.nullif(F.col("_t").cast("double"), F.lit(0.0)))).drop("_t")


def scaled_effects(effects: DataFrame, means: DataFrame, outcome: str = "outcome", b: str = "b", se: str = "se", mean: str = "mean") -> DataFrame:
    """``relative`` and ``relative_se``: effects against the outcome's mean before the event; null where that is 0 or missing."""
    m = F.nullif(F.col("_m").cast("double"), F.lit(0.0))
    out = effects.join(means.select(outcome, F.col(mean).alias("_m")), outcome, "left")
    return out.withColumns({"relative": F.try_divide(F.col(b), m), "relative_se": F.try_divide(F.col(se), F.abs(m))}).drop("_m")


def membership_shares(df: DataFrame, person: str, group: str, condition: Column) -> DataFrame:
    """For each group: people, and the shares of those who ``ever``, ``only`` and not always (``both``) fulfil a condition over all of their rows."""
    held = F.coalesce(condition, F.lit(False))
    per = df.groupBy(person).agg(F.max(held).alias("_ever"), F.min(held).alias("_only"))
    d = df.select(group, person).distinct().join(per, person)
    part = lambda c: F.avg(c.cast("double"))
    return d.groupBy(group).agg(F.count("*").alias("people"), part(F.col("_ever")).alias("ever"), part(F.col("_only")).alias("only"), part(F.col("_ever") & ~F.col("_only")).alias("both"))


def joint_run(history: DataFrame, pairs: DataFrame, id_col: str, time: str) -> DataFrame:
    """The most consecutive periods in which either id of a pair is seen: ``longest``."""
    h = history.select(F.col(id_col).alias("_id"), time).distinct()
    p = pairs.select("id1", "id2").distinct().withColumn("_id", F.explode(F.array("id1", "id2")))
    return longest_run(p.join(h, "_id").select("id1", "id2", time), ["id1", "id2"], time)


def slopes_by_role(df: DataFrame, role: str, x: str, y: str, factor: str, least: int = 10, z: float = 1.96) -> DataFrame:
    """For each role the slope of y on x with a fixed effect of ``factor``: ``slope``, ``se``, ``low``, ``high``, ``n``; roles under ``least`` rows are skipped, a constant x within the factor gives null."""
    d = df.select(role, factor, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter("_x is not null and _y is not null")
    cell = d.groupBy(role, factor).agg(F.count("*").alias("n"), F.regr_sxx("_y", "_x").alias("xx"), F.regr_syy("_y", "_x").alias("yy"), F.regr_sxy("_y", "_x").alias("xy"))
    s = cell.groupBy(role).agg(F.sum("n").alias("n"), F.count("*").alias("_cells"), F.sum("xx").alias("_xx"), F.sum("yy").alias("_yy"), F.sum("xy").alias("_xy")).filter(F.col("n") >= least)
    ok = F.col("_xx") > 0
    free = F.col("n") - F.col("_cells") - 1
    s = s.withColumn("slope", F.when(ok, F.col("_xy") / F.col("_xx")))
    s = s.withColumn("se", F.when(ok & (free > 0), F.sqrt(F.greatest(F.lit(0.0), F.col("_yy") - F.col("slope") * F.col("_xy")) / free / F.col("_xx"))))
    return s.select(role, "n", "slope", "se", (F.col("slope") - z * F.col("se")).alias("low"), (F.col("slope") + z * F.col("se")).alias("high"))
