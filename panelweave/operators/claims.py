"""Which entity is an organisation's own: claims settled in ordered steps, where later steps read, close and overturn what earlier ones said.

A claim is a row (``owner``, ``id``, ``period``): an entity that may be the owner
in that period, with ``kind``, ``system`` and how alike both are (``sim`` by name,
``clean_sim`` by name without common words, ``near_sim`` by address, ``same_name``,
``same_city``).  Its ``value`` is null (open), 0 (refused) or the owner accepted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import drop_words, jaro_winkler
from .graphs import stored

#: Words without weight in an organisation's name.
COMMON_WORDS = ("st", "saint", "hospital", "center", "ctr", "health", "hlth", "system")


@dataclass
class Step:
    """``flags``: for groups of these keys, named aggregates; ``value``: the new value; conditions are SQL that any engine reads.

    ``changes`` is false for steps that only refuse.  With ``around`` the flags ``before`` and ``after`` are the id's nearest values by period, its own included.
    """

    name: str
    flags: list[tuple[tuple[str, ...], dict[str, str]]]
    value: str
    around: bool = False
    changes: bool = True


_GROUP = ("owner", "period")
_EMPTY = {"empty": "bool_and(value is null or value <> owner)"}
_ALONE = _EMPTY | {"ids": "count(distinct id)"}
_MODAL_N = "sum(case when value = owner then 1 else 0 end)"


def _close(name: str) -> Step:
    """An owner that has its entity in a period refuses the others that are open."""
    return Step(name, [(_GROUP, {"had": "bool_or(value is not null and value = owner)"})], "case when had and value is null then 0 else value end", changes=False)


#: The steps in their order, thresholds included.
STEPS: list[Step] = [
    Step("second kind by name", [(_GROUP, {"n": "sum(case when same_name and kind = 2 then 1 else 0 end)"})], "case when value is not null then value when n = 1 and same_name and kind = 2 then owner when n = 1 then 0 end"),
    Step("second kind by city", [(_GROUP, {"n": "sum(case when same_city and kind = 2 then 1 else 0 end)", "untouched": "bool_and(value is null)"})], "case when not untouched then value when n = 1 and same_city and kind = 2 and sim >= 0.75 then owner when n = 1 then 0 end"),
    _close("close 1"),
    Step("only second kind", [(("owner",), {"n": "count(distinct case when kind = 2 then id end)"}), (("owner", "id"), {"has": "bool_or(kind = 2)"})], "case when value is null and n = 1 and has and sim >= 0.85 then owner else value end"),
    _close("close 2"),
    Step(
        "best of both kinds", [(_GROUP, {"most": "max(case when sim >= 0.85 then sim end)", "most_of_kinds": "max(case when sim >= 0.85 and kind in (1, 2) then sim end)"}), ((*_GROUP, "most_of_kinds"), {"bests": "count(distinct case when sim >= 0.85 and kind in (1, 2) and sim = most_of_kinds then id end)"})],
        "case when value is null and bests = 1 and kind in (1, 2) and sim >= 0.85 and sim = most_of_kinds then owner when value is null and sim >= 0.85 and sim < most then 0 else value end",
    ),
    _close("close 3"),
    Step("alone and alike", [(_GROUP, _ALONE)], "case when empty and ids = 1 and (kind <= 3 or kind = 6) and sim >= 0.85 then owner else value end"),
    _close("close 4"),
    Step(
        "only one of a system", [(_GROUP, _EMPTY), (("system",), {"named": "bool_or(sim >= 0.95 and kind in (6, 8))", **{f"k{k}": f"count(distinct case when kind = {k} then id end)" for k in (1, 2, 3)}})],
        "case when empty and named and ((k1 = 1 and kind = 1) or (k1 = 0 and k2 = 1 and kind = 2) or (k1 = 0 and k2 = 0 and k3 = 1 and kind = 3)) then owner else value end",
    ),
    Step(
        "usual entity of several", [(("value", "period"), {"takers": "count(distinct case when value = owner then id end)"}), (("value",), {"all_rows": "count(*)"}), (("value", "id"), {"own_rows": "count(*)"}), (("value", "own_rows"), {"alike": "count(distinct id)"}), (("value",), {"top": "max(own_rows)"})],
        "case when value is null or value = 0 or takers <= 1 then value when own_rows = top and alike = 1 and top * 4 >= all_rows * 3 then value else 0 end",
    ),
    Step("between equal neighbours", [(_GROUP, _ALONE)], "case when value is null and empty and ids = 1 and before_value = after_value then before_value else value end", around=True),
    Step("beside a neighbour", [(_GROUP, _ALONE)], "case when value is null and empty and ids = 1 and (after_value is null or before_value = after_value) then before_value when value is null and empty and ids = 1 and before_value is null then after_value else value end", around=True),
    Step(
        "alike without common words", [(_GROUP, _EMPTY | {"fits1": "count(distinct case when kind = 1 and (clean_sim >= 0.95 or (clean_sim >= 0.875 and near_sim >= 0.875)) then id end)", "ids1": "count(distinct case when kind = 1 then id end)", "ids": "count(distinct id)", "fits": "count(distinct case when clean_sim >= 0.95 or (clean_sim >= 0.875 and near_sim >= 0.875) then id end)"})],
        "case when empty and ids1 = 1 and fits1 = 1 and kind = 1 then owner when empty and ids = 1 and fits = 1 then owner else value end",
    ),
    Step(
        "usual entity of the owner", [(_GROUP, _EMPTY), (("owner",), {"all_rows": _MODAL_N}), (("owner", "id"), {"own_rows": _MODAL_N}), (("owner", "own_rows"), {"alike": "count(distinct id)"}), (("owner",), {"top": "max(own_rows)"})],
        "case when empty and top > 0 and own_rows = top and alike = 1 and top * 4 >= all_rows * 3 then owner else value end",
    ),
]


def claim_scores(claims: DataFrame) -> DataFrame:
    """``sim``, ``clean_sim``, ``near_sim``, ``same_name`` and ``same_city`` of claims with ``name city address`` and ``owner_name owner_city owner_address``; different pairs are scored once, nulls are alike to nothing."""
    bare = lambda c: drop_words(F.col(c), list(COMMON_WORDS))
    out = claims.withColumns({"_clean": bare("name"), "_owner_clean": bare("owner_name")})
    for a, b, name in (("name", "owner_name", "sim"), ("_clean", "_owner_clean", "clean_sim"), ("address", "owner_address", "near_sim")):
        pairs = out.select(a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
        out = out.join(pairs.withColumn(name, jaro_winkler(F.col(a), F.col(b))), [a, b], "left")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return out.withColumns({"same_name": same("name", "owner_name"), "same_city": same("city", "owner_city")}).drop("_clean", "_owner_clean")


def _words(*texts: str) -> set[str]:
    return set(re.findall(r"\w+", " ".join(texts)))


def read_by(steps: list[Step], columns: list[str]) -> list[str]:
    """``id``, ``period``, ``owner`` and those of ``columns`` that a step names, in their order."""
    named = {"id", "period", "owner"}.union(*[_words(s.value, *[x for keys, flags in s.flags for x in (*keys, *flags.values())]) for s in steps])
    return [c for c in columns if c in named]


def settle_claims(claims: DataFrame, steps: list[Step] = STEPS) -> DataFrame:
    """``value`` and ``step``, the last step that gave it another value, of each claim; one claim for an id and period.

    All columns of a claim are written at each step, so it should have no more than
    ``id``, ``period``, ``owner`` and what the steps read (``read_by``).

    Each group's flags are summed and joined back, so no group is held by a task;
    null systems are no system.  A step begins with a durable table (one that only
    closes goes on with that of the step before), which all flags that don't need
    each other are summed from; flags that a table has written already need no new one.
    """
    value = F.col("value") if "value" in claims.columns else F.lit(None)
    out = claims.withColumn("value", value.cast("long")).withColumn("step", F.lit(None).cast("string"))
    for k, step in enumerate(steps):
        if k == 0 or step.changes:
            out = stored(out)
        start = out
        made: list[str] = []
        for keys, flags in step.flags:
            if _words(*keys, *flags.values()) & set(made) - set(start.columns):
                out = start = stored(out)
            per = start.groupBy(*keys).agg(*[F.expr(e).alias(name) for name, e in flags.items()])
            per = per.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(keys)})
            out = out.join(per, [F.col(c).eqNullSafe(F.col(f"_k{i}")) if c != "system" else F.col(c) == F.col(f"_k{i}") for i, c in enumerate(keys)], "left").drop(*[f"_k{i}" for i in range(len(keys))])
            made += flags
        if step.around:
            w = Window.partitionBy("id").orderBy("period")
            out = out.withColumn("before_value", F.last("value", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after_value", F.first("value", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
            made += ["before_value", "after_value"]
        out = out.withColumn("_new", F.expr(step.value).cast("long"))
        out = out.withColumn("step", F.when(F.col("_new").eqNullSafe(F.col("value")), F.col("step")).otherwise(step.name)).withColumn("value", F.col("_new")).drop("_new", *made)
    return stored(out)


def settle_sql(claims: str, steps: list[Step] = STEPS) -> str:
    """CTEs that unroll the steps over a relation of scored claims; the last one is ``settled``."""
    parts, before = [f"c0 as (select *, null::bigint as value, null::varchar as step from {claims})"], "c0"
    for k, step in enumerate(steps, 1):
        made: list[str] = []
        for j, (keys, flags) in enumerate(step.flags):
            per = f"(select {', '.join(f'{c} as k{i}' for i, c in enumerate(keys))}, {', '.join(f'{e} as {name}' for name, e in flags.items())} from {before} group by {', '.join(keys)})"
            on = " and ".join(f"l.{c} = g.k{i}" if c == "system" else f"l.{c} is not distinct from g.k{i}" for i, c in enumerate(keys))
            parts.append(f"c{k}_{j} as materialized (select l.*, {', '.join(f'g.{name}' for name in flags)} from {before} l left join {per} g on {on})")
            before, made = f"c{k}_{j}", [*made, *flags]
        if step.around:
            parts.append(f"c{k}_a as (select *, last_value(value ignore nulls) over (partition by id order by period rows between unbounded preceding and current row) as before_value, first_value(value ignore nulls) over (partition by id order by period rows between current row and unbounded following) as after_value from {before})")
            before, made = f"c{k}_a", [*made, "before_value", "after_value"]
        new = f"({step.value})::bigint"
        parts.append(f"c{k} as materialized (select * exclude ({', '.join([*made, 'value', 'step'])}), {new} as value, case when {new} is not distinct from value then step else '{step.name}' end as step from {before})")
        before = f"c{k}"
    return ", ".join([*parts, f"settled as (select * from {before})"])
