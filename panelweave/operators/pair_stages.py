"""Rule stages for candidate pairs of person records: ordered tables of labelled conditions.

A stage is a list of rules (label, condition); conditions are SQL over the pair's
features, so one table serves a DataFrame and any SQL engine.  A null condition
doesn't hold.  Stages run in ORDER; a pair takes the label of the first rule that
holds, and what no rule decides stays UNDECIDED.

Features: ``title name entity system address zip state`` (numbers of shared
values), ``states`` (different states of both), ``first_lev last_lev first_jw
last_jw`` and ``old_...`` of the names as recorded, ``nick`` (names in one
nickname row), ``both_genders both_male``, ``last_n1 last_n2`` (ids with that last
name), ``first_freq last_freq``, ``miles`` and ``apart_years`` (from years in
different states), ``top`` (either held a top role), ``p_same p_diff`` (least
transition probability within and between employers), ``pairs1 pairs2 linked1
linked2`` (open pairs of each id, whether it is confirmed elsewhere), ``rare_last``
and ``rare_first`` ``1 2`` (names with two counterparts at most), ``overlap``
(years in common), ``one_year1 one_year2``, ``mismatch`` (facility types), ``big``
(a shared state is large), ``head`` (heads a facility), ``often`` (frequent last name).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from .joins import met_chunks
from .linkage import DIFFERENT, SAME, apply_rules
from .pair_chunks import common_values, partner_lists

_ANY = "(name > 0 or entity > 0 or address > 0 or zip > 0)"
_FIRST = "(first_lev < 2 or first_jw > 0.8)"
_LAST = "(last_lev < 2 or last_jw > 0.8)"
_UNLIKE_FIRST = "(first_lev >= 3 or first_jw <= 0.5)"
_UNLIKE_LAST = "(last_lev >= 3 or last_jw <= 0.5)"
_NEAR_EQUAL = "(first_lev = 0 or old_first_jw > 0.925) and (last_lev = 0 or old_last_jw > 0.925)"
_DIFFERS = "(first_jw < 0.8 or first_lev > 1 or last_jw < 0.8 or last_lev > 1)"
_RARE = "(last_n1 <= 2 or last_n2 <= 2)"


def _low(p: float) -> str:
    """Either probability is known and low."""
    return f"(p_same < {p} or p_diff < {p})"


def _unseen(p: float) -> str:
    """Both probabilities are low or unknown."""
    return f"(p_same is null or p_same < {p}) and (p_diff is null or p_diff < {p})"


#: Thresholds of the ten stages.
STAGES: dict[int, list[tuple[str, str]]] = {
    1: [
        (SAME, f"{_ANY} and {_FIRST} and last_n1 <= 8 and last_n2 <= 8 and {_LAST}"),
        (SAME, f"(states = 1 or system > 0) and title > 0 and {_FIRST} and {_LAST}"),
        (SAME, f"nick and {_ANY} and (state > 0 or system > 0)"),
        (SAME, "last_lev = 0 and nick and (state > 0 or system > 0)"),
        (DIFFERENT, f"{_UNLIKE_FIRST} and not nick and ({_UNLIKE_LAST} or state = 0)"),
    ],
    2: [
        (DIFFERENT, "pairs1 <= 2 and not linked1 and pairs2 <= 2 and not linked2"),
        (DIFFERENT, "(pairs1 <= 1 and not linked1) or (pairs2 <= 1 and not linked2)"),
    ],
    3: [(DIFFERENT, "miles > 1000 and apart_years > 1 and not top"), (DIFFERENT, "miles > 1000 and apart_years > 2")],
    4: [(SAME, f"((rare_last1 and rare_last2) or (rare_first1 and rare_first2)) and {_NEAR_EQUAL}")],
    5: [
        (DIFFERENT, "p_same < 0.01 or p_diff < 0.01"),
        (DIFFERENT, "p_same < 0.05 and ((first_lev > 3 and not nick) or last_lev > 3 or last_jw < 0.7)"),
        (DIFFERENT, "p_diff < 0.05 and (((first_lev > 3 or first_jw < 0.7) and not nick) or last_lev > 3 or last_jw < 0.7)"),
        (DIFFERENT, f"{_low(0.05)} and states > 1 and {_DIFFERS}"),
        (DIFFERENT, f"{_low(0.2)} and (states > 1 or both_genders) and {_DIFFERS} and not nick"),
    ],
    6: [
        (DIFFERENT, f"{_RARE} and first_jw < 0.7 and not nick"),
        (DIFFERENT, f"{_RARE} and last_jw < 0.7 and miles >= 500 and ((apart_years >= 2 and not top) or apart_years >= 3)"),
        (SAME, "first_lev = 0 and last_lev = 0 and system > 0"),
        (SAME, "(first_jw >= 0.8 or nick) and last_jw >= 0.8 and (address > 0 or entity > 0 or name > 0)"),
        (SAME, f"(first_jw > 0.95 or nick) and last_jw > 0.95 and {_ANY}"),
        (SAME, "(last_n1 <= 3 or last_n2 <= 3) and last_jw >= 0.925 and (first_jw >= 0.925 or nick)"),
        (SAME, f"{_ANY} and last_lev = 0 and first_jw >= 0.5"),
        (SAME, f"old_first_lev = 0 and old_last_lev = 0 and (first_freq <= 100 or last_freq <= 200 or (state > 0 and title > 0) or (state > 0 and (last_freq <= 500 or first_freq <= 200)) or (apart_years <= 1 and title > 0 and last_freq <= 2000 and first_freq <= 2000) or system > 0 or {_ANY})"),
    ],
    7: [
        (DIFFERENT, f"{_low(0.25)} and first_jw < 0.5 and not nick"),
        (DIFFERENT, f"{_low(0.25)} and (rare_last1 or rare_last2) and first_jw < 0.75 and not nick"),
    ],
    8: [
        (DIFFERENT, "p_same is null and p_diff is null and title = 0 and (last_jw < 0.7 or (system = 0 and state = 0 and last_lev >= 3))"),
        (DIFFERENT, "((p_same is null and p_diff < 0.05) or (p_diff is null and p_same < 0.05)) and title = 0 and last_jw < 0.9 and (first_jw >= 0.9 or nick) and (state > 0 or system > 0)"),
        (DIFFERENT, "miles >= 500 and not nick and first_jw <= 0.7 and (not top or apart_years >= 3)"),
    ],
    9: [
        (DIFFERENT, "both_male and last_lev >= 3 and system = 0 and entity = 0 and zip = 0"),
        (DIFFERENT, "first_jw < 0.65 and not nick"),
        (DIFFERENT, "mismatch and ((first_jw < 0.9 and not nick) or (miles > 500 and (not top or apart_years >= 3)))"),
        (DIFFERENT, f"{_unseen(0.025)} and title = 0"),
        (DIFFERENT, "overlap > 1 and (p_same is null or p_same < 0.05) and title = 0"),
        (SAME, "first_jw >= 0.9 and last_jw >= 0.9 and title > 0 and state > 0 and not big"),
        (DIFFERENT, f"title = 0 and both_male and last_jw < 0.7 and {_unseen(0.1)}"),
        (DIFFERENT, f"overlap >= 4 and {_unseen(0.1)} and title = 0"),
        (DIFFERENT, "miles >= 500 and overlap >= 4 and state = 0 and system = 0 and (not top or apart_years >= 3)"),
        (DIFFERENT, f"{_unseen(0.05)} and title = 0 and first_jw > 0.9 and last_jw > 0.9 and state = 0 and not head"),
        (DIFFERENT, "p_same < 0.1 and p_diff < 0.1 and state = 0 and title = 0"),
        (DIFFERENT, "first_lev + last_lev <= 1 and state > 0 and title = 1 and not head"),
        (DIFFERENT, "(pairs1 <= 1 and not linked2) or (pairs2 <= 1 and not linked1)"),
        (DIFFERENT, "one_year1 or one_year2"),
        (DIFFERENT, "often and (p_diff <= 0.1 or p_diff is null) and (p_same <= 0.1 or p_same is null) and title = 0 and state = 0 and system = 0"),
        (DIFFERENT, "p_diff <= 0.05 and p_same < 0.2 and state = 0 and title = 0"),
    ],
    10: [(SAME, f"{_FIRST} and {_LAST} and last_n1 <= 500 and last_n2 <= 500 and ((title > 0 and state > 0 and first_freq <= 75) or (state > 0 and last_freq <= 50))")],
}

#: Fixed value: the stages in the order of the first pass; a stage may come twice, as ids are confirmed in between.
ORDER = (1, 2, 10, 3, 4, 6, 5, 7, 2, 8, 9)


def staged_rules(order: tuple[int, ...] = ORDER, stages: dict[int, list[tuple[str, str]]] = STAGES) -> list[list[tuple[str, Column]]]:
    return [[(label, F.expr(condition)) for label, condition in stages[k]] for k in order]


def label_pairs(pairs: DataFrame, order: tuple[int, ...] = ORDER, stages: dict[int, list[tuple[str, str]]] = STAGES) -> DataFrame:
    """``label`` and ``stage``, the place in ``order`` of the stage that decided (null if none did)."""
    return apply_rules(pairs, staged_rules(order, stages))


def stage_sql(order: tuple[int, ...] = ORDER, stages: dict[int, list[tuple[str, str]]] = STAGES) -> tuple[str, str]:
    """The same as two CASE expressions: label and place."""
    rules = [(at, label, condition) for at, k in enumerate(order, 1) for label, condition in stages[k]]
    label = " ".join(f"when {c} then '{v}'" for _, v, c in rules)
    place = " ".join(f"when {c} then {at}" for at, _, c in rules)
    return f"case {label} else 'UNDECIDED' end", f"case {place} end"


def post_features(pairs: DataFrame, persons: DataFrame, id_col: str, time: str, title: str, top_titles: list[str], shared: list[str]) -> DataFrame:
    """Flags of each shared set, ``total_shared``, ``overlap`` (periods in common) and ``top`` (either ever held a top title).

    Null periods and titles don't count; pairs of unknown ids have overlap 0 and no top title.
    """
    one = persons.groupBy(id_col).agg(F.collect_set(time).alias("_t"), F.coalesce(F.bool_or(F.col(title).isin(top_titles)), F.lit(False)).alias("_top"))
    side = lambda k: one.select(F.col(id_col).alias(f"id{k}"), F.col("_t").alias(f"_t{k}"), F.col("_top").alias(f"_top{k}"))
    p = pairs.join(side(1), "id1", "left").join(side(2), "id2", "left")
    flags = {f"{c}_flag": (F.coalesce(F.col(c), F.lit(0)) > 0).cast("int") for c in shared}
    p = p.withColumns(flags | {
        "overlap": F.coalesce(F.size(F.array_intersect("_t1", "_t2")), F.lit(0)),
        "top": F.coalesce("_top1", F.lit(False)) | F.coalesce("_top2", F.lit(False)),
    })
    return p.withColumn("total_shared", sum((F.col(f"{c}_flag") for c in shared), F.lit(0))).drop("_t1", "_t2", "_top1", "_top2")


def residual_pairs(pairs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Pairs that weren't dropped, whichever way round, and ``open1``, ``open2``: how many of them each id is in."""
    key = lambda df: df.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).distinct()
    rest = key(pairs).join(key(dropped), ["id1", "id2"], "left_anti")
    n = rest.select(F.explode(F.array("id1", "id2")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return rest.join(n.select(F.col("id").alias("id1"), F.col("n").alias("open1")), "id1").join(n.select(F.col("id").alias("id2"), F.col("n").alias("open2")), "id2").select("id1", "id2", "open1", "open2")


def second_pass(pairs: DataFrame, seen: DataFrame, block: list[str]) -> DataFrame:
    """Pairs of new blocks that earlier blocks didn't have, each once with its smallest block."""
    p = pairs.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), *block)
    s = seen.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).distinct()
    return p.join(s, ["id1", "id2"], "left_anti").groupBy("id1", "id2").agg(F.min(F.struct(*block)).alias("_b")).select("id1", "id2", "_b.*")


#: Fixed value: ids of a chunk of ``second_blocks``.
BLOCK_CHUNK = 1000


def second_blocks(df: DataFrame, id_col: str, first: list[str], second: list[str]) -> DataFrame:
    """Pairs id1 < id2 that share a block of ``second`` but none of ``first``, each once with its smallest block.

    An id's blocks go with it, so the pairs of the first blocks are never made and
    no pair is shuffled.  Chunks of a block's ids meet, and a task has the pairs of
    two chunks at a time, as a list for each id.  Blocks with a null key have no pairs.
    """
    whole = lambda b: F.when(F.forall(F.array(*[F.col(c).isNotNull() for c in b]), lambda x: x), F.struct(*b))
    texts = lambda blocks: F.transform(blocks, lambda b: F.to_json(b))
    ids = df.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.collect_set(whole(first)).alias("_f"), F.array_sort(F.collect_set(whole(second))).alias("_s"))
    each = ids.select("_id", texts(F.col("_f")).alias("_f"), "_s", F.posexplode("_s").alias("_at", "_b")).select("_id", "_f", texts(F.slice("_s", F.lit(1), F.col("_at"))).alias("_e"), "_b.*")
    met = met_chunks(each, second, "_id", BLOCK_CHUNK)
    kind, keys = df.schema[id_col].dataType, [df.schema[c] for c in second]
    schema = StructType([*keys, StructField("id1", kind), StructField("_id2", ArrayType(kind))])
    found = met.select(*second, "_chunk1", "_chunk2", "_rows1", "_rows2").mapInArrow(_new_pairs(schema), schema)
    return found.select("id1", F.explode("_id2").alias("id2"), *second)


def _new_pairs(schema: StructType):
    names = schema.fieldNames()

    def run(batches):
        for batch in batches:
            chunk = {c: batch.column(batch.schema.get_field_index(c)) for c in ("_chunk1", "_chunk2", "_rows1", "_rows2")}
            for n in range(batch.num_rows):
                a, b = chunk["_rows1"][n].values, chunk["_rows2"][n].values
                ids = [side.field("_id") for side in (a, b)]
                code = pa.concat_arrays(ids).to_numpy(zero_copy_only=False)
                code = np.unique(code, return_inverse=True)[1]
                new = (common_values(a.field("_f"), b.field("_f")) == 0) & (common_values(a.field("_e"), b.field("_e")) == 0)
                less = code[: len(a), None] < code[None, len(a) :]
                found = [partner_lists(*ids, new & less)]
                if chunk["_chunk1"][n].as_py() != chunk["_chunk2"][n].as_py():
                    found.append(partner_lists(*ids[::-1], (new & ~less).T))  # chunks of one block have no id in common
                for one, two in found:
                    keys = [pa.repeat(batch.column(k)[n], len(one)) for k in range(len(names) - 2)]
                    yield pa.RecordBatch.from_arrays([*keys, one, two], names)

    return run
