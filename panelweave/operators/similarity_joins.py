"""Joins on similar texts that lose no pair and need no blocking key: by letters that a pair must have in common, or an index that is proven to hold every pair within the bound.

Both compare different texts only, each pair once; rows come back by equi joins.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import alignment_distance, deletions, winkler_pairs
from .joins import CHUNK_ROWS, JOIN_TASKS, chunks, spread_join

#: Winkler's weight of a common first letter, the Jaro similarity over which it counts, the most letters that do.
WEIGHT, BOOST_OVER, FIRST_LETTERS = 0.1, 0.7, 4
#: Texts of a chunk, parts of a side's chunks.
TEXTS, GRID = 1000, 8
_EPS = 1e-9


def least_jaro(least: float, common: int, weight: float = WEIGHT) -> float:
    """The Jaro similarity that a pair with ``common`` equal first letters needs to reach a Jaro-Winkler similarity of ``least``."""
    boosted = (least - common * weight) / (1 - common * weight)
    return max(min(BOOST_OVER, least), boosted)


def letter_bits(texts: np.ndarray) -> np.ndarray:
    """64 bits of each text: one by each letter and its number among equal ones.  A bit that only one text has is a letter that the other lacks."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for k, t in enumerate(texts):
        turns: dict[str, int] = {}
        bits = 0
        for ch in t:
            turn = turns[ch] = turns.get(ch, 0) + 1
            bits |= 1 << (ord(ch) + 29 * (turn - 1)) % 64
        out[k] = bits
    return out


def _similar(a: np.ndarray, b: np.ndarray, least: float, weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs of two chunks' texts that reach ``least``, and their similarity; a pair that has too few letters in common by its bits is not compared."""
    n, m = (np.array([len(t) for t in side], dtype=np.float64) for side in (a, b))
    p, q = letter_bits(a), letter_bits(b)
    most = np.minimum(n[:, None] - np.bitwise_count(p[:, None] & ~q), m - np.bitwise_count(q & ~p[:, None]))
    # Pairs with equal first letters need fewer of the rest; the fewest that any pair needs.
    jaro = least_jaro(least, FIRST_LETTERS if weight else 0, weight)
    with np.errstate(divide="ignore", invalid="ignore"):
        needed = np.maximum(1, np.ceil((3 * jaro - 1) * n[:, None] * m / (n[:, None] + m) - _EPS))
    i, j = np.nonzero((most >= needed) | ((n[:, None] == 0) & (m == 0)))
    s = winkler_pairs(a, b, i, j, weight, BOOST_OVER) if len(i) else np.zeros(0)
    near = s >= least
    return i[near], j[near], s[near]


def similar_texts(left: DataFrame, right: DataFrame, a: str, b: str, least: float, weight: float = WEIGHT) -> DataFrame:
    """``_a``, ``_b``, ``similarity``: all pairs of different values of both columns with a Jaro-Winkler similarity of ``least`` at least.

    ``weight`` 0 gives plain Jaro.  Nulls are in no pair; empty texts pair with
    each other only.  A task meets a chunk of each side at a time, so what meets
    without being similar is neither kept nor shuffled.
    """
    if least < 0.5:
        raise ValueError("under 0.5 shared letters bound nothing")
    x = left.select(F.col(a).alias("_a")).filter("_a is not null").distinct()
    y = right.select(F.col(b).alias("_b")).filter("_b is not null").distinct()
    # Chunks are dealt into a grid, in which each meets all of the other side: a chunk is sent GRID times, however many there are.
    part, all_ = F.col("_chunk") % GRID, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(GRID - 1).cast("long")))
    xs = chunks(x, [], "_a", "_x", TEXTS).select("_x", part.alias("_p"), all_.alias("_q"))
    ys = chunks(y, [], "_b", "_y", TEXTS).select("_y", part.alias("_q"), all_.alias("_p"))
    met = spread_join(xs, ys, ["_p", "_q"])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = (batch.column(c)[k].values.field(0).to_numpy(zero_copy_only=False) for c in ("_x", "_y"))
                i, j, s = _similar(x, y, least, weight)
                yield pa.RecordBatch.from_arrays([pa.array(x[i], pa.string()), pa.array(y[j], pa.string()), pa.array(s, pa.float64())], ["_a", "_b", "similarity"])

    return met.select("_x", "_y").mapInArrow(run, "_a string, _b string, similarity double")


def similarity_left_join(left: DataFrame, right: DataFrame, a: str, b: str, most: float, weight: float = WEIGHT) -> DataFrame:
    """All left rows with all right rows whose Jaro-Winkler distance is ``most`` at most, nulls where none is."""
    pairs = similar_texts(left, right, a, b, 1.0 - most, weight)
    matched = pairs.join(right, F.col("_b") == F.col(b)).drop("_b")
    return left.join(matched, F.col(a) == F.col("_a"), "left").drop("_a")


def _within(met: DataFrame, a: str, b: str, most: int, name: str) -> DataFrame:
    """Rows whose texts are within ``most`` edits; exploded, as a plain column would be worked out again for the filter."""
    return met.withColumn(name, F.explode(F.array(alignment_distance(F.col(a), F.col(b))))).filter(F.col(name) <= most)


def aligned_texts(left: DataFrame, right: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """``_a``, ``_b``, ``distance``: all pairs of different values within ``most`` edits, a swap of neighbours being one.

    The index is what is left of a text with ``most`` letters or fewer taken out:
    any such pair has one of these texts in common, and is kept at the least of
    them, so what meets is compared in its task and only near pairs leave it.
    """
    x = left.select(F.col(a).alias("_a")).filter("_a is not null").distinct().withColumn("_k", F.explode(deletions(F.col("_a"), most)))
    y = right.select(F.col(b).alias("_b")).filter("_b is not null").distinct().withColumn("_k", F.explode(deletions(F.col("_b"), most)))
    least = F.array_min(F.array_intersect(deletions(F.col("_a"), most), deletions(F.col("_b"), most)))
    met = x.join(y.hint("merge"), "_k").filter(F.col("_k") == least).select("_a", "_b")
    return _within(met, "_a", "_b", most, "distance")


def aligned_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, a: Sequence[str], b: Sequence[str], most: int = 2) -> DataFrame:
    """Pairs of ids whose two columns are each within ``most`` edits (see ``aligned_texts``), with both distances; a null column makes no pair.

    Near first values bring their chunks of second values together, which are
    compared where they meet; so a frequent first value is many chunks in many
    tasks.  The column with more different values should come first.  Ids of a
    frequent pair of values come back in parts of some CHUNK_ROWS, each in a task
    of its own.
    """
    def dealt(df: DataFrame, id_col: str, columns: Sequence[str], s: str) -> tuple[DataFrame, DataFrame]:
        """Different values with their number of parts, rows with their part."""
        rows = df.select(id_col, *[F.col(c).alias(f"_{s}{i}") for i, c in enumerate(columns)]).filter(f"_{s}0 is not null and _{s}1 is not null")
        on = [f"_{s}0", f"_{s}1"]
        values = rows.groupBy(*on).agg(F.ceil(F.count("*") / CHUNK_ROWS).alias(f"_{s}n"))
        return values, rows.join(values.hint("merge"), on).withColumn(f"_{s}p", F.pmod(F.xxhash64(id_col), F.col(f"_{s}n"))).drop(f"_{s}n")

    (xs, x), (ys, y) = dealt(left, left_id, a, "x"), dealt(right, right_id, b, "y")
    firsts = aligned_texts(xs, ys, "_x0", "_y0", most).select(F.col("_a").alias("_x0"), F.col("_b").alias("_y0"), F.col("distance").alias("distance0"))
    held = lambda values, s: chunks(values, [f"_{s}0"], f"_{s}1", f"_{s}", CHUNK_ROWS).withColumnRenamed("_chunk", f"_{s}c")
    met = held(xs, "x").join(firsts.hint("merge"), "_x0").join(held(ys, "y").hint("merge"), "_y0").repartition(JOIN_TASKS, "_x0", "_xc", "_y0", "_yc")
    second = met.withColumn("_x", F.explode("_x")).withColumn("_y", F.explode("_y")).select("_x0", "_y0", "distance0", "_x.*", "_y.*").filter(F.levenshtein("_x1", "_y1", 2 * most) >= 0)
    parts = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    pairs = _within(second, "_x1", "_y1", most, "distance1").withColumn("_xp", parts("_xn")).withColumn("_yp", parts("_yn")).drop("_xn", "_yn")
    found = spread_join(pairs, x, ["_x0", "_x1", "_xp"]).select(left_id, "_y0", "_y1", "_yp", "distance0", "distance1")
    return spread_join(found, y, ["_y0", "_y1", "_yp"]).select(left_id, right_id, "distance0", "distance1")
