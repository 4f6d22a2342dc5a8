"""Labelled training rows: a bounded, documented sample that never holds a held-out row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most rows that a classifier is fitted on, one for each labelled id; which ones is set by a hash of the id.
MOST_LABELS = 20_000


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, most: int = MOST_LABELS) -> DataFrame:
    """``doc_id``, ``text``, ``label`` of the sample, one row for each id; ids with labels of both kinds are left out.

    The sample has a proven bound of ``most`` ids of two numbers, so it is
    broadcast and only labelled rows are shuffled.  Of several rows with one id
    the text with the smallest hash is taken, so the result has ``most`` rows at
    most however often an id is repeated, and no id counts more than another.
    """
    y = F.col(label).cast("int")
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), y.alias("label"))
        .filter("doc_id is not null and label in (0, 1)").filter(~held_out())
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("top")).filter("label = top").drop("top")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    one = F.min(F.struct(F.xxhash64("text").alias("key"), "text")).alias("one")
    return base.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(one).select("doc_id", "one.text", "label")
