"""A corpus pipeline: quality rules, near duplicates, personal data, source mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.llm.best_fit_packing import pack_documents
from panelweave.llm.jaccard_join import jaccard_classes
from panelweave.llm.jobs import delete_folder, shared_folder
from panelweave.llm.pii_feistel import pseudonymise_column
from panelweave.llm.source_mixing import mix_sources
from panelweave.llm.tokenizer_fertility import fertility_column, measured_bands

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    judged = docs.select(*COLUMNS, fertility_column(F.col("text"), F.col("lang"), bands=measured_bands(docs)).alias("verdict"))
    return judged.filter("verdict.kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id, a null id last.

    Rows that repeat an id with another text are documents of their own; of rows
    that repeat id and text one stays; texts without words are no group.
    """
    found = jaccard_classes(docs, with_keys=True)
    first = found.filter("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("f"))
    stays = first.select("f.doc_id", "f.text_key").unionByName(found.filter("group is null").select("doc_id", "text_key")).distinct()
    keys = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.coalesce("text_key", F.lit(0)).alias("_text")]
    names = ["_id", "_none", "_text"]
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("text_key")).select(*COLUMNS, *keys).join(stays.select(*keys), names, "left_semi")
    once = F.row_number().over(Window.partitionBy(*names).orderBy("source", "lang", "n_chars"))
    return rows.withColumn("_once", once).filter("_once = 1").select(*COLUMNS)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; ``n_chars`` follows the text."""
    done = docs.select(*COLUMNS, pseudonymise_column("text").alias("_p"))
    return done.select("doc_id", F.col("_p.text").alias("text"), "lang", "source", F.length("_p.text").cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample that meets the target weights without design weights, which later stages do not take."""
    return mix_sources(docs.select(*COLUMNS), carry=True).filter("mix.selected").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_stage), ("near_duplicates", near_duplicate_stage), ("personal_data", personal_data_stage),
    ("source_mixing", mixing_stage), ("best_fit_packing", packing_stage),
]

#: The tokeniser, MinHash and packing stages have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again in the shared folder.

    A stage's table is removed once the next one's is written; the last of them
    is read by the result and stays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{folder}/{k}-{name}"
        out.write.parquet(path)
        if k:
            delete_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
