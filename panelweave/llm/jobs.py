"""Shared Spark plumbing of the subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.graphs import durable, shared_folder, star_components

__all__ = ["components", "delete_folder", "durable", "shared_folder", "stored"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: ``node`` and ``component`` (its smallest node)."""
    return star_components(edges, a, b)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediates in whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts the lineage, keeps column pruning and pushed filters.

    The table stays until whoever owns the shared folder clears it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
