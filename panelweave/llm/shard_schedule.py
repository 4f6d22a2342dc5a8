"""Sharding by longest processing time: groups that stay together, sorted by size, go to the least loaded shard.

Groups are dealt into slices by hash.  Each slice reads its groups in classes of
size (powers of two), largest first, and a heap gives each to the least loaded of
its bins of that class; a slice is a stream, so a task holds no more than the
loads of a few bins.  The bins, a number bounded by slices, classes and bins
whatever the table's size, are then scheduled onto the shards in the same way.
Large groups are alone in their class, and so in their bin.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.graphs import join_hubs
from .jobs import stored

#: Slices of the groups, each a stream of one task; bins of a slice's class.  With 64 classes there are at most SLICES * 64 * BINS bins.
SLICES, BINS = 256, 8
#: Bytes that a row counts beside those of its text.
ROW_BYTES = 8


def least_loaded(sizes: Iterator[int], bins: int) -> Iterator[int]:
    """The bin of each size in turn: the least loaded, ties to the smaller number."""
    heap = [(0, b) for b in range(bins)]
    for size in sizes:
        load, b = heap[0]
        heapq.heapreplace(heap, (load + size, b))
        yield b


def _slice_bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bins of groups that come by slice and class, largest first."""
    at, heap = None, []
    for batch in batches:
        found = []
        for key in zip(batch["slice"], batch["class"], batch["size"]):
            if key[:2] != at:
                at, heap = key[:2], [(0, b) for b in range(BINS)]
            load, b = heap[0]
            heapq.heapreplace(heap, (load + int(key[2]), b))
            found.append(b)
        yield batch.assign(bin=found)


def schedule(groups: DataFrame, shards: int) -> DataFrame:
    """``group``, ``n``, ``shard`` of ``groups`` (``group``, a key without nulls; ``size``; ``n``, its number of rows)."""
    dealt = groups.select("group", "size", "n", F.pmod(F.xxhash64("group"), F.lit(SLICES)).cast("int").alias("slice"), F.length(F.bin("size")).alias("class"))
    ordered = dealt.repartition("slice").sortWithinPartitions("slice", F.desc("class"), F.desc("size"), "group")
    binned = stored(ordered.mapInPandas(_slice_bins, StructType([*ordered.schema.fields, StructField("bin", IntegerType())])))
    of_bins = binned.groupBy("slice", "class", "bin").agg(F.sum("size").alias("size"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            bins = pd.concat(parts).sort_values(["size", "class", "slice", "bin"], ascending=[False, True, True, True])
            yield bins.assign(shard=list(least_loaded(bins["size"], shards)))[["slice", "class", "bin", "shard"]]

    placed = of_bins.repartition(1).mapInPandas(place, "slice int, class int, bin int, shard int")
    return binned.join(placed, ["slice", "class", "bin"]).select("group", "n", "shard")


def numbered(rows: DataFrame, shard: str = "shard", piece: str = "piece", order: str = "row") -> DataFrame:
    """``slot``: numbers without gaps from 0 in each shard, by piece and order.  A task numbers a shard's rows of one piece."""
    counted = rows.groupBy(shard, piece).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(shard, piece, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(shard, piece).orderBy(order)) - 1
    return rows.withColumn("_at", within).join(starts, [shard, piece]).withColumn("slot", (F.col("_start") + F.col("_at")).cast("long")).drop("_at", "_start")


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its shard, by the law ``bytes``: loads near equal, equal texts together.

    Null texts are empty, and equal to empty ones.  A shard's load exceeds the mean
    only where a group alone does.  Rows with null or repeated ids are rows of their
    own.  Other columns are ignored, whatever their names; an empty table gives none.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    size = F.length(text).cast("long") + ROW_BYTES
    # A row's piece is the task that read it: a bounded part of the table, fixed once the rows are stored.
    rows = stored(docs.select(
        F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("group"),
        F.spark_partition_id().alias("piece"), F.monotonically_increasing_id().alias("row"),
    ))
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    placed = schedule(groups, shards)
    dealt = join_hubs(rows, placed, "group", "row", "n", rows.count())
    return numbered(dealt).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
