"""Connected components with bounded hubs, and the shared folder that durable intermediates need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with over 1 / HUB_SHARE of all rows is a hub, so there are HUB_SHARE hubs at most; a hub's rows meet its value in SALTS parts.
HUB_SHARE, SALTS = 1000, 64
#: Every key of ``join_parts`` meets its value in so many parts.
EDGE_PARTS = 16


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set a new local one, which only a local master may use."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    Unlike a checkpoint it carries no constraints of the plan before it, which pile
    up where one step after another joins the table with its own sums.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_hubs(rows: DataFrame, per_key: DataFrame, key: str, spread: str, n: str, total: int) -> DataFrame:
    """``rows`` with ``per_key``'s columns of the same key (inner), where a few keys may have most of the rows.

    ``per_key`` has one row for each key and in ``n`` its number of rows; keys with
    more than ``total / HUB_SHARE`` rows, HUB_SHARE at most, are told by broadcast
    and their rows dealt into SALTS parts by ``spread``.
    """
    bound = max(100, total // HUB_SHARE)
    hubs = F.broadcast(per_key.filter(F.col(n) > bound).select(F.col(key).alias("_hub")))
    part = F.when(F.col("_hub").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    salted = rows.join(hubs, rows[key] == F.col("_hub"), "left").withColumn("_salt", part).drop("_hub")
    parts = F.when(F.col(n) > bound, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(per_key.withColumn("_salt", F.explode(parts)).drop(n).hint("merge"), [key, "_salt"]).drop("_salt")


def join_parts(rows: DataFrame, per_key: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` with ``per_key``'s columns of the same key (inner); every key's rows are dealt into EDGE_PARTS parts by ``spread``."""
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(EDGE_PARTS)).cast("int"))
    return dealt.join(per_key.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(EDGE_PARTS - 1)))), [key, "_part"]).drop("_part")


def star_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of an undirected graph.

    Rounds of large stars (a node's greater neighbours move to its least one) and
    small stars (a node's smaller neighbours do) until the edges stay the same.
    Hubs take part in grouped minima, which are combined before the shuffle, and
    in a join that deals their edges into parts (``join_hubs``).  Joins are merged,
    so no table of nodes passes the driver.  Null ends are ignored; a self edge
    makes its node known; repeated edges count once.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct()
    pairs = durable(pairs)
    e, before = pairs.filter("lo < hi"), None
    while True:
        seen = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if seen == before or not seen[0]:
            break
        before = seen
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(e.select("hi", "lo"))
        least = both.groupBy("u").agg(F.min("v").alias("w"), F.count("*").alias("n")).select("u", F.least("u", "w").alias("m"), "n")
        large = join_hubs(both.filter("v > u"), least, "u", "v", "n", 2 * seen[0]).select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(small.hint("merge"), "hi").select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi"))
        e = durable(moved.filter("lo < hi").distinct())
    member = e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
    alone = pairs.select(F.explode(F.array("lo", "hi")).alias("node")).distinct().join(member.select("node").hint("merge"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return durable(member.unionByName(alone))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node``, ``component`` (smallest node), ``component_max``, ``size``; rules as for ``star_components``."""
    c = star_components(edges, src, dst)
    per = c.groupBy("component").agg(F.max("node").alias("component_max"), F.count("*").alias("size"), F.count("*").alias("_n"))
    return join_hubs(c, per, "component", "node", "_n", c.count()).select("node", "component", "component_max", "size")
