"""Approximate nearest neighbours by a permutation index.

Equal vectors are one entry of the index, with the smallest ids that hold it, so
that a very common vector takes one place.  Pivots are the axes, in both
directions, of random rotations of the space around the centre of a bounded
sample; their number follows the square root of the number of entries.  An entry
is represented by its nearest pivots in order and posted once, with the pivot's
rank, in each such pivot's inverted file; files are cut into blocks of a bounded
number of entries, so a pivot that most entries post is split.  A query reads the
files of its own nearest pivots, ranks what it finds by Spearman's footrule on
the two orders (a pivot that is missing has the last rank), and reranks by cosine
in double precision as many as eight times the square root of the index's size.

A query block and an index block are one task, which returns only the best few
of each query; no stage makes a row for each pair of vectors.  A query's work
follows its files' entries, which are (nearest pivots)^2 / pivots of the index.

Edge cases: vectors that are null, zero or empty or hold null or non-finite
numbers take no part, nor do null ids; vectors are compared with those of the
same dimension, each dimension has an index of its own; rows that repeat an id
count once for a query (the nearest), a query id with several vectors is searched
by each; a query without candidates has no row; ties go to the smaller id; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graphs import join_hubs
from .jobs import durable

#: Numbers in the vectors of an index block, entries at most; queries of a block.
BLOCK_NUMBERS, INDEX_BLOCK, QUERY_BLOCK = 1 << 19, 8192, 4096
#: Bounds: rows read to place the pivots, pivots that represent a vector, pivots.
SAMPLE, NEAREST, MOST_PIVOTS = 4096, 64, 16_384
#: Times the square root of the index's size: pivots, entries reranked.
PIVOT_RATE, RERANK_RATE = 4.5, 8.0
_ENTRY = "n int, ids binary, sizes binary, vectors binary, at binary, ranks binary, cuts binary"


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Pivots:
    """Rotations around the sample's centre, within the directions that the sample takes up; 2 * len(axes) pivots."""

    def __init__(self, sample: np.ndarray, dim: int, wanted: int):
        rng = np.random.default_rng(20240229)
        self.centre, basis = np.zeros(dim), np.eye(dim)
        if len(sample):
            u = unit(sample)
            self.centre = u.mean(axis=0)
            if len(u) >= 4 * dim:
                power, axes = np.linalg.eigh(np.cov((u - self.centre).T).reshape(dim, dim))
                used = power > 1e-6 * max(power.max(), 1e-300)
                basis = axes[:, used].T if used.any() else basis
        r = len(basis)
        turns = max(1, -(-min(wanted, MOST_PIVOTS) // (2 * r)))
        self.axes = np.concatenate([np.linalg.qr(rng.normal(size=(r, r)))[0] @ basis for _ in range(turns)])

    def __len__(self) -> int:
        return 2 * len(self.axes)

    def orders(self, x: np.ndarray, m: int) -> np.ndarray:
        """The m nearest pivots of each vector, nearest first."""
        out = np.empty((len(x), m), np.int32)
        for a in range(0, len(x), 1024):
            near = (unit(x[a : a + 1024]) - self.centre) @ self.axes.T
            near = np.concatenate([near, -near], axis=1)
            part = np.argpartition(-near, min(m, near.shape[1] - 1), axis=1)[:, :m]
            out[a : a + 1024] = np.take_along_axis(part, np.argsort(-np.take_along_axis(near, part, axis=1), axis=1, kind="stable"), axis=1)
        return out


def inverted_files(order: np.ndarray, n_pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries and ranks by pivot, end to end, and where each pivot's begin."""
    flat = order.ravel()
    by = np.argsort(flat, kind="stable")
    m = order.shape[1]
    return (by // m).astype(np.int32), (by % m).astype(np.int16), np.searchsorted(flat[by], np.arange(n_pivots + 1)).astype(np.int64)


def posted(block: pd.DataFrame, pivots: Pivots, m: int) -> pd.DataFrame:
    """One block of the index: its vectors with their ids, and its part of each inverted file."""
    x = np.stack(block.v.to_numpy()).astype(np.float64)
    at, ranks, cuts = inverted_files(pivots.orders(x, m), len(pivots))
    ids = [np.asarray(i, np.int64) for i in block.ids]
    return pd.DataFrame([{
        "n": len(x), "ids": np.concatenate(ids).tobytes(), "sizes": np.array([len(i) for i in ids], np.int32).tobytes(), "vectors": x.tobytes(),
        "at": at.tobytes(), "ranks": ranks.tobytes(), "cuts": cuts.tobytes(),
    }])


def search_block(queries: pd.DataFrame, index: pd.DataFrame, pivots: Pivots, k: int, m: int, rate: float) -> pd.DataFrame:
    """For each query vector the best k + 1 ids of a block that holds the share ``rate`` to be reranked."""
    out = {"query": [], "vec_id": [], "score": []}
    for e in index.itertuples(index=False):
        x = np.frombuffer(e.vectors, np.float64).reshape(e.n, -1)
        ids, first = np.frombuffer(e.ids, np.int64), np.r_[0, np.cumsum(np.frombuffer(e.sizes, np.int32))]
        at, ranks, cuts = np.frombuffer(e.at, np.int32), np.frombuffer(e.ranks, np.int16), np.frombuffer(e.cuts, np.int64)
        norm = np.sqrt((x * x).sum(axis=1))
        q = np.stack(queries.v.to_numpy()).astype(np.float64)
        for key, v, order in zip(queries["query"].tolist(), q, pivots.orders(q, m)):
            begin, size = cuts[order], cuts[order + 1] - cuts[order]
            place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            # Footrule = constant - 2 * sum over shared pivots of (m - the larger of both ranks).
            shared = np.bincount(at[place], m - np.maximum(ranks[place], np.repeat(np.arange(m), size)), minlength=e.n)
            take = min(e.n, max(k + 1, int(np.ceil(rate * e.n))))
            while True:
                best = np.argpartition(-shared, take - 1)[:take] if take < e.n else np.arange(e.n)
                score = (x[best] * v).sum(axis=1) / (norm[best] * np.sqrt((v * v).sum()))
                some = first[best + 1] - first[best]
                flat = ids[np.repeat(first[best] - (np.cumsum(some) - some), some) + np.arange(some.sum())]
                scores = np.repeat(score, some)
                ordered = np.lexsort((flat, -scores))
                found, where = np.unique(flat[ordered], return_index=True)
                if len(found) > k or take == e.n:
                    break
                take = min(e.n, 2 * take)  # ids that hold several near vectors: read on until k + 1 different ids are found
            chosen = ordered[np.sort(where)[: k + 1]]
            out["query"] += [key] * len(chosen)
            out["vec_id"] += flat[chosen].tolist()
            out["score"] += scores[chosen].tolist()
    return pd.DataFrame(out)


def _of_dimension(entries: DataFrame, queries: DataFrame, sample: np.ndarray, dim: int, n: int, n_query: int, k: int, m: int) -> DataFrame:
    """query, vec_id, score of one dimension."""
    pivots = Pivots(sample, dim, int(np.ceil(PIVOT_RATE * np.sqrt(n))))
    m, rate = min(m, len(pivots)), RERANK_RATE / np.sqrt(n)
    ib, qb = max(1, -(-n // max(64, min(INDEX_BLOCK, BLOCK_NUMBERS // dim)))), max(1, -(-n_query // QUERY_BLOCK))
    index = entries.withColumn("i", F.pmod(F.xxhash64("v"), F.lit(ib)).cast("int"))
    index = durable(index.groupBy("i").applyInPandas(lambda g: posted(g, pivots, m).assign(i=int(g.i.iloc[0])), _ENTRY + ", i int"))
    spread = index.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    asked = queries.withColumn("q", F.pmod(F.xxhash64("v"), F.lit(qb)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(ib - 1))))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], "vec_id": [], "score": []})
        return search_block(a, b, pivots, k, m, rate)

    return asked.groupBy("q", "i").cogroup(spread.groupBy("q", "i")).applyInPandas(search, "query long, vec_id long, score double")


def _answers(found: DataFrame, asked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The blocks' finds brought together, and handed to every id that asks."""
    best = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    lists = best.withColumn("_n", place).filter(F.col("_n") <= k + 1).groupBy("query").agg(F.collect_list(F.struct("vec_id", "score")).alias("near"))
    lists = lists.join(queries.select("query", F.col("times").alias("n")), "query")
    total = queries.agg(F.sum("times")).first()[0]
    ids = join_hubs(asked, queries.select("v", "query", F.col("times").alias("n")), "v", "query_id", "n", total).select("query_id", "query")
    rows = join_hubs(ids, lists, "query", "query_id", "n", total).select("query_id", F.explode("near").alias("x")).select("query_id", "x.*").filter("vec_id <> query_id")
    rows = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, nearest_pivots: int = NEAREST) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for the queries: rows whose id is divisible by ``every``."""
    v = F.col("v")
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(
        F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))) & F.exists(v, lambda a: a != 0)
    )
    spark = vectors.sparkSession
    # Of equal vectors the k + 1 smallest ids can be among the k nearest of another.
    least = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    entries = durable(base.distinct().withColumn("_n", least).filter(F.col("_n") <= k + 1).groupBy("v").agg(F.collect_list("vec_id").alias("ids")).withColumn("dim", F.size("v")))
    asked = durable(base.filter(F.col("vec_id") % every == 0).distinct().select(F.col("vec_id").alias("query_id"), "v"))
    # A query vector is searched once, under a number that the checkpoint fixes.
    queries = durable(asked.groupBy("v").agg(F.count("*").alias("times")).select("v", "times", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("query")))
    sample = entries.orderBy(F.xxhash64("v"), F.element_at("ids", 1)).limit(SAMPLE).select("v").collect()
    asks = {r.dim: r["count"] for r in queries.groupBy("dim").count().collect()}
    found = None
    for r in sorted(entries.groupBy("dim").count().collect()):
        if r.dim in asks:
            own = np.array([s.v for s in sample if len(s.v) == r.dim]).reshape(-1, r.dim)
            part = _of_dimension(entries.filter(F.col("dim") == r.dim), queries.filter(F.col("dim") == r.dim).select("query", "v"), own, r.dim, r["count"], asks[r.dim], k, nearest_pivots)
            part = part.withColumn("dim", F.lit(r.dim))
            found = part if found is None else found.unionByName(part)
    if found is None:
        schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
        return spark.createDataFrame([], schema)
    return _answers(found, asked, queries, k)
