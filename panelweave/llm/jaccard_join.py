"""N-gram Jaccard join by Bayesian candidate pruning.

Every text becomes its set of five-word shingles (a text of one to four words
is one shingle).  Texts with equal sets are one class before anything is
compared, so exact copies never meet as pairs.  MinHash bands propose groups;
inside a group, blocks of a bounded number of texts are compared: MinHash values
are read sixteen at a time, a pair is dropped once the posterior probability
that its similarity reaches the threshold is under ``tolerance``, and what is
left is verified on the shingle sets.  Links are counted in place and only a
spanning forest of each block leaves the task, so no stage emits all pairs of a
group.

A band is six MinHash values of 384, 64 bands in all: a pair at similarity 0.8
shares none with a probability of 4e-9, one at 0.3 shares one with 0.05 and one
at 0.1 with 6e-5, so that groups hold kindred texts and chance links don't grow
into one group of all.  Pruning reads the first 128 values.  Work within a group
follows the square of its different texts, since every link has to be counted.

Edge cases: null and empty texts have no shingles, no links and their own
class (``class_id`` = ``doc_id``); every row is a document of its own, also one
that repeats a ``doc_id``, whatever its text; a null ``doc_id`` keeps its row and
counts as a link, its class is that of its text (null if all ids of the class
are); other columns of the input are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import join_parts
from .jobs import components, durable
from .text_hash import chunks, inside, mix, windows, words_of

HASHES, ROWS_PER_BAND = 384, 6
BANDS = HASHES // ROWS_PER_BAND
#: MinHash values that pruning reads, and how many at a time.
COMPARED, STEP = 128, 16
BLOCK = 200
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingle_sets(texts: list[str | None], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and where each text's begin."""
    words = words_of(texts)
    ok = inside(words, k)
    grams, doc = windows(words.hash, k)[ok], words.doc[: len(ok)][ok]
    counts = words.count
    few = np.flatnonzero((counts > 0) & (counts < k))
    short = []
    for i in few:
        part = words.hash[words.first[i] : words.first[i + 1]]
        short.append(windows(part, len(part))[0])
    if len(few):
        grams, doc = np.r_[grams, mix(np.array(short, np.uint64), 7)], np.r_[doc, few]
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    if len(grams):
        new = np.r_[True, (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])]
        grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(len(texts) + 1))


def minhash(grams: np.ndarray, first: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """One row of ``hashes`` values for each text that has shingles."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((len(starts), hashes), np.uint32)
    if len(starts):
        low = (grams >> np.uint64(32)).astype(np.uint32)
        work = np.empty_like(low)
        for j in range(hashes):
            np.multiply(low, _A[j], out=work)
            np.add(work, _B[j], out=work)
            np.bitwise_xor(work, work >> np.uint32(15), out=work)
            np.multiply(work, np.uint32(0x2C1B3C6D), out=work)
            out[:, j] = np.minimum.reduceat(work, starts)
    return out


@lru_cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For n = STEP, 2 STEP, ...: the fewest matches that keep a pair, with a uniform prior on the similarity."""
    s = (np.arange(20_000) + 0.5) / 20_000
    least = []
    for n in range(STEP, COMPARED + 1, STEP):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(s) + (n - m) * np.log1p(-s)
        density = np.exp(log - log.max(axis=1, keepdims=True))
        posterior = density[:, s >= threshold].sum(axis=1) / density.sum(axis=1)
        least.append(int(np.argmax(posterior >= tolerance)))
    return tuple(least)


def survivors(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (p, q) of signature rows that stay after every step of the comparison."""
    found = np.zeros(len(p), np.int16)
    for k, need in enumerate(least):
        if not len(p):
            break
        cols = slice(k * STEP, (k + 1) * STEP)
        found += (a[:, cols][p] == b[:, cols][q]).sum(axis=1, dtype=np.int16)
        keep = found >= need
        p, q, found = p[keep], q[keep], found[keep]
    return p, q


def overlaps(sets_a: list[np.ndarray], sets_b: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact intersection sizes of the pairs; many pairs at once by products of 0/1 blocks."""
    if len(p) < 4 * (len(sets_a) + len(sets_b)):
        return np.array([len(np.intersect1d(sets_a[i], sets_b[j], assume_unique=True)) for i, j in zip(p, q)], np.int64)
    na, nb = len(sets_a), len(sets_b)
    values, inverse, times = np.unique(np.concatenate([*sets_a, *sets_b]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(na + nb), [len(x) for x in (*sets_a, *sets_b)])
    rank = np.cumsum(times > 1) - 1
    shared = times[inverse] > 1
    column, owner = rank[inverse][shared], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((na, nb), np.float64)
    for begin in range(0, int(rank[-1]) + 1 if len(rank) else 0, 4096):
        lo, hi = np.searchsorted(column, (begin, begin + 4096))
        block = np.zeros((na + nb, 4096), np.float32)
        block[owner[lo:hi], column[lo:hi] - begin] = 1
        total += block[:na] @ block[na:].T
    return total[p, q].astype(np.int64)


def _roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    parent = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(p.tolist(), q.tolist()):
        i, j = find(i), find(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
    return np.array([find(i) for i in range(n)])


def block_links(group: pd.DataFrame, threshold: float, tolerance: float) -> pd.DataFrame:
    """Links inside one block or between two: for each text its links and a member of its part of the forest."""
    left, right = group[group.side == group.i], group[group.side == group.j]
    same = group.i.iloc[0] == group.j.iloc[0]
    if not len(left) or not len(right):
        return pd.DataFrame({"node": [], "links": [], "root": [], "whole": []})
    sig_a, sig_b = (np.stack([np.frombuffer(x, np.uint32) for x in s.sig]) for s in (left, right))
    if same:
        p, q = np.triu_indices(len(left), 1)
    else:
        p, q = (x.ravel() for x in np.indices((len(left), len(right))))
    if same and len(left) > 2 or not same:
        c_a, c_b = left.comp.to_numpy(), right.comp.to_numpy()
        together = c_a[p] == c_b[q]
        p, q = p[together], q[together]
    node_a, node_b = left.node.to_numpy(), right.node.to_numpy()
    p, q = survivors(sig_a, sig_b, p, q, least_matches(threshold, tolerance))
    if len(p):
        sets_a, sets_b = ([np.frombuffer(x, np.uint64) for x in s.grams] for s in (left, right))
        n_a, n_b = np.array([len(x) for x in sets_a]), np.array([len(x) for x in sets_b])
        both = overlaps(sets_a, sets_b, p, q)
        good = both >= threshold * (n_a[p] + n_b[q] - both) - 1e-9
        p, q = p[good], q[good]
    offset = 0 if same else len(left)
    n = len(left) if same else len(left) + len(right)
    links = np.zeros(n, np.int64)
    np.add.at(links, p, right.copies.to_numpy()[q])
    np.add.at(links, q + offset, left.copies.to_numpy()[p])
    nodes = node_a if same else np.r_[node_a, node_b]
    root = _roots(n, p, q + offset)
    linked = links > 0
    return pd.DataFrame({"node": nodes[linked], "links": links[linked], "root": nodes[root[linked]], "whole": bool(group.unit.iloc[0] < 0)})


def _signed(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """doc_id, text_key, text -> doc_id, text_key, the two halves of the set's hash, the band hashes."""
    for pdf in batches:
        texts = pdf.text.tolist()
        for s in chunks(texts):
            grams, first = shingle_sets(texts[s], k)
            has = np.diff(first) > 0
            sig = minhash(grams, first)
            key_a, key_b = (np.add.reduceat(mix(grams, seed), first[:-1][has]).astype(np.int64) if has.any() else np.zeros(0, np.int64) for seed in (11, 23))
            bands = np.zeros((len(sig), BANDS), np.uint64)
            for r in range(ROWS_PER_BAND):
                with np.errstate(over="ignore"):
                    bands = mix(bands * np.uint64(3) + sig[:, r::ROWS_PER_BAND].astype(np.uint64), r + 1)
            bands = mix(bands + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)
            part = pdf.iloc[s]
            out = pd.DataFrame({"doc_id": part.doc_id.to_numpy(), "text_key": part.text_key.to_numpy(), "key_a": pd.array([None] * len(part), dtype="Int64"), "key_b": pd.array([None] * len(part), dtype="Int64"), "bands": None})
            rows = np.flatnonzero(has)
            out.loc[rows, "key_a"], out.loc[rows, "key_b"] = key_a, key_b
            out["bands"] = pd.Series([None] * len(part), dtype=object)
            out.loc[rows, "bands"] = pd.Series(list(bands), index=rows, dtype=object)
            yield out


def _members(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = pdf.text.tolist()
        for s in chunks(texts):
            grams, first = shingle_sets(texts[s], k)
            sig = minhash(grams, first, COMPARED)
            part = pdf.iloc[s].reset_index(drop=True)
            rows = np.flatnonzero(np.diff(first) > 0)
            part = part.iloc[rows].drop(columns="text")
            part["sig"] = [x.tobytes() for x in sig]
            part["grams"] = [grams[first[i] : first[i + 1]].tobytes() for i in rows]
            yield part


def jaccard_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, shingle_words: int = 5, tolerance: float = 1e-6, with_keys: bool = False
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``class_id`` (the smallest id of its class, linked directly
    or through others) and ``n_links`` (the documents whose similarity to it is at least ``threshold``).

    ``with_keys`` adds ``text_key`` (xxhash64 of the text) and ``group``, a number of the class that also tells
    classes without an id or of one repeated id apart (null for a text without words).
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    signed = durable(
        base.select(F.col("doc_id").cast("string").alias("doc_id"), "text_key", "text")  # pandas would turn a long with nulls into a double
        .mapInPandas(lambda it: _signed(it, shingle_words), "doc_id string, text_key long, key_a long, key_b long, bands array<long>")
        .withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("row", F.monotonically_increasing_id())
    )
    keyed = signed.filter("key_a is not null")
    # The first row of each different set stands for it; its number is the set's node.  The numbers are fixed by the checkpoint.
    classes = durable(keyed.groupBy("key_a", "key_b").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    reps = signed.select(F.col("row").alias("node"), F.col("doc_id").alias("rep"), F.col("text_key").alias("rep_key"), "bands")
    banded = reps.select("node", "bands").join(classes.select("node"), "node", "left_semi").select("node", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("top")).filter("hub < top").drop("top")
    edges = banded.join(hubs, "band").filter("node > hub").select("node", "hub")
    groups = components(edges, "node", "hub").select("node", F.col("component").alias("comp"))
    sizes = groups.groupBy("comp").agg(F.count("*").alias("n")).withColumn("nb", F.ceil(F.col("n") / BLOCK).cast("int"))
    groups = durable(join_parts(groups, sizes, "comp", "node").drop("n"))
    small = groups.filter("nb = 1").count()
    cells = max(1, -(-small // BLOCK))
    placed = groups.withColumn(
        "unit", F.when(F.col("nb") > 1, F.col("comp")).otherwise(-1 - F.pmod(F.xxhash64("comp"), F.lit(cells)))
    ).withColumn("side", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    wanted = placed.join(classes.select("node", "copies"), "node").join(reps.drop("bands"), "node")
    # One row with the representative's id and text, for each such pair that is wanted.
    texts = wanted.join(base, (wanted.rep_key == base.text_key) & wanted.rep.eqNullSafe(base.doc_id))
    members = texts.groupBy("node").agg(F.first(F.struct("comp", "nb", "copies", "unit", "side", "text")).alias("m"))
    schema = "node long, comp long, nb int, copies long, unit long, side int, sig binary, grams binary"
    members = members.select("node", "m.*").mapInPandas(lambda it: _members(it, shingle_words), schema)
    spread = members.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "unit", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side", "node", "comp", "copies", "sig", "grams"
    )
    links = durable(
        spread.groupBy("unit", "i", "j").applyInPandas(lambda g: block_links(g, threshold, tolerance), "node long, links long, root long, whole boolean")
    )
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    # A group that one task holds is joined there already.
    joined = links.filter("whole").select("node", F.col("root").alias("component")).unionByName(components(links.filter("not whole"), "node", "root"))
    # A class is named by the smallest id of all its rows.
    of_node = classes.join(joined, "node", "left").join(counted, "node", "left").select(
        "key_a", "key_b", F.coalesce("component", "node").alias("component"), "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    names = of_node.groupBy("component").agg(F.min("least").alias("class_id"))
    of_key = durable(join_parts(of_node, names, "component", "key_a").select("key_a", "key_b", F.col("component").alias("group"), "class_id", "n_links"))
    result = signed.select("doc_id", "text_key", "key_a", "key_b").join(of_key, ["key_a", "key_b"], "left")
    name = F.when(F.col("key_a").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    return result.select("doc_id", name, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *(["text_key", "group"] if with_keys else []))
