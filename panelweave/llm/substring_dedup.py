"""Removal of token windows that occur more than once in a corpus.

Words are runs of anything but space and ``\\x09-\\x0D``.  Every window of
``width`` consecutive words of one document gets a Rabin-Karp hash; a window
whose hash starts at two places of the corpus is repeated, and the union of the
repeated windows of a document, as maximal intervals, is removed.

Counting runs in two steps so that the shuffle stays smaller than the text.
Each window is first represented by its anchor, the smallest hash among its
sub-windows of ``anchor`` words.  Equal windows have equal anchors, so a window
whose anchor occurs once in the corpus is proven single.  Windows under repeated
anchors are counted by 96 bits of hash, packed as arrays over hash buckets.
Within a task equal windows are combined before they are sent, so a passage in
any share of the rows sends one entry for each task and bucket.

Edge cases: null and empty texts have no words, nothing is removed and the hash
is that of the empty string; rows with equal ``doc_id`` stay separate unless
their texts are equal too, and then each has its own result row; a null
``doc_id`` keeps its row; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_hash import chunks, inside, mix, windows, words_of


#: Text for each bucket of windows, and for each share of the result.
BUCKET_BYTES = 16 << 20


def _smallest(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k consecutive values."""
    span, out = 1, x
    while span * 2 <= k:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (k - span)], out[k - span :]) if k > span else out


def _window_anchors(word_hash: np.ndarray, width: int, anchor: int) -> np.ndarray:
    return _smallest(windows(word_hash, anchor), width - anchor + 1)


def _anchor_places(words, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Each place that is the anchor of some window: its hash and its document."""
    ok = inside(words, width)
    if not ok.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = np.where(ok, _window_anchors(words.hash, width, anchor), np.uint64(0))
    pad = np.zeros(width - anchor, np.uint64)
    # A sub-window is an anchor if the largest minimum among the windows around it is its own hash.
    highest = ~_smallest(~np.concatenate([pad, low, pad]), width - anchor + 1)
    sub = windows(words.hash, anchor)
    at = np.flatnonzero((sub == highest) & inside(words, anchor))
    return sub[at], words.doc[at]


def _anchors(batches: Iterator[pd.DataFrame], width: int, anchor: int) -> Iterator[pd.DataFrame]:
    """The anchors of each document, and at how many places of it each was chosen."""
    for pdf in batches:
        texts = pdf.text.tolist()
        for s in chunks(texts):
            low, doc = _anchor_places(words_of(texts[s]), width, anchor)
            if not len(low):
                continue
            order = np.lexsort((low, doc))
            low, doc = low[order], doc[order]
            head = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])])
            part = pdf.iloc[s]
            yield pd.DataFrame({
                "row_key": part.row_key.to_numpy()[doc[head]], "text_key": part.text_key.to_numpy()[doc[head]],
                "anchor": low[head].astype(np.int64), "times": np.diff(np.r_[head, len(low)]).astype(np.int64),
            })


def _packed(batches: Iterator[pd.DataFrame], width: int, anchor: int, buckets: int) -> Iterator[pd.DataFrame]:
    """Windows under repeated anchors, as arrays for each hash bucket: hash, check, document and position."""
    for pdf in batches:
        texts = pdf.text.tolist()
        for s in chunks(texts, 1 << 21):
            part = pdf.iloc[s]
            words = words_of(texts[s])
            n = len(words.hash) - width + 1
            if n <= 0:
                continue
            ok = inside(words, width)
            low = _window_anchors(words.hash, width, anchor)
            for i, hits in enumerate(part.anchors):
                lo, hi = words.first[i], min(words.first[i + 1], n)
                if hi > lo:
                    ok[lo:hi] &= np.isin(low[lo:hi].view(np.int64), np.asarray(hits, np.int64))
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            full, check = windows(words.hash, width)[at], windows(words.hash, width, check=True)[at].astype(np.uint32)
            doc = words.doc[at]
            pos = (at - words.first[doc]).astype(np.uint32)
            order = np.lexsort((check, full))
            full, check, doc, pos = full[order], check[order], doc[order], pos[order]
            # Windows that this task has twice are settled here; one of them is sent for the others' sake.
            equal = (full[1:] == full[:-1]) & (check[1:] == check[:-1])
            first_of = np.r_[True, ~equal]
            known = np.r_[equal, False] | ~first_of
            bucket = (full >> np.uint64(32)) % np.uint64(buckets)
            sent = np.flatnonzero(first_of)
            sent = sent[np.lexsort((pos[sent], doc[sent], bucket[sent]))]
            ids, keys = part.row_key.tolist(), part.text_key.tolist()
            cuts = np.flatnonzero(np.r_[True, bucket[sent][1:] != bucket[sent][:-1]])
            rows = []
            for b, e in zip(cuts, np.r_[cuts[1:], len(sent)]):
                x = sent[b:e]
                own, start = np.unique(doc[x], return_index=True)
                rows.append({
                    "bucket": int(bucket[x[0]]), "ids": [ids[i] for i in own], "keys": [keys[i] for i in own],
                    "sizes": np.diff(np.r_[start, len(x)]).astype(np.int32), "known": np.packbits(known[x]).tobytes(),
                    "full": full[x].tobytes(), "check": check[x].tobytes(), "pos": pos[x].tobytes(),
                })
            yield pd.DataFrame(rows)
            # Further copies within the task, as settled positions.
            more = np.flatnonzero(~first_of)
            if len(more):
                more = more[np.lexsort((pos[more], doc[more]))]
                own, start = np.unique(doc[more], return_index=True)
                yield pd.DataFrame([{
                    "bucket": -1 - int(full[more[0]] % np.uint64(buckets)), "ids": [ids[i] for i in own], "keys": [keys[i] for i in own],
                    "sizes": np.diff(np.r_[start, len(more)]).astype(np.int32), "known": b"", "full": b"", "check": b"", "pos": pos[more].tobytes(),
                }])


_PACKED = "bucket long, ids array<long>, keys array<long>, sizes array<int>, known binary, full binary, check binary, pos binary"


def _dealt(rows: pd.DataFrame, keep: np.ndarray | None, shares: int) -> pd.DataFrame:
    """The positions kept, packed for each share of the documents."""
    ids = np.concatenate([np.asarray(x, np.int64) for x in rows.ids])
    keys = np.concatenate([np.asarray(x, np.int64) for x in rows["keys"]])
    sizes = np.concatenate([np.asarray(x, np.int64) for x in rows.sizes])
    pos = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.pos])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if keep is not None:
        pos, owner = pos[keep], owner[keep]
    share = mix(keys.view(np.uint64), 3) % np.uint64(shares)
    order = np.argsort(share[owner], kind="stable")
    pos, owner = pos[order], owner[order]
    cuts = np.flatnonzero(np.r_[True, share[owner][1:] != share[owner][:-1]]) if len(owner) else np.zeros(0, np.int64)
    out = []
    for b, e in zip(cuts, np.r_[cuts[1:], len(owner)]):
        start = np.flatnonzero(np.r_[True, owner[b:e][1:] != owner[b:e][:-1]])
        own = owner[b:e][start]
        out.append((int(share[own[0]]), ids[own].tobytes(), keys[own].tobytes(), np.diff(np.r_[start, e - b]).astype(np.int32).tobytes(), pos[b:e].tobytes()))
    return pd.DataFrame(out, columns=["share", "ids", "keys", "sizes", "pos"])


_SHARED = "share long, ids binary, keys binary, sizes binary, pos binary"


def repeated_in_bucket(rows: pd.DataFrame, shares: int = 1) -> pd.DataFrame:
    """The positions of one bucket whose window occurs elsewhere."""
    if rows.bucket.iloc[0] < 0:
        return _dealt(rows, None, shares)
    full = np.concatenate([np.frombuffer(x, np.uint64) for x in rows.full])
    check = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.check])
    known = np.concatenate([np.unpackbits(np.frombuffer(k, np.uint8))[: len(f) // 8] for k, f in zip(rows.known, rows.full)]).astype(bool)
    order = np.lexsort((check, full))
    same = (full[order][1:] == full[order][:-1]) & (check[order][1:] == check[order][:-1])
    again = np.zeros(len(full), bool)
    again[order] = np.r_[same, False] | np.r_[False, same]
    return _dealt(rows, np.flatnonzero(again | known), shares)


def intervals_of_share(rows: pd.DataFrame, width: int) -> pd.DataFrame:
    """One row for each document of a share: its maximal intervals, as begins and ends."""
    ids, keys = (np.concatenate([np.frombuffer(x, np.int64) for x in rows[c]]) for c in ("ids", "keys"))
    sizes = np.concatenate([np.frombuffer(x, np.int32) for x in rows.sizes])
    pos = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.pos]).astype(np.int64)
    pairs, doc = np.unique(np.stack([ids, keys]), axis=1, return_inverse=True)
    owner = np.repeat(doc.ravel(), sizes)
    order = np.lexsort((pos, owner))
    owner, pos = owner[order], pos[order]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (pos[1:] - pos[:-1] > width)])  # intervals that touch are one
    last = np.r_[new[1:], len(pos)] - 1
    spans = np.stack([pos[new], pos[last] + width], axis=1)
    cuts = np.searchsorted(owner[new], np.arange(pairs.shape[1] + 1))
    return pd.DataFrame({"row_key": pairs[0], "text_key": pairs[1], "spans": [spans[a:b].ravel() for a, b in zip(cuts, cuts[1:])]})


def _removed(batches: Iterator[pd.DataFrame], width: int, with_text: bool) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for text, flat in zip(pdf.text, pdf.spans):
            words = [] if text is None else text.encode("utf-8", "surrogatepass").split()
            n = len(words)
            spans = [] if flat is None else np.asarray(flat, np.int64).reshape(-1, 2).tolist()
            kept, last = [], 0
            for b, e in spans:
                kept += words[last:b]
                last = e
            words = kept + words[last:]
            gone = sum(e - b for b, e in spans)
            joined = b" ".join(words)
            row = (n, gone, hashlib.sha256(joined).hexdigest(), [{"begin": b, "end": e} for b, e in spans])
            out.append(row + (joined.decode("utf-8", "surrogatepass"),) if with_text else row)
        names = ["n_words", "n_removed", "kept_sha256", "removed"] + ["kept_text"] * with_text
        yield pd.DataFrame(out, columns=names).assign(doc_id=pdf.doc_id.to_numpy())


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, anchor: int = 12, with_text: bool = False
) -> DataFrame:
    """For each row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``, ``removed`` (maximal
    intervals of words, end exclusive) and, if asked for, ``kept_text``.
    """
    base = docs.select(
        F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"),
        F.xxhash64(id_col, text_col).alias("row_key"), F.xxhash64(text_col).alias("text_key"),
    )
    anchor = min(anchor, width)
    keys = ["row_key", "text_key"]
    anchors = base.mapInPandas(lambda it: _anchors(it, width, anchor), "row_key long, text_key long, anchor long, times long")
    repeated = anchors.groupBy("anchor").agg(F.sum("times").alias("times")).filter("times > 1").select("anchor")
    hits = anchors.join(repeated, "anchor").groupBy(*keys).agg(F.collect_set("anchor").alias("anchors"))
    # So many buckets and shares that one holds the windows of about BUCKET_BYTES of text, whatever the input.
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-int(size) // BUCKET_BYTES))
    # Both joins deal the same columns out by the same keys, so Spark shuffles the texts once and reads that twice.
    columns = ["doc_id", *keys, "text"]
    candidates = base.join(hits, keys).select(*columns, "anchors")
    packed = candidates.mapInPandas(lambda it: _packed(it, width, anchor, buckets), _PACKED)
    repeats = packed.groupBy("bucket").applyInPandas(lambda g: repeated_in_bucket(g, buckets), _SHARED)
    places = repeats.groupBy("share").applyInPandas(lambda g: intervals_of_share(g, width), "row_key long, text_key long, spans array<long>")
    schema = "n_words long, n_removed long, kept_sha256 string, removed array<struct<begin:long,end:long>>" + ", kept_text string" * with_text + ", doc_id string"
    marked = base.join(places, keys, "left").select(*columns, "spans")
    result = marked.mapInPandas(lambda it: _removed(it, width, with_text), schema)
    return result.select(F.col("doc_id").cast("long").alias("doc_id"), *[c for c in result.columns if c != "doc_id"])
