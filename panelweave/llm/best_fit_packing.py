"""Best-fit packing of token sequences with swap-based local search.

Each document becomes its byte-pair ids and a closing id.  Only documents longer
than the capacity are cut: the first piece takes the remainder, all others are
full.  Pieces are dealt into groups of a bounded number; in a group they
are placed best fit decreasing, and then a local search works on the bins that
are not full.  From the emptiest on, a bin gives items away by moves, one-for-one
swaps and two-for-one swaps that each raise the sum of squared fills, until it is
empty or nothing helps; the search ends when every bin has had its turn or no
packing could have fewer bins.  A swap is found among all items and pairs by
their lengths, in one pass over the bins' items.

Pieces are numbered in a checkpoint and dealt by their numbers, so that a row
that is repeated a million times is spread over all groups like any others.

Only a document's first piece can be shorter than the capacity.  Full pieces are
sequences of their own, dealt into parts of their own, so that a group holds a
bounded number of pieces however long the documents are.  A group loses about
one bin at most against packing all pieces together, so the loss does not grow
with the input.

Edge cases: a null text is an empty one, one closing id long; a null id keeps
its row; repeated rows are packed each on its own; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import durable
from .text_hash import words_of
from .word_cache import WordCache

GROUP = 20_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class CachedEncoder:
    """Ids as little-endian 32-bit bytes.

    A byte-level vocabulary splits a text before every single space that has a
    word on both sides, so such parts are encoded on their own and remembered;
    the same vocabulary as a file of ranks does that with less work for each
    part.  Texts with two spaces in a row, with a space at an end or with a
    special token's string are encoded as a whole.
    """

    def __init__(self, path: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        opens = np.zeros(max(table.values()) + 1, bool)
        opens[[i for x, i in table.items() if x[:1] == b" "]] = True
        encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.part = encode
        self.cache = WordCache(encode, opens, np.uint32, prefix=" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [bool(t) and "  " not in t and t[0] != " " and t[-1] != " " and not any(x in t for x in self.special) for t in texts]
        easy = [t for t, p in zip(texts, plain) if p]
        hard = [t for t, p in zip(texts, plain) if not p]
        done: list[bytes] = []
        if easy:
            # The first word has no space before it; it is encoded on its own.
            cut = [t.find(" ") if " " in t else len(t) for t in easy]
            heads = [np.array(self.part(t[:c]), np.uint32).tobytes() for t, c in zip(easy, cut)]
            words = words_of([t[c + 1 :] for t, c in zip(easy, cut)], only_space=True)
            if len(words.hash):
                ids, each = self.cache.tokens(words)
                ends = np.r_[0, np.cumsum(each)][words.first].tolist()
                done = [h + ids[b:e].tobytes() for h, b, e in zip(heads, ends, ends[1:])]
            else:
                done = heads
        whole = [np.asarray(x.ids, "<u4").tobytes() for x in self.model.encode_batch_fast(hard, add_special_tokens=False)] if hard else []
        a, b = iter(done), iter(whole)
        return [next(a) if p else next(b) for p in plain]


_encoders: dict[str, CachedEncoder] = {}


def _pieces(batches: Iterator[pd.DataFrame], path: str, ranks: str, capacity: int, closing: int) -> Iterator[pd.DataFrame]:
    if path not in _encoders:
        _encoders[path] = CachedEncoder(path, ranks)
    encoder, end = _encoders[path], int(closing).to_bytes(4, "little")
    for pdf in batches:
        ids = pdf.doc_id.tolist()
        texts = [(t or "").encode("utf-8", "replace").decode() for t in pdf.text]
        at = 0
        while at < len(texts):
            upto, held = at, 0
            while upto < len(texts) and (held < 1 << 20 or upto == at):
                held += len(texts[upto])
                upto += 1
            out = []
            for d, data in zip(ids[at:upto], encoder.encode(texts[at:upto])):
                data += end
                n = len(data) // 4
                first = n % capacity or capacity
                cuts = [0, *range(first, n + 1, capacity)]
                out += [(d, k, b, e - b, zlib.crc32(data[4 * b : 4 * e])) for k, (b, e) in enumerate(zip(cuts, cuts[1:]))]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            at = upto


class _Bins:
    """Bins of item numbers with their fills."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit_decreasing(self) -> None:
        sizes = self.lengths.tolist()
        by_gap: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        open_gaps = 0
        for item in np.argsort(-self.lengths, kind="stable").tolist():
            size = sizes[item]
            fits = open_gaps >> size
            if fits:
                gap = size + (fits & -fits).bit_length() - 1
                k = by_gap[gap].pop()
                if not by_gap[gap]:
                    open_gaps ^= 1 << gap
                self.bins[k].append(item)
                self.fill[k] += size
            else:
                k, gap = len(self.bins), self.capacity
                self.bins.append([item])
                self.fill.append(size)
            gap -= size
            if gap:
                if not by_gap[gap]:
                    open_gaps |= 1 << gap
                by_gap[gap].append(k)

    def exchange(self, giver: int, give: list[int], taker: int, take: list[int]) -> None:
        for x in give:
            self.bins[giver].remove(x)
        for x in take:
            self.bins[taker].remove(x)
        self.bins[giver] += take
        self.bins[taker] += give
        moved = int(self.lengths[give].sum() - self.lengths[take].sum())
        self.fill[giver] -= moved
        self.fill[taker] += moved

    def local_search(self, changes: tuple[str, ...] = ("move", "one", "two")) -> None:
        """Empty the bins with the least fill, one after the other, by the kinds of ``changes``."""
        self.owner = np.zeros(len(self.lengths), np.int64)
        for k, b in enumerate(self.bins):
            self.owner[b] = k
        level = np.array(self.fill, np.int64)
        least = -(-int(self.lengths.sum()) // self.capacity)
        live = int((level > 0).sum())
        for giver in [int(k) for k in np.argsort(level, kind="stable") if 0 < level[k] < self.capacity]:
            if live <= least:
                break
            while 0 < self.fill[giver] < self.capacity:
                found = self.best_change(giver, level, changes)
                if found is None:
                    break
                give, taker, take = found
                self.exchange(giver, give, taker, take)
                self.owner[give], self.owner[take] = taker, giver
                level[[giver, taker]] = self.fill[giver], self.fill[taker]
            live -= not self.bins[giver]

    def best_change(self, giver: int, level: np.ndarray, changes: tuple[str, ...]) -> tuple[list[int], int, list[int]] | None:
        """The move, or else the swap, that shifts most tokens out of ``giver`` while squared fill grows.

        That holds if the taker ends fuller than the giver was.
        """
        open_ = (level > 0) & (level < self.capacity)
        open_[giver] = False
        if not open_.any():
            return None
        own, full = self.bins[giver], self.fill[giver]
        by_length = {int(self.lengths[x]): x for x in own}
        singles = np.array(sorted(by_length), np.int64)
        if "move" in changes:
            fits = self._fitting(singles)
            takers = np.flatnonzero(open_)
            gap = self.capacity - level[takers]
            size = fits[gap]
            size[level[takers] + size <= full] = 0
            most = int(size.max())
            if most:
                # Of the bins that can take the item the one with the smallest gap.
                can = takers[(gap >= most) & (level[takers] + most > full)]
                return [by_length[most]], int(can[np.argmax(level[can])]), []
        give: dict[int, list[int]] = {}
        if "two" in changes:
            times = {n: [x for x in own if self.lengths[x] == n][:2] for n in by_length}
            for i, a in enumerate(singles.tolist()):
                for b in singles[i:].tolist():
                    if a != b or len(times[a]) > 1:
                        give.setdefault(a + b, [times[a][0], times[b][-1]])
        if "one" in changes:
            give |= {n: [x] for n, x in by_length.items()}
        if not give:
            return None
        fits = self._fitting(np.array([t for t in give if t <= self.capacity], np.int64))
        items = np.flatnonzero(open_[self.owner])
        bins, size = self.owner[items], self.lengths[items]
        shift = fits[size + self.capacity - level[bins]] - size
        shift[(shift <= 0) | (level[bins] + shift <= full)] = 0
        best = int(np.argmax(shift))
        if not shift[best]:
            return None
        return give[int(shift[best] + size[best])], int(bins[best]), [int(items[best])]

    def _fitting(self, totals: np.ndarray) -> np.ndarray:
        """For each room up to the capacity the greatest of ``totals`` that fits, 0 if none does."""
        out = np.zeros(self.capacity + 1, np.int64)
        out[totals] = totals
        return np.maximum.accumulate(out)


def pack(lengths: np.ndarray, capacity: int, changes: tuple[str, ...] = ("move", "one", "two")) -> list[list[int]]:
    """Bins of item numbers; no bin holds more than ``capacity``."""
    bins = _Bins(np.asarray(lengths, np.int64), capacity)
    bins.best_fit_decreasing()
    bins.local_search(changes)
    return [b for b in bins.bins if b]


def _packed(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    group = group.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", na_position="first").reset_index(drop=True)
    lengths = group.length.to_numpy()
    sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
    for k, items in enumerate(pack(lengths, capacity)):
        sequence[items] = k
        offset[items] = np.cumsum(lengths[items]) - lengths[items]
    return group.assign(sequence_id=(group.part.iloc[0] << 32) + sequence, offset=offset).drop(columns="part")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, closing: int = 2, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """For each piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""
    path, table = tokenizer or default_tokenizer(), ranks or default_ranks()
    base = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long"
    # Numbered in a checkpoint: repeated rows are equal in all columns, and only a number that stays deals them into several groups.
    pieces = durable(base.mapInPandas(lambda it: _pieces(it, path, table, capacity, closing), schema).withColumn("number", F.monotonically_increasing_id()))
    short = F.col("length") < capacity
    some, full = pieces.agg(F.count(F.when(short, 1)), F.count(F.when(~short, 1))).first()
    groups, more = max(1, -(-some // GROUP)), max(1, -(-full // GROUP))
    place = F.xxhash64("number")
    pieces = pieces.withColumn("part", F.when(short, F.pmod(place, F.lit(groups))).otherwise(groups + F.pmod(place, F.lit(more)))).drop("number")
    packed = pieces.groupBy("part").applyInPandas(lambda g: _packed(g, capacity), schema + ", sequence_id long, offset long")
    return packed.withColumn("doc_id", F.col("doc_id").cast("long"))
