"""Token ids of words, remembered within a Python worker up to a bound."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .text_hash import Words


class WordCache:
    """``encode`` gives the ids of a text; ``opens`` tells by id whether a token begins a word.

    Unknown words are encoded together, a space between each two, and cut where
    a token opens a word; where that doesn't give as many parts as there are
    words, they are halved until it does or a word stands alone.
    """

    def __init__(self, encode: Callable[[str], list[int]], opens: np.ndarray, dtype=np.uint16, prefix: str = "", mark: str | None = None, most: int = 500_000):
        self.encode, self.opens, self.dtype, self.prefix, self.mark, self.most = encode, opens, dtype, prefix, mark, most
        self.forget()

    def forget(self) -> None:
        self.index: dict[int, int] = {}
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.store, self.used = np.zeros(1 << 20, self.dtype), 0

    def parts(self, joined: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of n words end to end, and how many each has."""
        if n == 1:
            ids = np.array(self.encode(self.prefix + joined), self.dtype)
            return ids, np.array([len(ids)])
        if self.mark is None or self.mark not in joined:
            ids = np.fromiter(self.encode(self.prefix + joined), self.dtype)
            heads = np.flatnonzero(self.opens[ids])
            if len(heads) == n and heads[0] == 0:
                return ids, np.diff(np.r_[heads, len(ids)])
        texts, half = joined.split(" "), n // 2
        (x, k), (y, m) = self.parts(" ".join(texts[:half]), half), self.parts(" ".join(texts[half:]), n - half)
        return np.r_[x, y], np.r_[k, m]

    def learn(self, keys: list[int], joined: str) -> None:
        ids, sizes = self.parts(joined, len(keys))
        n = len(self.index)
        while len(self.begin) < n + len(keys):
            self.begin, self.size = np.r_[self.begin, self.begin], np.r_[self.size, self.size]
        while len(self.store) < self.used + len(ids):
            self.store = np.r_[self.store, self.store]
        self.begin[n : n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(keys)] = sizes
        self.store[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.index.update(zip(keys, range(n, n + len(keys))))

    def tokens(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and the number of each word's."""
        values, example, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        keys = values.tolist()
        if len(self.index) + len(keys) > self.most:
            self.forget()
        missing = [i for i, k in enumerate(keys) if k not in self.index]
        for at in range(0, len(missing), 1000):
            some = missing[at : at + 1000]
            of = example[some]
            spans = zip(words.at[of].tolist(), words.at[of + 1].tolist())
            self.learn([keys[i] for i in some], b" ".join([words.data[x:y] for x, y in spans]).decode("utf-8", "replace"))
        known = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))[inverse]
        each = self.size[known]
        total = int(each.sum())
        place = np.arange(total, dtype=np.int32) - np.repeat((np.cumsum(each) - each - self.begin[known]).astype(np.int32), each)
        return self.store[place], each
