"""Vectorised word hashing for batches of texts.

A word is a maximal run of bytes other than space and ``\\x09-\\x0D`` in the
UTF-8 form of a text, which is the regular expression ``[^\\x20\\x09-\\x0D]+``.
Null texts have no words.  All arithmetic is modulo 2**64 in numpy, so a batch
costs a few array passes and no Python work for each word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD_BASE = 0x9E3779B97F4A7C15
WINDOW_BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ _U(seed & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=_U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[_U(1), np.full(size - 1, self.base, dtype=_U)], dtype=_U)
                self.down = np.cumprod(np.r_[_U(1), np.full(size - 1, self.inverse, dtype=_U)], dtype=_U)
        return self.up[:n], self.down[:n]


_WORD, _WINDOW, _CHECK = _Powers(WORD_BASE), _Powers(WINDOW_BASE), _Powers(0xA0761D6478BD642F)


@dataclass
class Words:
    """The words of a batch: hash and document of each, and where each document's words begin."""

    hash: np.ndarray  # uint64, one for each word
    doc: np.ndarray  # int64 index into the batch
    first: np.ndarray  # int64, len(batch) + 1
    data: bytes = b""  # the words' bytes, end to end
    at: np.ndarray | None = None  # int64, where each word begins in data, and the end

    def text(self, i: int) -> str:
        return self.data[self.at[i] : self.at[i + 1]].decode("utf-8", "surrogatepass")

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


_SINGLE = np.zeros(256, dtype=bool)
_SINGLE[0x20] = True


def words_of(texts: Sequence[str | None], only_space: bool = False) -> Words:
    """The words of the texts; ``only_space``: runs of anything but the space itself."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    buf = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)
    begins = np.r_[0, np.cumsum(sizes + 1)]
    solid = ~(_SINGLE if only_space else _SPACE)[buf]
    if not solid.any():
        return Words(np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(len(raw) + 1, np.int64))
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(~solid & before)
    lengths = ends - starts
    packed = np.r_[0, np.cumsum(lengths)[:-1]]
    solid_bytes = buf[solid]
    data = solid_bytes.astype(_U)
    where = np.arange(len(data)) - np.repeat(packed, lengths)
    up, _ = _WORD.get(int(lengths.max()))
    with np.errstate(over="ignore"):
        hashed = mix(np.add.reduceat((data + _U(1)) * up[where], packed) + lengths.astype(_U))
    first = np.searchsorted(starts, begins)
    return Words(hashed, np.repeat(np.arange(len(raw)), np.diff(first)), first, solid_bytes.tobytes(), np.r_[packed, len(solid_bytes)])


def windows(values: np.ndarray, k: int, check: bool = False) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive values; it may span documents.  ``check`` takes a second base."""
    n = len(values)
    if n < k:
        return np.zeros(0, _U)
    up, down = (_CHECK if check else _WINDOW).get(n + 1)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, _U)
        total[0] = 0
        np.cumsum(values * up[:n], dtype=_U, out=total[1:])
        return mix((total[k:] - total[:-k]) * down[: n - k + 1], k)


def inside(words: Words, k: int) -> np.ndarray:
    """For each of ``windows(words.hash, k)``: whether it lies in one document."""
    n = len(words.doc)
    return words.doc[: n - k + 1] == words.doc[k - 1 :] if n >= k else np.zeros(0, bool)


def chunks(texts: Sequence[str | None], limit: int = 1 << 20) -> Iterator[slice]:
    """Slices of a batch with about ``limit`` characters at most, so that memory does not follow the batch size."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t) if t is not None else 0
        if held >= limit:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))
