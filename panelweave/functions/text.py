"""Text scalars: cleaning, names, addresses and similarity.

All are Column functions.  What Spark can express stays in its expressions; edit
similarity by Jaro and Winkler, alignment and the token-sort ratio run as
Arrow-batched pandas functions, each different pair of a batch once.  Null in,
null out, unless a function says otherwise.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Address words and their standard forms.
DIRECTIONS = {"north": "n", "south": "s", "east": "e", "west": "w"}
STREET_WORDS = {"street": "st", "avenue": "ave", "boulevard": "blvd", "drive": "dr", "road": "rd", "lane": "ln", "court": "ct", "place": "pl", "square": "sq", "parkway": "pkwy", "highway": "hwy", "circle": "cir", "trail": "trl", "terrace": "ter", "suite": "ste"}
ORDINALS = {"first": "1st", "second": "2nd", "third": "3rd", "fourth": "4th", "fifth": "5th", "sixth": "6th", "seventh": "7th", "eighth": "8th", "ninth": "9th", "tenth": "10th"}
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v", "md", "phd", "rn", "mba", "esq", "cpa", "dds")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squish(c: Column) -> Column:
    """Trim, and one space for each run of white space, no-break spaces included."""
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def clean(c: Column) -> Column:
    """Lower case, hyphens as spaces, no other punctuation, squished."""
    return squish(F.regexp_replace(F.regexp_replace(F.lower(c), "-", " "), r"[^\p{L}\p{N}\s]", ""))


def _plain_letters() -> tuple[str, str]:
    """Letters of the Latin blocks whose decomposition begins with an ASCII letter, and that letter."""
    pairs = [(chr(x), unicodedata.normalize("NFKD", chr(x))[0]) for x in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    kept = [(x, y) for x, y in pairs if x != y and y.isascii() and y.isalpha()]
    return "".join(x for x, _ in kept), "".join(y for _, y in kept)


def ascii_fold(c: Column) -> Column:
    """Accented Latin letters as plain ones; what has no plain form is dropped.  Null stays null."""
    return F.regexp_replace(F.translate(c, *_plain_letters()), r"[^\x00-\x7F]", "")


def utf8_letters(c: Column) -> Column:
    """A letter for each byte of a text's UTF-8, for similarities that count bytes."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def strip_extension(c: Column) -> Column:
    """A telephone number without what follows ext or x."""
    return digits(F.regexp_replace(F.lower(c), r"\s*(?:ext\.?|x)\s*[0-9]+\s*$", ""))


def zip5(c: Column) -> Column:
    """The first five digits, left-padded with zeros; null without digits."""
    d = digits(F.split(c, "-")[0])
    return F.when(F.length(d) > 0, F.lpad(F.substring(d, 1, 5), 5, "0"))


def pad_id(c: Column, width: int = 6) -> Column:
    s = c.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def strip_zeros(c: Column) -> Column:
    return F.regexp_replace(c, "^0+(?=.)", "")


def to_number(c: Column) -> Column:
    """Tolerant: what isn't a number becomes null."""
    return F.trim(c).try_cast("double")


def standard_address(c: Column) -> Column:
    """Cleaned, with directions, street words and ordinals in their short forms; each word is looked up once."""
    short = F.create_map(*[F.lit(x) for pair in (DIRECTIONS | STREET_WORDS | ORDINALS).items() for x in pair])
    return F.array_join(F.transform(F.split(clean(c), " "), lambda w: F.coalesce(F.try_element_at(short, w), w)), " ")


def drop_suffixes(c: Column) -> Column:
    """A name without its generation and degree endings, however many."""
    return squish(F.regexp_replace(c, rf"(?i)(?:[\s,]+(?:{'|'.join(NAME_SUFFIXES)})\.?)+\s*$", ""))


def nickname(c: Column) -> Column:
    """What stands in brackets; null if nothing does."""
    return F.nullif(squish(F.regexp_extract(c, r"\(([^)]*)\)", 1)), F.lit(""))


def drop_nickname(c: Column) -> Column:
    return squish(F.regexp_replace(c, r"\([^)]*\)", " "))


def person_parts(c: Column) -> Column:
    """A struct: ``name`` and ``title`` split at the first comma, ``first`` and ``last`` without initials and endings."""
    name = drop_nickname(F.split(c, ",", 2)[0])
    title = F.when(F.instr(c, ",") > 0, F.nullif(squish(F.split(c, ",", 2)[1]), F.lit("")))
    words = F.filter(F.split(drop_suffixes(name), " "), lambda w: F.length(F.regexp_replace(w, "[.]", "")) > 1)
    return F.struct(name.alias("name"), title.alias("title"), F.try_element_at(words, F.lit(1)).alias("first"), F.when(F.size(words) > 1, F.try_element_at(words, F.lit(-1))).alias("last"))


def first_word(c: Column) -> Column:
    """The first word; the second too after st or saint."""
    w = F.split(F.lower(squish(c)), " ")
    return F.when(w[0].isin("st", "saint") & (F.size(w) > 1), F.concat_ws(" ", w[0], F.try_element_at(w, F.lit(2)))).otherwise(w[0])


def contains_either(a: Column, b: Column) -> Column:
    """One holds the other; empty strings hold nothing."""
    return (F.length(a) > 0) & (F.length(b) > 0) & (a.contains(b) | b.contains(a))


def drop_words(c: Column, words: list[str]) -> Column:
    """Without these words, in any case; they are taken as they are, not as patterns.  No words: only squished."""
    if not words:
        return squish(c)
    return squish(F.regexp_replace(c, rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(re.escape(w) for w in words)})(?![\p{{L}}\p{{N}}])", " "))


def plain_space(c: Column) -> Column:
    """Non-breaking and other Unicode spaces as spaces, control characters gone, runs of space as one."""
    return squish(F.regexp_replace(F.regexp_replace(c, r"[\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\t\n\x0B\f\r]", " "), r"\p{Cc}|\u200B|\uFEFF", ""))


def count_phrase(c: Column, phrase: str, but_not: str | None = None) -> Column:
    """Times a phrase occurs, less those within a longer phrase."""
    def times(p: str) -> Column:
        return ((F.length(c) - F.length(F.replace(c, F.lit(p), F.lit("")))) / F.lit(len(p))).cast("int")

    return times(phrase) - times(but_not) if but_not else times(phrase)


def normalized_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance by the longer length; 0 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, pairs = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                pairs.append(x)
                break
    m = len(pairs)
    if not m:
        return 0.0
    others = [y for y, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(pairs, others)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def _boosted(s, weight):
    """``s + weight * (1 - s)``, rounded once as by a fused operation, so that equal similarities are equal to the last bit (numbers or arrays)."""
    rest = 1.0 - s
    parts = []
    for x in (weight, rest):
        high = x * 134217729.0  # 2 ** 27 + 1: halves of a double, whose products are exact
        high = high - (high - x)
        parts.append((high, x - high))
    (a, b), (c, d) = parts
    product = weight * rest
    lost = ((a * c - product) + a * d + b * c) + b * d
    total = s + product
    back = total - s
    return total + (((s - (total - back)) + (product - back)) + lost)


def _winkler(a: str, b: str, p: float, boost_over: float) -> float:
    s = jaro(a, b)
    if s <= boost_over:
        return s
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return _boosted(s, same * p)


#: Texts up to this length are compared in batches, a bit for each of their letters.
BATCH_LENGTH = 62


def _letters(texts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts as rows of a matrix, 0 beyond the end, and their lengths."""
    joined = "".join(t.ljust(width, "\0") for t in texts)
    return np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).reshape(len(texts), width), np.array([len(t) for t in texts])


#: Fixed value: entries of the largest table of letters' places; pairs of more texts or letters are taken in halves.
PLACE_ENTRIES = 4_000_000
_ONE = np.uint64(1)


def _lowest(v: np.ndarray) -> np.ndarray:
    return v & (~v + _ONE)


def _by_places(left: np.ndarray, right: np.ndarray, li: np.ndarray, ri: np.ndarray, measure) -> np.ndarray:
    """``measure`` of ``left[li]`` and ``right[ri]``, different texts of at most BATCH_LENGTH letters.

    A right text's places of each letter are bits of one number, so a step takes
    one letter of all left texts and finds its places in one operation.
    """
    width = max(1, max(map(len, left), default=1), max(map(len, right), default=1))
    (x, nx), (y, ny) = _letters(left, width), _letters(right, width)
    known, code = np.unique(y, return_inverse=True)
    code = code.reshape(y.shape)
    if len(right) > 1 and len(right) * len(known) > PLACE_ENTRIES:
        half, middle, out = ri < len(right) // 2, len(right) // 2, None
        for part, texts, begin in ((half, right[:middle], 0), (~half, right[middle:], middle)):
            found = _by_places(left, texts, li[part], ri[part] - begin, measure)
            out = np.empty((len(found), len(li))) if out is None else out
            out[:, part] = found
        return out
    places = np.zeros((len(right), len(known) + 1), dtype=np.uint64)
    rows = np.arange(len(right))
    for j in range(width):
        held = rows[ny > j]
        places[held, code[held, j]] |= _ONE << np.uint64(j)
    # Letters that no right text has, and the ends of short texts, have no places.
    at = np.minimum(np.searchsorted(known, x), len(known) - 1) if len(known) else np.zeros(x.shape, dtype=np.int64)
    at = np.where((known[at] == x) & (np.arange(width) < nx[:, None]), at, len(known)) if len(known) else at
    flat, base, at = places.ravel(), ri * (len(known) + 1), np.ascontiguousarray(at.T)
    return measure(x, nx[li], y, ny[ri], li, ri, (flat[base + at[i][li]] for i in range(width)))


def _jaro(x, n, y, m, li, ri, places) -> np.ndarray:
    """Jaro similarity, and how many of four first letters are equal."""
    width = x.shape[1]
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    spot, far = np.arange(width), np.arange(width + 1)
    window = np.zeros((width, width + 1), dtype=np.uint64)
    for k in spot:
        window |= np.where(np.abs(spot[:, None] - k) <= far, _ONE << np.uint64(k), np.uint64(0))
    free, mine = np.full(len(li), ~np.uint64(0)), np.zeros(len(li), dtype=np.uint64)
    for i, of_letter in enumerate(places):
        first = _lowest(of_letter & window[i][reach] & free)
        free ^= first
        mine |= (first != 0).astype(np.uint64) << np.uint64(i)
    theirs = ~free
    common = np.bitwise_count(mine).astype(np.int64)
    moved = np.zeros(len(li), dtype=np.int64)
    for _ in range(int(common.max(initial=0))):
        a, b = _lowest(mine), _lowest(theirs)
        u, v = np.bitwise_count(a - _ONE), np.bitwise_count(b - _ONE)
        moved += (a != 0) & (x[li, np.minimum(u, width - 1)] != y[ri, np.minimum(v, width - 1)])
        mine ^= a
        theirs ^= b
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(common == 0, 0.0, (common / n + common / m + (common - moved // 2) / common) / 3)
    begun, same, both = np.ones(len(li), dtype=bool), np.zeros(len(li), dtype=np.int64), np.minimum(n, m)
    for k in range(min(4, width)):
        begun &= (x[li, k] == y[ri, k]) & (k < both)
        same += begun
    # Texts of which all letters match in their order are equal.
    return np.stack([np.where((n == m) & (common == n) & (moved == 0), 1.0, s), same])


def _myers(x, n, y, m, li, ri, places) -> np.ndarray:
    """Edit distance, a column of the table of all pairs at once, as differences in the bits of two numbers (Myers)."""
    up, down = np.full(len(li), ~np.uint64(0)), np.zeros(len(li), dtype=np.uint64)
    score, end = m.astype(np.int64), np.where(m > 0, _ONE << np.maximum(m - 1, 0).astype(np.uint64), np.uint64(0))
    for i, of_letter in enumerate(places):
        v = of_letter | down
        h = (((of_letter & up) + up) ^ up) | of_letter
        more, less = down | ~(h | up), up & h
        score += (i < n) * (((more & end) != 0).astype(np.int64) - ((less & end) != 0))
        more = (more << _ONE) | _ONE
        up, down = (less << _ONE) | ~(v | more), more & v
    return np.where(m > 0, score, n)[None, :]


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _short_and_long(left: np.ndarray, right: np.ndarray, li: np.ndarray, ri: np.ndarray, short, one) -> np.ndarray:
    """``short`` of pairs of texts of at most BATCH_LENGTH letters; the others one by one."""
    long_left, long_right = (np.fromiter((len(t) > BATCH_LENGTH for t in side), dtype=bool, count=len(side)) for side in (left, right))
    if not (long_left.any() or long_right.any()):
        return short(left, right, li, ri)
    out, few = np.empty(len(li)), ~(long_left[li] | long_right[ri])
    at_left, at_right = np.cumsum(~long_left) - 1, np.cumsum(~long_right) - 1
    out[few] = short(left[~long_left], right[~long_right], at_left[li[few]], at_right[ri[few]])
    for i in np.flatnonzero(~few):
        out[i] = one(left[li[i]], right[ri[i]])
    return out


def levenshtein_pairs(left: np.ndarray, right: np.ndarray, li: np.ndarray, ri: np.ndarray) -> np.ndarray:
    """Edit distances of ``left[li]`` and ``right[ri]``; a beginning that all texts have costs nothing."""
    if len(left) and len(right):
        begun = len(os.path.commonprefix([min(left), max(left), min(right), max(right)]))
        left, right = (np.array([t[begun:] for t in side], dtype=object) for side in (left, right))
    return _short_and_long(left, right, li, ri, lambda *pairs: _by_places(*pairs, _myers)[0], _edits)


def winkler_pairs(left: np.ndarray, right: np.ndarray, li: np.ndarray, ri: np.ndarray, p: float, boost_over: float) -> np.ndarray:
    """Jaro-Winkler of ``left[li]`` and ``right[ri]``, different texts on each side."""
    def short(*pairs) -> np.ndarray:
        s, same = _by_places(*pairs, _jaro)
        return np.where(s <= boost_over, s, _boosted(s, same * p))

    return _short_and_long(left, right, li, ri, short, lambda a, b: _winkler(a, b, p, boost_over))


def winkler_batch(a: np.ndarray, b: np.ndarray, p: float, boost_over: float) -> np.ndarray:
    """Jaro-Winkler of pairs of texts; a text's letters are read once, however many pairs it is in."""
    (li, left), (ri, right) = pd.factorize(a), pd.factorize(b)
    return winkler_pairs(left, right, li, ri, p, boost_over)


def _by_pair(x: pd.Series, y: pd.Series, measure) -> pd.Series:
    """``measure`` of two columns of texts: each different pair of a batch once, null where either is."""
    (li, left), (ri, right) = pd.factorize(x.to_numpy(dtype=object)), pd.factorize(y.to_numpy(dtype=object))
    known = (li >= 0) & (ri >= 0)
    pairs, code = np.unique(li[known] * max(1, len(right)) + ri[known], return_inverse=True)
    out, missing = np.zeros(len(x)), ~known
    if len(pairs):
        out[known] = measure(left[pairs // len(right)], right[pairs % len(right)])[code]
    return pd.Series(pd.arrays.FloatingArray(out, missing), index=x.index)


def jaro_winkler(a: Column, b: Column, p: float = 0.1, boost_over: float = 0.7) -> Column:
    """Similarity 0 to 1; ``p=0`` gives plain Jaro.  Two empty strings are equal."""

    @F.pandas_udf("double")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        return _by_pair(x, y, lambda u, v: winkler_batch(u, v, p, boost_over))

    return f(a, b)


def alignment_batch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Optimal string alignment of pairs of texts: insertions, deletions, changes and swaps of neighbours count 1, and no part is edited twice."""
    width = max(1, max(map(len, a), default=1), max(map(len, b), default=1))
    (x, nx), (y, ny) = _letters(a, width), _letters(b, width)
    table = np.zeros((width + 1, width + 1, len(a)), dtype=np.int32)
    table[:, 0], table[0, :] = np.arange(width + 1)[:, None], np.arange(width + 1)[:, None]
    for i in range(1, width + 1):
        for j in range(1, width + 1):
            best = np.minimum(np.minimum(table[i - 1, j], table[i, j - 1]) + 1, table[i - 1, j - 1] + (x[:, i - 1] != y[:, j - 1]))
            if i > 1 and j > 1:
                swapped = (x[:, i - 1] == y[:, j - 2]) & (x[:, i - 2] == y[:, j - 1])
                best = np.where(swapped, np.minimum(best, table[i - 2, j - 2] + 1), best)
            table[i, j] = best
    return table[nx, ny, np.arange(len(a))].astype("float64")


def alignment_distance(a: Column, b: Column) -> Column:
    """Optimal string alignment distance; a swap of neighbouring letters costs 1."""

    @F.pandas_udf("int")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        return _by_pair(x, y, alignment_batch).astype("Int32")

    return f(a, b)


def deletions(c: Column, most: int) -> Column:
    """The different texts that a text leaves with ``most`` letters or fewer taken out.

    Two texts within ``most`` insertions, deletions, changes and swaps of neighbours have one of these in common.
    """
    def fewer(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))

    found = last = F.array(c)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, lambda t: F.when(F.length(t) > 0, fewer(t)).otherwise(F.array(t)))))
        found = F.array_union(found, last)
    return F.when(c.isNotNull(), found)


def _indel_ratio(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def sorted_tokens(c: Column) -> Column:
    """The words of a text in order, one space between each two."""
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda w: w != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """0 to 100: common subsequence of the texts with their words in order, against both lengths.  A null gives null."""

    @F.pandas_udf("double")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if u is None or v is None else _indel_ratio(u, v) for u, v in zip(x, y)], dtype="float64")

    return f(sorted_tokens(a), sorted_tokens(b))


def base_code(c: Column) -> Column:
    """A phonetic code without a last S, unless it is the whole code."""
    return F.regexp_replace(c, "(?<=.)S$", "")


def initials_match(a: Column, b: Column) -> Column:
    """One is the other's initial, its beginning of three letters or more, or the other without its last letter; case doesn't matter, null gives null."""
    x, y = F.lower(a), F.lower(b)
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    n = F.length(short)
    return ((n == 1) | (n >= 3) | ((n > 0) & (n == F.length(long) - 1))) & long.startswith(short)


def in_list(listed: Column, value: Column, separator: str = ";") -> Column:
    """Whether a separated list has a value as a whole entry; spaces around entries don't count."""
    return F.array_contains(F.transform(F.split(listed, re.escape(separator)), lambda v: F.trim(v)), value)


def format_share(c: Column, places: int = 1) -> Column:
    """A share as a percentage text; null stays null."""
    return F.concat(F.format_number(c * 100, places), F.lit("%"))


def clean_column_name(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_")
