"""Quality rules from tokeniser fertility.

A public sentence-piece vocabulary with byte fallback is applied to every word
of a text.  Three measures follow: characters per token, the share of tokens
that are byte fallbacks, and the entropy of the text's token distribution in
bits, divided by the greatest value that its number of tokens allows.  Each has
a rejection band for the document's language; a language without bands of its
own takes those of the script most of its letters belong to.

Within these fixed bands a language with ``LEAST_DOCS`` documents or more has
narrower ones, measured over all documents that pass the base rule: medians less
or more so many quartile ranges.  As the measures spread and the entropy falls
with the length of a text, medians and ranges are taken for each half octave of
tokens and carried on in between; of entropy only a low one rejects.  The byte
share has its fixed band only.

Base counts (words, symbols, repeated lines and words) come with the verdict.

Edge cases: null and empty texts have no words and fail the base rule; a null or
unknown language uses script bands; every row has a result, repeated or not;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text_hash import chunks, inside, mix, windows, words_of
from .word_cache import WordCache

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"

#: Fixed values: (least, most) characters per token, greatest byte-fallback share, least relative entropy.
LANGUAGE_BANDS = {
    "en": (1.25, 6.5, 0.10, 0.30),
    "de": (1.15, 6.5, 0.12, 0.30),
    "fr": (1.15, 6.5, 0.12, 0.30),
    "es": (1.15, 6.5, 0.12, 0.30),
}
SCRIPT_BANDS = {
    "latin": (1.1, 8.0, 0.20, 0.25),
    "cyrillic": (1.0, 8.0, 0.30, 0.25),
    "greek": (0.8, 8.0, 0.40, 0.25),
    "cjk": (0.3, 4.0, 0.90, 0.20),
    "other": (0.25, 10.0, 0.98, 0.15),
}
#: Documents of a language, and of a half octave of tokens, that make a measured band; quartile ranges from its median.
LEAST_DOCS, LEAST_SPAN = 100, 20
ENTROPY_RANGES, CHARS_RANGES = 2.0, 5.0
#: Steps of the counted measures.
ENTROPY_STEP, CHARS_STEP = 0.002, 0.005
#: First and last code point of the blocks by which a script is told.
SCRIPT_RANGES = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)),
    "greek": ((0x370, 0x3FF),),
    "cyrillic": ((0x400, 0x52F),),
    "cjk": ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF)),
}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def script_of(text: str) -> str:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    votes = {name: int(sum(((points >= a) & (points <= b)).sum() for a, b in ranges)) for name, ranges in SCRIPT_RANGES.items()}
    best = max(votes, key=votes.get)
    return best if votes[best] else "other"


class Fertility(WordCache):
    """Pieces of words; made once in each Python worker."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.model = model
        self.is_byte = np.fromiter((model.is_byte(i) for i in range(n)), bool, n)
        opens = np.fromiter((model.id_to_piece(i).startswith("\u2581") for i in range(n)), bool, n)
        super().__init__(model.encode, opens, mark="\u2581")


@dataclass(frozen=True)
class MeasuredBand:
    """Of one language: by log2 of tokens the medians and quartile ranges of characters per token and of relative entropy."""

    at: tuple[float, ...]
    chars: tuple[float, ...]
    chars_range: tuple[float, ...]
    entropy: tuple[float, ...]
    entropy_range: tuple[float, ...]

    def fits(self, n_tokens: int, per_token: float, relative: float) -> bool:
        if not self.at:
            return True
        x, at, y = float(np.log2(max(1, n_tokens))), self.at, self.entropy
        middle = float(np.interp(x, at, y))
        if len(at) > 1 and x > at[-1]:
            middle += min(0.0, (y[-1] - y[-2]) / (at[-1] - at[-2])) * (x - at[-1])
        far = abs(per_token - float(np.interp(x, at, self.chars))) > CHARS_RANGES * float(np.interp(x, at, self.chars_range))
        return not far and relative >= middle - ENTROPY_RANGES * float(np.interp(x, at, self.entropy_range))


def _quartiles(steps: pd.Series, n: pd.Series, step: float) -> tuple[float, float]:
    """Median and quartile range of counted values, the range at least one step."""
    order = np.argsort(steps.to_numpy(), kind="stable")
    upto = np.cumsum(n.to_numpy()[order])
    low, middle, high = (steps.to_numpy()[order][np.searchsorted(upto, q * upto[-1])] * step for q in (0.25, 0.5, 0.75))
    return float(middle), float(max(high - low, step))


_models: dict[str, Fertility] = {}


def measures(texts: list[str | None], path: str, languages: list[str | None] | None = None, bands: dict[str, MeasuredBand] | None = None) -> pd.DataFrame:
    """All counts, measures and verdicts of a batch, in its order; without ``bands`` by the fixed ones alone."""
    if path not in _models:
        _models[path] = Fertility(path)
    model = _models[path]
    rows = []
    for s in chunks(texts):
        part = texts[s]
        n_docs = len(part)
        words = words_of(part)
        n = words.count
        repeated = np.zeros(n_docs, np.int64)
        ok = np.flatnonzero(inside(words, 5))
        if len(ok):
            with np.errstate(over="ignore"):
                key = mix(windows(words.hash, 5)[ok] + words.doc[ok].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            ordered = np.sort(key)
            twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
            if len(twice):
                at = ok[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
                cover = np.zeros(len(words.doc) + 6, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + 5, -1)
                covered = np.cumsum(cover)[: len(words.doc)] > 0
                repeated = np.bincount(words.doc[covered], minlength=n_docs)
        ids, each = model.tokens(words) if len(words.hash) else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
        owner = np.repeat(words.doc, each)
        n_tokens = np.bincount(owner, minlength=n_docs)
        n_bytes = np.bincount(owner[model.is_byte[ids]], minlength=n_docs)
        pairs = np.sort((owner.astype(np.uint64) << np.uint64(16)) | ids)
        head = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, np.int64)
        times = np.diff(np.r_[head, len(pairs)])
        of = (pairs[head] >> np.uint64(16)).astype(np.int64)
        with np.errstate(divide="ignore", invalid="ignore"):
            entropy = np.log2(np.maximum(n_tokens, 1)) - np.bincount(of, times * np.log2(np.maximum(times, 1)), minlength=n_docs) / np.maximum(n_tokens, 1)
            relative = np.where(n_tokens > 1, entropy / np.log2(np.maximum(np.minimum(n_tokens, len(model.is_byte)), 2)), 1.0)
        for i, text in enumerate(part):
            text = text or ""
            chars = len(text) - sum(map(text.count, SPACES))
            lines = [x for x in text.split("\n") if x.strip(SPACES)]
            symbols = sum(map(text.count, SYMBOLS))
            base_failed = bool(n[i] < 10 or 100 * repeated[i] > 20 * n[i])
            per_token = chars / n_tokens[i] if n_tokens[i] else 0.0
            share = n_bytes[i] / n_tokens[i] if n_tokens[i] else 0.0
            language = languages[s][i] if languages is not None else None
            band = LANGUAGE_BANDS.get(language) or SCRIPT_BANDS[script_of(text)]
            fits = band[0] <= per_token <= band[1] and share <= band[2] and relative[i] >= band[3]
            measured = (bands or {}).get(language)
            if measured is not None:
                fits = fits and measured.fits(n_tokens[i], per_token, relative[i])
            rows.append((int(n[i]), chars, symbols, len(lines) - len(set(lines)), int(repeated[i]), base_failed, bool(fits and not base_failed), int(n_tokens[i]), per_token, float(share), float(entropy[i]), float(relative[i])))
    return pd.DataFrame(rows, columns=FIELDS)


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "token_entropy", "relative_entropy"]
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_share double, token_entropy double, relative_entropy double"


def fertility_column(text, language, vocabulary: str | None = None, bands: dict[str, MeasuredBand] | None = None):
    """A struct column with FIELDS; no shuffle, so a filter on it keeps the other columns as they are."""
    path = vocabulary or default_vocabulary()

    @F.pandas_udf(SCHEMA)
    def judge(texts: pd.Series, languages: pd.Series) -> pd.DataFrame:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return measures(texts.tolist(), path, languages.tolist(), bands)

    # So declared, it is not worked out once more for a filter on the verdict.
    return judge.asNondeterministic()(text, language)


def measured_bands(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", vocabulary: str | None = None) -> dict[str, MeasuredBand]:
    """The bands of each language, from counts of the rounded measures of all documents within the fixed bands."""
    language = F.col(lang_col).cast("string")
    seen = docs.select(language.alias("lang"), fertility_column(F.col(text_col), language, vocabulary).alias("q")).filter("lang is not null")
    span = F.floor(2 * F.log2("q.n_tokens")).cast("int").alias("span")
    seen = seen.filter("q.kept").select("lang", F.explode(F.array(
        F.struct(span, F.lit(0).alias("what"), F.round(F.col("q.relative_entropy") / ENTROPY_STEP).cast("int").alias("step")),
        F.struct(span, F.lit(1).alias("what"), F.round(F.col("q.chars_per_token") / CHARS_STEP).cast("int").alias("step")),
    )).alias("v")).groupBy("lang", "v.span", "v.what", "v.step").agg(F.count("*").alias("n"))
    counts = seen.withColumn("_all", F.sum("n").over(Window.partitionBy("lang"))).filter(F.col("_all") >= 2 * LEAST_DOCS).drop("_all").toPandas()
    bands = {}
    for name, own in counts.groupby("lang"):
        found = []
        for span, part in own.groupby("span"):
            entropy, chars = part[part.what == 0], part[part.what == 1]
            if entropy.n.sum() >= LEAST_SPAN:
                found.append(((span + 0.5) / 2, *_quartiles(chars.step, chars.n, CHARS_STEP), *_quartiles(entropy.step, entropy.n, ENTROPY_STEP)))
        bands[name] = MeasuredBand(*(tuple(c) for c in zip(*found))) if found else MeasuredBand((), (), (), (), ())
    return bands


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", vocabulary: str | None = None) -> DataFrame:
    """``doc_id`` and FIELDS for each row of ``docs``; reads them twice, first for the measured bands."""
    language = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    bands = measured_bands(docs, text_col, lang_col, vocabulary) if lang_col else {}
    judged = docs.select(F.col(id_col).cast("long").alias("doc_id"), fertility_column(F.col(text_col), language, vocabulary, bands).alias("q"))
    return judged.select("doc_id", "q.*")
