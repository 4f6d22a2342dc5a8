"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of each text are one pass over its bytes.  On a bounded sample of
labelled rows shallow boosted trees are grown; every path from a root to a node
becomes a rule, a conjunction of comparisons; a logistic regression with a lasso
penalty gives most rules no weight; the rest is compiled into one Spark column
expression over the statistics, which scores all rows.

Edge cases: null and empty texts have all statistics 0 and are scored like any
other; with no usable labels, or labels of one class only, the score is that
class's share (0.5 without labels); other columns are ignored; every row has a
result, repeated or not; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import MOST_LABELS, held_out, training_texts
from .text_hash import chunks, inside, mix, windows, words_of

STATISTICS = [
    "words", "word_length", "symbols_per_word", "marks_per_word", "bars_per_word", "upper_share", "digit_share", "stops_per_word",
    "other_bytes_share", "lines_per_word", "repeated_lines_share", "distinct_share", "repeated_windows_share", "longest_word",
]
SCHEMA = ", ".join(f"{s} double" for s in STATISTICS)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[list(chars.encode())] = 1
    return out


_CLASSES = {
    "symbols": _table("#*$%&<>@^~={}[]\\"), "marks": _table("!?"), "bars": _table("|"), "upper": _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digits": _table("0123456789"), "stops": _table(".,;:"), "lines": _table("\n"),
}


def statistics(texts: list[str | None]) -> pd.DataFrame:
    """STATISTICS of each text, in order."""
    frames = []
    for s in chunks(texts):
        part = [t or "" for t in texts[s]]
        n_docs = len(part)
        words = words_of(part)
        n = words.count.astype(float)
        per = np.maximum(n, 1)
        raw = [t.encode("utf-8", "surrogatepass") + b" " for t in part]
        sizes = np.fromiter(map(len, raw), np.int64, n_docs)
        starts = np.cumsum(sizes) - sizes
        buf = np.frombuffer(b"".join(raw), np.uint8)
        total = np.maximum(sizes - 1, 1)
        hits = {k: np.add.reduceat(t[buf], starts).astype(float) for k, t in _CLASSES.items()}
        hits["other"] = np.add.reduceat((buf >= 0xC0).astype(np.float32), starts).astype(float)
        lengths = np.diff(words.at) if words.at is not None else np.zeros(0)
        letters = np.bincount(words.doc, lengths, minlength=n_docs)
        longest = np.zeros(n_docs)
        np.maximum.at(longest, words.doc, lengths)
        with np.errstate(over="ignore"):
            salt = mix(np.arange(n_docs, dtype=np.uint64), 5)
            distinct = np.bincount(words.doc[np.unique(words.hash ^ salt[words.doc], return_index=True)[1]], minlength=n_docs) if len(words.hash) else np.zeros(n_docs)
            ok = np.flatnonzero(inside(words, 5))
            again = np.zeros(n_docs)
            if len(ok):
                key = np.sort((windows(words.hash, 5)[ok] & np.uint64(0xFFFFFFFFFF)) | (words.doc[ok].astype(np.uint64) << np.uint64(40)))
                again = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(40)).astype(np.int64), minlength=n_docs)
        lines = [[x for x in t.split("\n") if x and not x.isspace()] for t in part]
        same = np.array([len(x) - len(set(x)) for x in lines], float) / np.maximum([len(x) for x in lines], 1)
        frames.append(pd.DataFrame({
            "words": n, "word_length": letters / per, "symbols_per_word": hits["symbols"] / per, "marks_per_word": hits["marks"] / per,
            "bars_per_word": hits["bars"] / per, "upper_share": hits["upper"] / total, "digit_share": hits["digits"] / total,
            "stops_per_word": hits["stops"] / per, "other_bytes_share": hits["other"] / total, "lines_per_word": hits["lines"] / per,
            "repeated_lines_share": same, "distinct_share": distinct / per, "repeated_windows_share": again / per, "longest_word": longest,
        }))
    return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(columns=STATISTICS, dtype=float)


def statistics_column(text) -> Column:
    """STATISTICS as a struct column."""

    @F.pandas_udf(SCHEMA)
    def measure(texts: pd.Series) -> pd.DataFrame:
        return statistics(texts.tolist())

    return measure(text)


#: One comparison: statistic, whether it is "at most" (else "over"), threshold.
Test = tuple[str, bool, float]


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[tuple[Test, ...], float]]

    def column(self, value) -> Column:
        """The score as a Spark expression; ``value`` gives the column of a statistic."""
        logit = F.lit(float(self.intercept))
        for tests, weight in self.rules:
            held = None
            for name, low, cut in tests:
                test = value(name) <= F.lit(cut) if low else value(name) > F.lit(cut)
                held = test if held is None else held & test
            logit = logit + F.when(held, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))

    def score(self, x: pd.DataFrame) -> np.ndarray:
        logit = np.full(len(x), self.intercept)
        for tests, weight in self.rules:
            logit += weight * _holds(x, tests)
        return 1 / (1 + np.exp(-logit))


def _holds(x: pd.DataFrame, tests: tuple[Test, ...]) -> np.ndarray:
    held = np.ones(len(x), bool)
    for name, low, cut in tests:
        held &= (x[name].to_numpy() <= cut) if low else (x[name].to_numpy() > cut)
    return held


def _grow(x: pd.DataFrame, cuts: dict[str, np.ndarray], codes: dict[str, np.ndarray], residual: np.ndarray, hessian: np.ndarray, depth: int, least: int):
    """One tree: the tests of all its nodes, and the step of every row."""
    step, found = np.zeros(len(residual)), []
    todo = [(np.arange(len(residual)), ())]
    while todo:
        rows, tests = todo.pop()
        g, h = residual[rows].sum(), hessian[rows].sum()
        step[rows] = g / (h + 1.0)
        if len(tests) == depth or len(rows) < 2 * least:
            continue
        best = (1e-3, None, 0)
        for name in STATISTICS:
            bins = len(cuts[name]) + 1
            if bins < 2:
                continue
            c = codes[name][rows]
            left_g, left_h = (np.cumsum(np.bincount(c, w[rows], minlength=bins))[:-1] for w in (residual, hessian))
            left_n = np.cumsum(np.bincount(c, minlength=bins))[:-1]
            gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
            gain[(left_n < least) | (len(rows) - left_n < least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], name, k)
        if best[1] is None:
            continue
        _, name, k = best
        goes = codes[name][rows] <= k
        for low, part in ((True, rows[goes]), (False, rows[~goes])):
            path = (*tests, (name, low, float(cuts[name][k])))
            found.append(path)
            todo.append((part, path))
    return found, step


def fit_rules(x: pd.DataFrame, y: np.ndarray, trees: int = 25, depth: int = 3, penalty: float = 5e-4) -> RuleModel:
    """Trees, rules, lasso; deterministic."""
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return RuleModel(float(np.log(share / (1 - share))), [])
    cuts, codes = {}, {}
    for name in STATISTICS:
        v = x[name].to_numpy()
        edges = np.unique(np.quantile(v, np.r_[np.linspace(0.02, 0.98, 49), 0.005, 0.995], method="nearest"))
        above = np.searchsorted(np.unique(v), edges, side="right")
        values = np.unique(v)
        cuts[name] = np.array([(values[i - 1] + values[i]) / 2 for i in above if i < len(values)])
        codes[name] = np.searchsorted(cuts[name], v, side="left")
    least = max(3, len(y) // 1000)
    logit = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    paths: dict[tuple, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        found, step = _grow(x, cuts, codes, y - p, p * (1 - p), depth, least)
        paths.update(dict.fromkeys(tuple(sorted(f)) for f in found))
        logit += 0.3 * np.clip(step, -4, 4)
        if not found:
            break
    columns, rules = [], []
    seen = set()
    for tests in paths:
        held = _holds(x, tests)
        key = held.tobytes()
        if 0 < held.mean() < 1 and key not in seen:
            seen.add(key)
            columns.append(held)
            rules.append(tests)
    if not rules:
        return RuleModel(float(logit.mean()), [])
    z = np.stack(columns, axis=1).astype(float)
    mean = z.mean(axis=0)
    z -= mean
    weight, bias = np.zeros(z.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    rate = 4.0 / max(1e-9, np.linalg.eigvalsh(z.T @ z / len(y))[-1] + 1)
    ahead, ahead_b, t = weight.copy(), bias, 1.0
    for _ in range(400):  # accelerated proximal steps
        p = 1 / (1 + np.exp(-(ahead_b + z @ ahead)))
        new = ahead - rate * (z.T @ (p - y)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = ahead_b - rate * float((p - y).mean())
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / t_next * (new - weight), new_b + (t - 1) / t_next * (new_b - bias)
        weight, bias, t = new, new_b, t_next
    kept = np.flatnonzero(np.abs(weight) > 1e-3)
    return RuleModel(bias - float(mean[kept] @ weight[kept]), [(rules[i], float(weight[i])) for i in kept])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELS) -> RuleModel:
    sample = training_texts(docs, labels, label, id_col, text_col, most)
    rows = sample.select("doc_id", "label", statistics_column("text").alias("s")).select("doc_id", "label", "s.*").toPandas()
    rows = rows.sort_values(["doc_id", *STATISTICS]).reset_index(drop=True)
    return fit_rules(rows[STATISTICS], rows.label.to_numpy())


def score_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", cut: float = 0.7, most: int = MOST_LABELS
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` and the statistics for each row of ``docs``."""
    model = train(docs, labels, label, id_col, text_col, most)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), statistics_column(F.col(text_col)).alias("s")).select("doc_id", "s.*")
    scored = base.withColumn("score", model.column(F.col))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), *STATISTICS)
