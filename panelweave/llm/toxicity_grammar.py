"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as a string of word classes: insult, threat, target, negation,
reported speech, other.  Each of five small transducers follows one of these and
multiplies the weight of what it reads; their composition is one table, walked
once over a clause.  A text's score is a logistic function of the weights of its
matched clauses, never of single words.

Insults are a trie of words and word beginnings with weights.  Besides a short
fixed list they are learned from a bounded sample of labelled rows.  A word is
taken if a fair share of different toxic texts has it and clean texts hardly do;
a beginning if that holds for texts with two or more different longer words that
start so, as an inflected insult shows in several endings and chance doesn't.

Edge cases: null and empty texts have no clause and get the score of a text
without matches; without usable labels the fixed list and coefficients serve;
other columns are ignored; every row has a result; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import MOST_LABELS, held_out, training_texts

#: Words of each class in English, German, French and Spanish; a star stands for any ending.
INSULTS = "idiot* moron* imbecil* stupid stupide* estupid* dumm* dämlich* scum loser* pathetic worthless disgusting trash arschloch* miststück* abschaum* connard* salaud* ordure* imbécile* gilipollas* cabrón* asshole* bastard* bitch* scumbag*".split()
THREATS = "kill* murder* destroy* stab* shoot* töte* umbringen erschieß* tuer tuerai buter matar* mataré".split()
TARGETS = "you your you're u he she they him her them du dich dir ihr euch sie er tu te toi vous ton il elle ils tú usted ustedes él ella".split()
NEGATIONS = "not no never isn't aren't wasn't don't without nicht kein keine nie ne pas jamais aucun no nunca jamás sin".split()
REPORTS = "said says say called calls quoted according alleged reportedly sagte sagt nannte zufolge angeblich dit disait appelé selon dijo dice llamó según".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
FEATURES = ("total", "strongest", "matches", "variety")
FEATURE_SCHEMA = ", ".join(f"{name} double" for name in FEATURES)
#: Lengths of the beginnings that are tried.
BEGINNINGS = (4, 5, 6, 7, 8)
_CLAUSE = re.compile(r"[.,;:!?\n]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


@dataclass(frozen=True)
class Transducer:
    """Arcs: (state, symbol) -> (next state, factor); what has no arc stays and multiplies by 1."""

    states: int
    arcs: dict[tuple[int, int], tuple[int, float]]
    #: (state, symbol) whose weight waits, and those that let what waits count; it is lost in a state that ``waits`` doesn't have.
    holds: frozenset = frozenset()
    frees: frozenset = frozenset()
    waits: frozenset = frozenset()

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        return self.arcs.get((state, symbol), (state, 1.0))


def _negation(reach: int = 3) -> Transducer:
    """For ``reach`` words after a negation an insult or threat counts for a third."""
    arcs = {}
    for s, x in product(range(reach + 1), range(6)):
        arcs[s, x] = (reach if x == NEGATION else max(0, s - 1), 1 / 3 if s and x in (INSULT, THREAT) else 1.0)
    return Transducer(reach + 1, arcs)


def _reported() -> Transducer:
    """After a verb of saying, to the end of the clause, matches count for a half."""
    return Transducer(2, {(s, x): (1 if s or x == REPORT else 0, 0.5 if s and x in (INSULT, THREAT) else 1.0) for s in (0, 1) for x in range(6)})


def _target() -> Transducer:
    """An insult after a target counts for more."""
    return Transducer(2, {(s, x): (1 if s or x == TARGET else 0, 1.25 if s and x == INSULT else 1.0) for s in (0, 1) for x in range(6)})


def _threat(reach: int = 3) -> Transducer:
    """A threat counts only beside a target: after it in the clause, or if one follows within ``reach`` words."""
    # 0: no target yet, 1: target read, 2 and more: a threat waits for a target among so many words and one less.
    arcs = {(s, x): (1 if s == 1 or x == TARGET else reach + 1 if x == THREAT else s - 1 if s > 2 else 0, 1.0) for s in range(reach + 2) for x in range(6)}
    pending = frozenset(range(2, reach + 2))
    return Transducer(reach + 2, arcs, frozenset((s, THREAT) for s in (0, *pending)), frozenset((s, TARGET) for s in pending), pending)


def _insult() -> Transducer:
    """Further insults of a clause count for half as much each, down to a quarter."""
    return Transducer(3, {(s, INSULT): (min(2, s + 1), (1.0, 0.5, 0.25)[s]) for s in range(3)})


HOLD, FREE = 1, 2


def compose(parts: list[Transducer]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The product machine as tables of next states, factors and what is held or freed, and whether a state keeps what is held."""
    spaces = list(product(*(range(t.states) for t in parts)))
    number = {s: i for i, s in enumerate(spaces)}
    follow, factor = np.zeros((len(spaces), 6), np.int32), np.ones((len(spaces), 6))
    act = np.zeros((len(spaces), 6), np.int32)
    for s, i in number.items():
        for x in range(6):
            moves = [t.step(a, x) for t, a in zip(parts, s)]
            follow[i, x] = number[tuple(m[0] for m in moves)]
            factor[i, x] = float(np.prod([m[1] for m in moves]))
            act[i, x] = HOLD * any((a, x) in t.holds for t, a in zip(parts, s)) + FREE * any((a, x) in t.frees for t, a in zip(parts, s))
    waits = np.array([any(a in t.waits for t, a in zip(parts, s)) for s in spaces])
    return follow, factor, act, waits


@dataclass
class Grammar:
    weights: dict[str, float]  # insult words, beginnings ("abc*") and beginnings of longer words only ("abc+")
    coefficients: tuple[float, ...] = (-4.0, 2.0, 0.5, 0.5, 0.5)
    threat: float = 3.0  # weight of a threat
    follow: list = field(default_factory=list)
    factor: list = field(default_factory=list)
    act: list = field(default_factory=list)
    waits: list = field(default_factory=list)

    def __post_init__(self) -> None:
        follow, factor, act, waits = compose([_insult(), _threat(), _target(), _negation(), _reported()])
        self.follow, self.factor, self.act, self.waits = follow.tolist(), factor.tolist(), act.tolist(), waits.tolist()
        self.words = {w: (INSULT, v) for w, v in self.weights.items() if w[-1] not in "*+"}
        self.begins = {w[:-1]: (INSULT, v) for w, v in self.weights.items() if w[-1] in "*+"}
        # A bare beginning of longer words is no insult by itself.
        self.words |= {w[:-1]: (OTHER, 0.0) for w in self.weights if w.endswith("+") and w[:-1] not in self.words}
        for symbol, names in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            for w in names:
                (self.begins if w.endswith("*") else self.words).setdefault(w.rstrip("*"), (symbol, self.threat))
        self.spans = sorted({len(w) for w in self.begins})

    def classify(self, word: str) -> tuple[int, float]:
        found = self.words.get(word)
        if found:
            return found
        for n in self.spans:
            if n > len(word):
                break
            found = self.begins.get(word[:n])
            if found:
                return found
        return OTHER, 0.0

    def automaton(self):
        """Finds texts that may hold an insult or a threat; all others have no matched clause."""
        import ahocorasick

        a = ahocorasick.Automaton()
        for w, (symbol, _) in [*self.words.items(), *self.begins.items()]:
            if symbol in (INSULT, THREAT):
                a.add_word(w, 1)
        a.make_automaton()
        return a

    def clauses(self, text: str) -> list[tuple[float, str]]:
        """Matched clauses with their weights."""
        return [(weight, clause) for weight, clause, _ in self._matches(text)]

    def _matches(self, text: str) -> list[tuple[float, str, list[str]]]:
        out = []
        for clause in _CLAUSE.split(text.lower()):
            state, weight, read = 0, 0.0, []
            held, names = 0.0, []
            for raw in clause.split():
                word = raw if raw.isalpha() else _EDGE.sub("", raw)
                symbol, value = self.classify(word)
                act = self.act[state][symbol]
                if act == HOLD:
                    held += value * self.factor[state][symbol]
                    names.append(word)
                elif act == FREE:
                    weight += held
                    read += names
                    held, names = 0.0, []
                elif symbol in (INSULT, THREAT):
                    weight += value * self.factor[state][symbol]
                    read.append(word)
                state = self.follow[state][symbol]
                if held and not self.waits[state]:
                    held, names = 0.0, []
            if weight > 0:
                out.append((weight, clause.strip(), read))
        return out

    def features(self, text: str) -> tuple[float, ...]:
        """FEATURES of a text: summed weight, greatest weight and number of its different matched clauses, different insults and threats in them."""
        found = list({clause: (weight, clause, read) for weight, clause, read in self._matches(text)}.values())
        if not found:
            return (0.0,) * len(FEATURES)
        w = [x for x, _, _ in found]
        return float(np.log1p(sum(w))), max(w), float(np.log1p(len(w))), float(np.log1p(len({x for _, _, read in found for x in read})))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.coefficients[0] + x @ np.array(self.coefficients[1:]), -30, 30)))


def _terms(text: str) -> set[str]:
    """Words of a text, and beginnings of two or more different longer words."""
    words = {raw if raw.isalpha() else _EDGE.sub("", raw) for raw in set(text.lower().split())}
    words = {w for w in words if w.isalpha() and len(w) > 2}
    begins = Counter(w[:n] + "+" for w in words for n in BEGINNINGS if n < len(w))
    return words | {b for b, n in begins.items() if n > 1}


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        toxic, clean = Counter(), Counter()
        for text, label in zip(pdf.text, pdf.label):
            (toxic if label else clean).update(_terms(text))
        if toxic or clean:
            names = list(toxic.keys() | clean.keys())
            yield pd.DataFrame({"term": names, "toxic": [toxic[t] for t in names], "clean": [clean[t] for t in names]})


def learn_weights(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Log odds of words and beginnings; of those that overlap the one that tells most (support times log odds, then the longer).

    All terms that qualify are taken; the sample's bound bounds them.
    """
    least = max(3, round(0.02 * n_toxic))
    counts = (
        sample.mapInPandas(_count_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .withColumn("weight", F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0)))
        .filter((F.col("toxic") >= least) & (F.col("weight") >= 3.0) & (F.col("clean") * 4 <= F.col("toxic")))
        .withColumn("tells", F.col("toxic") * F.col("weight")).orderBy(F.desc("tells"), F.desc(F.length("term")), "term")
    )
    out: dict[str, float] = {}
    for r in counts.collect():
        stem = r.term.rstrip("+")
        covered = any(stem[:n] + "+" in out for n in BEGINNINGS if n <= len(stem))
        if not covered and not (r.term.endswith("+") and any(t.startswith(stem) for t in out)):
            out[r.term] = float(r.weight)
    return out


#: The least coefficient of the summed weight, so that a clause that weighs less scores less.
LEAST_TOTAL = 0.25


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a small ridge, by Newton steps, in which no feature lowers the score.

    A coefficient that would fall under its bound is set to it and left out of
    the next fit, until none does.
    """
    z = np.c_[np.ones(len(x)), x]
    ridge = np.diag([1e-6, *[1e-2] * x.shape[1]])
    bound = np.array([-np.inf, LEAST_TOTAL, *[0.0] * (x.shape[1] - 1)])
    free, beta = np.ones(z.shape[1], bool), np.zeros(z.shape[1])
    while True:
        beta[free] = 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            zf, rf = z[:, free], ridge[np.ix_(free, free)]
            beta[free] += np.linalg.solve(zf.T @ (zf * (p * (1 - p))[:, None]) + rf + 1e-9 * np.eye(free.sum()), zf.T @ (y - p) - rf @ beta[free])
        low = free & (beta < bound)
        if not low.any():
            return tuple(float(b) for b in beta)
        beta[low] = bound[low]
        free &= ~low


def _features(batches: Iterator[pd.DataFrame], grammar: Grammar) -> Iterator[pd.DataFrame]:
    finder = grammar.automaton()
    for pdf in batches:
        rows = []
        for text in pdf.text:
            text = (text or "").lower()
            rows.append(grammar.features(text) if text and next(finder.iter(text), None) else (0.0,) * len(FEATURES))
        x = np.array(rows, float).reshape(len(rows), len(FEATURES))
        yield pd.DataFrame({"doc_id": pdf.doc_id} | {name: x[:, i] for i, name in enumerate(FEATURES)})


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELS) -> Grammar:
    seeds = dict.fromkeys(INSULTS, 3.0)
    # Copies of one text with one label count once, as the smallest id.
    sample = training_texts(docs, labels, label, id_col, text_col, most)
    sample = sample.groupBy(F.xxhash64("text").alias("k"), "label").agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id"))
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Grammar(seeds)
    learned = learn_weights(sample.select("text", "label"), sizes[1], sizes[0])
    # Labels tell the weights of insults; a threat weighs as much as the middle one of them, so both are on one scale.
    grammar = Grammar(seeds | learned, threat=max(3.0, float(np.median(list(learned.values())))) if learned else 3.0)
    rows = sample.select("doc_id", "text", "label").join(
        sample.select("doc_id", "text").mapInPandas(lambda it: _features(it, grammar), f"doc_id long, {FEATURE_SCHEMA}"), "doc_id"
    ).select("doc_id", "label", *FEATURES).toPandas().sort_values("doc_id")
    grammar.coefficients = _fit(rows[list(FEATURES)].to_numpy(), rows.label.to_numpy(float))
    return grammar


def score_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3, most: int = MOST_LABELS
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` and the clause features (FEATURES) for each row of ``docs``."""
    grammar = train(docs, labels, label, id_col, text_col, most)
    base = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    found = base.mapInPandas(lambda it: _features(it, grammar), f"doc_id string, {FEATURE_SCHEMA}")
    logit = F.lit(grammar.coefficients[0])
    for name, weight in zip(FEATURES, grammar.coefficients[1:]):
        logit = logit + F.lit(weight) * F.col(name)
    scored = found.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("score", 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit)))))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), *FEATURES)
