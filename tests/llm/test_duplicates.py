"""Jaccard join and substring dedup against brute force, and edge cases."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import Row

from panelweave.llm.jaccard_join import jaccard_classes
from panelweave.llm.substring_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, node string, key_a int"


def words(t):
    return WORD.findall(t or "")


def brute_classes(rows, t=0.8):
    sets = {}
    for d, x in rows:
        w = words(x)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids, parent, links = sorted(sets), {d: d for d in sets}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= t * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (find(d), links[d]) for d in ids}


def brute_repeats(rows, k=35):
    seen = Counter(tuple(w[i : i + k]) for _, x in rows for w in [words(x)] for i in range(len(w) - k + 1))
    out = []
    for d, x in rows:
        w = words(x)
        gone = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        kept = " ".join(y for i, y in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tricky(spark):
    near = [f"w{i}" for i in range(60)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one  two"), (6, "two one"), (6, "two one"), (7, "a " * 400), (8, "b a " * 60)]
    for k in range(450):  # a group that takes several blocks
        rows.append((100 + k, " ".join(near[: 55 + k % 5] + [f"t{k % 7}"])))
    rows += [(900, "é " + " ".join(near[3:50])), (901, " ".join(f"x{i}" for i in range(30_000)))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, x, "clash", 1) for d, x in rows], SCHEMA)


def test_classes_equal_brute_force(spark, tricky):
    rows = [r for r in dict(tricky).items()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_classes(frame(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_classes_on_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard_classes(docs).collect()} == brute_classes(rows)


def test_classes_edge_rows(spark, tricky):
    assert jaccard_classes(frame(spark, [])).count() == 0
    got = jaccard_classes(frame(spark, [(None, "p q r"), (3, "p q r"), (None, None), (4, "x"), (4, "x")])).collect()
    assert sorted(map(str, got)) == sorted(map(str, [
        Row(doc_id=None, class_id=3, n_links=1), Row(doc_id=3, class_id=3, n_links=1), Row(doc_id=None, class_id=None, n_links=0),
        Row(doc_id=4, class_id=4, n_links=1), Row(doc_id=4, class_id=4, n_links=1),
    ]))


@pytest.mark.parametrize("width", [35, 7])
def test_repeats_equal_brute_force(spark, tricky, width):
    rows = [*tricky, (None, "n " * 50), (None, "n " * 50)]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(frame(spark, rows), width=width, anchor=min(12, width - 2)).collect()]
    assert sorted(got, key=str) == brute_repeats(rows, width)


def test_repeats_on_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(docs).collect()]
    assert sorted(got, key=str) == brute_repeats([(r.doc_id, r.text) for r in docs.collect()])


def test_repeats_spans_and_text(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "a b " + passage + " c"), (2, passage + " d"), (3, "z")]
    got = {r.doc_id: r for r in remove_repeats(frame(spark, rows), with_text=True).collect()}
    assert [(s.begin, s.end) for s in got[1].removed] == [(2, 62)] and got[1].kept_text == "a b c"
    assert got[2].kept_text == "d" and got[3].removed == []
    assert remove_repeats(frame(spark, [])).count() == 0


def test_null_and_repeated_ids(spark):
    """Null ids link like others; a repeated id with another text joins no group through its first."""
    w = [f"u{i}" for i in range(200)]
    other = [f"v{i}" for i in range(200)]
    texts = [(1, w), (None, w[:198] + ["a", "b"]), (None, w[:198] + ["c", "d"]), (5, w[:199] + ["e"]), (5, other), (2, other[:199] + ["f"]), (7, ["only"])]
    rows = [(d, " ".join(x)) for d, x in texts]
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_classes(frame(spark, rows)).collect())
    assert got == Counter([(1, 1, 3), (None, 1, 3), (None, 1, 3), (5, 1, 3), (5, 2, 1), (2, 2, 1), (7, 7, 0)])
    groups = {(r.doc_id, r.class_id): r.group for r in jaccard_classes(frame(spark, [(3, "a b c"), (3, "x y z"), (None, "p q"), (None, "r s")]), with_keys=True).collect()}
    assert len(set(groups.values())) >= 2


def test_stage_keeps_repeated_ids_with_other_texts(spark, sf):
    import corpus_pipeline as P

    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (1, "a b c d e f g"), (None, "o p q r s t u"), (None, "o p q r s t u"), (2, "h i j k l m n"), (None, "v w x y z")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = Counter((r.doc_id, r.text) for r in P.near_duplicate_stage(spark, docs, sf).collect())
    assert kept == Counter([(1, "a b c d e f g"), (1, "h i j k l m n"), (None, "o p q r s t u"), (None, "v w x y z")])


def test_unkindred_texts_stay_apart(spark):
    """Pairs at similarity about 0.3 hardly ever meet in a band, so a chain of them is no group."""
    import numpy as np

    from panelweave.llm.jaccard_join import minhash, shingle_sets, BANDS, ROWS_PER_BAND

    rng = np.random.default_rng(2)
    met = 0
    for _ in range(300):
        common, a, b = (rng.integers(0, 1 << 40, n) for n in (170, 200, 200))
        texts = [" ".join(map(str, [*common, *x])) for x in (a, b)]
        grams, first = shingle_sets(texts)
        x, y = minhash(grams, first)
        met += bool((x == y).reshape(BANDS, ROWS_PER_BAND).all(axis=1).any())
    assert met < 40
