"""Markup that is not well formed, names that only may mark boilerplate, path ratios without names; bounds under repeated rows."""

import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.llm import best_fit_packing, html_extract
from panelweave.llm.best_fit_packing import pack_documents
from panelweave.llm.html_extract import MARKED, MAYBE, PLAIN, _marks, main_text
from panelweave.llm.labelled import training_texts

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, words int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", None, 0, 0.5, 1) for d, t in rows], DOC)


@pytest.mark.parametrize("tag", [
    "<p data-x=it's>", '<p class="a"b">', "<p class='a'b'>", '<p title=a"b>', "<p 'x'>", "<p = x>", "<p ==x>", "<p x= >", '<p class="a"id="b">', "<p/>", "<p a='>' b=\">\">", '<p title="open>', "<p data-id=menu aria-label=footer>",
])
def test_stray_quotes_take_no_text(tag):
    page = f"<article><h1>Title</h1>{tag}It's the first sentence.</p><p>Don't stop here.</p><p>The last one isn't short.</p></article>"
    assert main_text(page) == "Title\nIt's the first sentence.\nDon't stop here.\nThe last one isn't short."


def test_comments_and_ends():
    assert main_text("<p>a, b.</p><!--><p>c, d.</p><!---><p>e.</p><!-- x --!><p>f.</p></ x><p>g.</p></><p class='h") == "a, b.\nc, d.\ne.\nf.\ng."
    assert main_text("<p>a.<script>'</scripts>'</script x><p>b.") == "a.\nb."


def test_marks_by_their_place_in_a_name():
    for name in ("comments", "fb-comments", "commentList", "ad-300x250", "related-articles", "site-footer", "cookie_notice", "share-buttons"):
        assert _marks(name) == MARKED, name
    for name in ("share-price", "comment-on-budget", "notice-period"):
        assert _marks(name) == MAYBE, name
    for name in ("content", "headline", "no-comments", "ad-free", "author-note", ""):
        assert _marks(name) == PLAIN, name


def test_text_under_a_describing_mark_goes_by_path_and_links():
    prose = "".join(f"<p>Paragraph {i} of the article, which has some words, and ends as it should.</p>" for i in range(4))
    price = "<div class=share-price><p>The share price fell by five per cent, as all had thought, and rose again.</p></div>"
    links = "<div class=share-ideas><a href=x>Send it</a> <a href=y>Print it</a></div>"
    comments = "<div class=fb-comments><p>I liked this, really, very much so, and so did my friends.</p></div>"
    got = main_text(f"<body><article><h1>Title</h1>{prose}{price}{links}{comments}<p>The end, at last, of it all.</p></article></body>").split("\n")
    assert got[0] == "Title" and len(got) == 7 and got[5].startswith("The share price") and got[6].startswith("The end")


def renamed(page):
    """Nothing tells the article: all classes alike, articles are plain containers."""
    return re.sub(r"<(/?)(article|main)\b", r"<\1div", re.sub(r"class=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "class=zq", page))


def test_path_ratios_find_the_article_without_names(monkeypatch):
    """On at least 95 % of pages without names the text is that of the page with names; without the threshold, or with chance in its place, it isn't."""
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html.tolist()
    want = [main_text(p) for p in pages]
    bare = [renamed(p) for p in pages]
    equal = lambda **how: np.mean([main_text(p, **how) == w for p, w in zip(bare, want)])
    assert equal() >= 0.95 and equal(cut=0.0) < 0.05
    rng = np.random.default_rng(3)
    monkeypatch.setattr(html_extract, "content_paths", lambda rows, cut: tuple(np.array([rng.random(len(rows)) < 0.5] * 3)))
    assert equal() < 0.7


def test_repeated_rows_are_dealt_into_groups(spark, monkeypatch):
    """A row that is all of the table is packed in groups under the bound, whole and without clashes."""
    monkeypatch.setattr(best_fit_packing, "GROUP", 500)
    n = 4000
    docs = spark.range(0, n, 1, 4).select(F.lit(7).cast("long").alias("doc_id"), F.lit("seven words stand in this short row").alias("text"), F.lit(1).alias("part"), F.lit(2).alias("number"))
    got = pack_documents(docs).toPandas()
    assert len(got) == n and not got.duplicated(["sequence_id", "offset"]).any()
    per = got.groupby(got.sequence_id // 2**32).size()
    assert len(per) == 8 and per.max() < 700
    assert (got.groupby("sequence_id").length.sum() <= 1024).all()


def test_sample_has_one_row_for_each_id(spark):
    """However many rows and texts an id has, the sample holds one, the same at each run; repeated labels count once."""
    rows = [(i % 3, f"text {i}") for i in range(3000)] + [(i, "own") for i in range(10, 60)] + [(61, None), (None, "no id")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(70)] * 2 + [(11, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    first, again = ({(r.doc_id, r.text, r.label) for r in training_texts(frame(spark, some), labels, "quality", "doc_id", "text").collect()} for some in (rows, rows[::-1]))
    assert first == again and max(Counter(d for d, _, _ in first).values()) == 1
    assert 11 not in {d for d, _, _ in first} and all(d % 2 == y for d, _, y in first)
    assert training_texts(frame(spark, rows), labels, "quality", "doc_id", "text", most=5).count() <= 5


def test_clauses_decide_pairs(spark):
    """Texts with the same insults or threats, apart by negation, target or reporting alone, lie on both sides of the cut."""
    from panelweave.llm.toxicity_grammar import train

    d = "/root/testdata/sf0.1"
    grammar = train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    score = lambda text: float(grammar.score(np.array([grammar.features(text)]))[0])
    for toxic, clean in [
        ("You are an idiot.", "You are not an idiot."), ("You are an idiot.", "She said you are an idiot."), ("I will kill you.", "I will kill time."),
        ("I will kill you.", "I will not kill you."), ("I will kill you.", "He said he will kill you."), ("Du bist ein idiot.", "Du bist kein idiot."),
    ]:
        assert score(clean) < 0.3 <= score(toxic), (toxic, score(toxic), clean, score(clean))
