"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text nodes, each with its root-to-leaf path of
tags (containers carry their class or id).  For every path the text length and
the punctuation are added up and divided by its number of nodes; the two ratios
are smoothed along the page, fused by their product, and paths over a threshold
are content and stay.  The element that holds most of the content text is the
article: its other blocks belong to it too, unless they are mostly links.  Where
no tag names the article, sentences in paragraphs of the containers beside that
element belong to it as well; so does any heading right before a block that stays.

Elements whose tag, role, class or id says that they are menus, page headers and
footers, sidebars, notices, adverts, forms or comments don't count.  Such a mark
is evidence, not proof: an element that holds most of the page's text keeps it if
it also holds its first heading or article, or, unless its tag says what it is, if
hardly any text would be left.
Names such as ``has-sidebar``, ``no-comments`` or ``ad-free`` mark nothing; in names
such as ``share-price`` or ``comment-on-budget`` the mark only describes another
word, and the element goes unless most of its text is on content paths, by their
ratios, and not in links.

Edge cases: null and empty pages and pages without text give an empty string;
text outside any element counts as a block; unclosed and crossed tags are
closed as browsers do; scripts, styles and comments without an end run to the
end of the page; repeated rows are each extracted; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Set
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by what they do.
VOID = set("area base br col embed frame hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template iframe object svg math canvas select textarea button head title audio video".split())
BOILERPLATE = set("nav footer aside form header dialog menu".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of a class or id that mark an element as no part of an article.
MARKS = set(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup paywall sidebar sidebars rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar footer foot colophon "
    "masthead topbar comment comments commentlist disqus respond replies reply related recommended recommendations share sharing social login search copyright skip".split()
)
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
#: Beginnings and ends of a name that say that an element goes with or without what the name names.
BESIDE = (set("has no with without not is".split()), set("free enabled disabled less off on ready".split()))
PUNCTUATION = ".,;:!?…。、，！？；：¿¡"

#: Words of a class or id that say what part of a layout an element is, and not what it is about.
LAYOUT = set(
    "area article articles aside author bar block body bottom box button buttons card center col column container content date desktop div element embed entry first fixed form grid group head heading "
    "icon icons id info inline inner item items js label last layer left line link links list main meta mobile module outer page panel part post posts primary right row second secondary section site "
    "slot small sticky stories story tab tabs text title toggle tools top unit view wrap wrapper".split()
)

RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in ("script", "style", "textarea", "title", "noscript", "iframe")}
# A quote opens a value only right after an equals sign; elsewhere it is part of a name or of a bare value, as is one that nothing closes.
_VALUE = r"\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)"
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(.*?)(?:\]\]>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]++(?:{_VALUE})?+|=)*+)(?:>|\Z)"
    r"|<[!?][^>]*>|</(?:[^a-zA-Z>][^>]*)?>|([^<]+|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(=?[^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")

#: How far a name marks an element as boilerplate: not at all, perhaps, surely.
PLAIN, MAYBE, MARKED = range(3)


def _marks(name: str) -> int:
    """How far a class or id marks boilerplate.

    It does if the last word that isn't one of layout or a number is a mark, as in
    ``fb-comments`` or ``comment-list-2``; a mark that only describes another
    word, as in ``share-price``, may have that meaning or not.
    """
    words = [w for w in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
    if not words or words[0] in BESIDE[0] or words[-1] in BESIDE[1] or MARKS.isdisjoint(words):
        return PLAIN
    told = [w for w in words if w not in LAYOUT and not w[0].isdigit()]
    return MARKED if told[-1] in MARKS else MAYBE


def _describe(attributes: str) -> tuple[str, int, bool]:
    """The class or id for the path, how far it marks boilerplate, and whether the element isn't shown."""
    name, marked, hidden, seen = "", PLAIN, False, set()
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in seen:
            continue  # of a repeated attribute the first counts
        seen.add(key)
        if key == "hidden":
            hidden = True
        elif key == "aria-hidden":
            hidden |= value.lower() == "true"
        elif key == "role":
            marked = MARKED if value.lower() in ROLES else marked
        elif key in ("class", "id"):
            name = name or value
            marked = max([marked, *map(_marks, value.split())])
    return name, marked, hidden


class Page:
    """Text nodes of a page, the tree of its tag paths, and its marked elements."""

    def __init__(self, page: str):
        #: Of each text node: block, path, whether in a link, raw text, marked element around it.
        self.nodes: list[tuple[int, int, bool, str, int]] = []
        #: Of each path: the path without its last step, and that step.  Path 0 is empty; later paths have greater numbers than their beginnings.
        self.parent, self.step = [0], [""]
        self._path: dict[tuple[int, str], int] = {}
        #: Of each marked element: the marked element around it, and the first headings and unmarked articles that begin in it.  0 is the page.
        self.around, self.anchors = [0], [0]
        #: Marked articles, which tell where the text is on pages without others.
        self.articles = [0]
        #: Whether its tag itself says what it is, and whether it is one at all or only may be.
        self.by_tag, self.maybe = [False], [False]
        self._read(page)

    def path(self, parent: int, step: str) -> int:
        known = self._path.get((parent, step))
        if known is None:
            known = self._path[parent, step] = len(self.parent)
            self.parent.append(parent)
            self.step.append(step)
        return known

    def _read(self, page: str) -> None:
        # Of each open element: tag, and of it and its ancestors: never counts, counts in headings only, has a heading, has a link,
        # has an article, path, innermost marked element.
        ground = ("", False, False, False, False, False, 0, 0)
        stack: list[tuple] = []
        top, out, block, at = ground, self.nodes, 0, 0
        match, n = _TOKEN.match, len(page)
        while at < n:
            m = match(page, at)
            if m is None:
                at += 1
                continue
            at = m.end()
            text = m[5]
            if text is None and m[1] is not None:
                text = m[1].replace("&", "&amp;")
            if text is not None:
                if not top[1] and (not top[2] or top[3]):
                    out.append((block, top[6], top[4], text, top[7]))
                continue
            tag = m[3]
            if not tag:
                continue
            tag = tag.lower()
            if m[2]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        block += any(s[0] not in INLINE for s in stack[k:])
                        del stack[k:]
                        top = stack[-1] if stack else ground
                        break
                continue
            if tag in RAW:
                end = RAW[tag].search(page, at)
                at = end.end() if end else n
                continue
            if tag == "br":
                if out and out[-1][0] == block:
                    out.append((block, top[6], False, " ", top[7]))
                continue
            block += tag not in INLINE
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] not in INLINE:
                        break
            if tag in SIBLINGS:
                ends, scope = SIBLINGS[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in scope:
                        break
                    if stack[k][0] in ends:
                        del stack[k:]
                        break
            top = stack[-1] if stack else ground
            if tag in VOID:
                continue
            name, marked, hidden = _describe(m[4]) if m[4] else ("", PLAIN, False)
            head = tag == "header" or "header" in name.lower()
            dead, half, element = tag in HIDDEN or hidden, False, top[7]
            sure = tag in BOILERPLATE or marked == MARKED and tag not in ("html", "body") or "header" in name.lower().split()
            if sure or marked and tag not in ("html", "body"):
                half = sure and top[5] and head
                if not half:
                    self.around.append(element)
                    self.anchors.append(0)
                    self.articles.append(0)
                    self.by_tag.append(tag in BOILERPLATE)
                    self.maybe.append(not sure)
                    element = len(self.around) - 1
            if tag == "h1" or tag in ("article", "main") and not marked:
                self.anchors[element] += 1
            elif tag in ("article", "main"):
                self.articles[element] += 1
            step = f"{tag}.{name}" if name and tag not in ("html", "body", "p", "a") else tag
            top = (tag, top[1] or dead, top[2] or half, top[3] or tag in HEADINGS, top[4] or tag == "a", top[5] or tag in ("article", "main"), self.path(top[6], step), element)
            stack.append(top)

    def boilerplate(self, cleared: Set[int]) -> list[bool]:
        """Of each marked element: whether its mark, or one around it, holds; those in ``cleared`` are none."""
        size, anchors, articles = [0] * len(self.around), list(self.anchors), list(self.articles)
        for _, _, link, text, element in self.nodes:
            size[element] += 0 if link else len(text.strip())
        for k in range(len(size) - 1, 0, -1):
            size[self.around[k]] += size[k]
            anchors[self.around[k]] += anchors[k]
            articles[self.around[k]] += articles[k]
        out = [False] * len(size)
        for k in range(1, len(size)):
            alone = not anchors[0] and (articles[k] > 0 or not self.by_tag[k] and 5 * size[k] > 4 * size[0])
            most = 2 * size[k] > size[0] and (anchors[k] > 0 or alone)
            out[k] = out[self.around[k]] or not most and k not in cleared
        return out


#: Elements that are too narrow to hold an article.
_NO_ROOT = HEADINGS | {"p", "ul", "ol", "dl", "table", "blockquote", "pre", "figure", "li"} | INLINE


#: Times the threshold that a path's own score must reach for text before the title and outside of the content element.
OUT_OF_PLACE = 3.0


def _smooth(x: np.ndarray) -> np.ndarray:
    kernel = np.array([0.06, 0.24, 0.4, 0.24, 0.06])
    if len(x) < 3:
        return x
    return np.convolve(np.pad(x, 2, mode="edge"), kernel, "valid")


def _blocks(read: Page, cleared: Set[int]) -> list[tuple[str, int, float, int]]:
    """Blocks of words between two boundaries of block elements: text, path, share in links, marked element."""
    gone = read.boilerplate(cleared)
    blocks: dict[int, dict] = {}
    for block, path, link, raw, element in read.nodes:
        if gone[element]:
            continue
        text = unescape(raw)
        b = blocks.setdefault(block, {"raw": [], "paths": defaultdict(int), "link": 0, "size": 0, "element": element})
        size = len(text.strip())
        b["raw"].append(text)
        b["paths"][path] += size
        b["size"] += size
        b["link"] += size * link
    rows = []
    for number in sorted(blocks):
        b = blocks[number]
        text = " ".join("".join(b["raw"]).split())
        if text:
            rows.append((text, max(b["paths"], key=b["paths"].get), b["link"] / max(1, b["size"]), b["element"]))
    return rows


def content_paths(rows: list[tuple[str, int, float, int]], cut: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each block whether its path is content, by ratios over the page's nodes, smoothed in page order, fused and thresholded; whether it is so by its own ratios too, and whether these are so high that place doesn't matter."""
    length, marks, times = defaultdict(float), defaultdict(float), defaultdict(int)
    for text, path, link, _ in rows:
        length[path] += len(text) * (1 - link)
        marks[path] += sum(map(text.count, PUNCTUATION))
        times[path] += 1
    by_length = np.array([length[p] / times[p] for _, p, _, _ in rows])
    by_marks = np.array([(marks[p] + 0.5) / times[p] for _, p, _, _ in rows])
    fused = np.sqrt(_smooth(by_length) * _smooth(by_marks))
    weight = np.array([len(t) for t, _, _, _ in rows], float)
    score = defaultdict(float)
    for f, (_, path, _, _) in zip(fused, rows):
        score[path] = max(score[path], f)
    values = np.array([score[p] for _, p, _, _ in rows])
    level = min(values.max() * cut, 2 * cut * np.average(values, weights=weight))
    own = np.sqrt(by_length * by_marks)
    return values >= level, own >= level, own >= OUT_OF_PLACE * level


def _cleared(read: Page, cut: float) -> Set[int]:
    """Elements that may be boilerplate by name and aren't: most of their text is on content paths and not in links."""
    unsure = {k for k, maybe in enumerate(read.maybe) if maybe}
    rows = _blocks(read, unsure) if unsure else []
    if not rows:
        return unsure
    size, good = defaultdict(float), defaultdict(float)
    for keep, (text, _, link, element) in zip(content_paths(rows, cut)[0], rows):
        while element:
            size[element] += len(text)
            good[element] += len(text) * bool(keep and link < 0.3)
            element = read.around[element]
    return {k for k in unsure if 2 * good[k] > size[k]}


def main_text(page: str | None, cut: float = 0.5) -> str:
    """The blocks of the article, joined by line feeds; paths with less than ``cut`` of the best score are never content."""
    if not page:
        return ""
    read = Page(page)
    rows = _blocks(read, _cleared(read, cut))
    if not rows:
        return ""
    content, alone, high = content_paths(rows, cut)
    weight = np.array([len(t) for t, _, _, _ in rows], float)
    # The deepest element that holds nearly all of the content text.
    n, parent = len(read.parent), read.parent
    tag = [s.split(".")[0] for s in read.step]
    below = [0.0] * n
    for keep, w, (_, path, _, _) in zip(content, weight, rows):
        below[path] += w * keep
    for k in range(n - 1, 0, -1):
        below[parent[k]] += below[k]
    heaviest = [0] * n
    for k in range(1, n):
        if below[k] > (below[heaviest[parent[k]]] if heaviest[parent[k]] else 0.0):
            heaviest[parent[k]] = k
    # Titles by the elements around them: one that holds the page's titles needs only the greater part of the text.
    titles, title_at = [0] * n, -1
    for k in range(n - 1, 0, -1):
        titles[k] += tag[k] == "h1"
        titles[parent[k]] += titles[k]
    root = 0
    while heaviest[root] and tag[heaviest[root]] not in _NO_ROOT:
        into = heaviest[root]
        if below[into] < (0.5 if titles[0] and titles[into] == titles[0] else 0.9) * below[0]:
            break
        root = into
        if tag[root] in ("article", "main"):
            break
    named, article = tag[root] in ("article", "main"), tag[root] == "article"
    around = root if named else parent[root]
    within, beside, in_p, in_heading = [not root], [not around], [False], [False]
    for k in range(1, n):
        p = parent[k]
        within.append(within[p] or k == root)
        beside.append(beside[p] or k == around)
        in_p.append(in_p[p] or tag[k] == "p" and beside[p])
        in_heading.append(in_heading[p] or tag[k] in HEADINGS)
    # Before the title and outside of the element that holds it, an article seldom has text, so the score of a path must be higher there.
    if titles[root]:
        title_at = next((i for i, (_, path, _, _) in enumerate(rows) if within[path] and in_heading[path]), -1)
    stays = []
    for i, (keep, (text, path, link, _)) in enumerate(zip(content, rows)):
        sentence = link < 0.3 and in_p[path] and len(text.split()) > 4 and any(c in PUNCTUATION for c in text)
        stays.append(bool(keep and (within[path] or (alone[i] if i > title_at else high[i])) or within[path] and (article or link < 0.6) or beside[path] and sentence))
    for k in range(len(rows) - 2, -1, -1):
        _, path, link, _ = rows[k]
        stays[k] |= stays[k + 1] and link < 0.6 and in_heading[path]
    return "\n".join(text for stay, (text, _, _, _) in zip(stays, rows) if stay)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = [main_text(h) for h in pdf.html]
        yield pd.DataFrame({"page_id": pdf.page_id, "url": pdf.url, "text": texts, "n_chars": [len(t) for t in texts]})


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` for each row of ``pages``; no shuffle."""
    base = pages.select(F.col(id_col).cast("long").cast("string").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = base.mapInPandas(_extract, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))
