"""Main text of web pages from flat text blocks.

A page is taken apart into blocks of text between block-level tags. A block is
described by its number of words and its link density, those of the blocks
before and after it, the share of the page's words that its container holds, and
by what it stands in: HTML's own elements, and as a weak hint the parts of class
names; a decision tree, trained on a small labelled table (html_labelled.py), keeps
it or drops it.

Null and empty pages have the empty text; equal page_ids are each answered, a null
page_id stays null. Missing end tags, stray tags and unclosed comments are borne with.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_labelled import pages

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.S,
)
_RAW = frozenset("script style title textarea template svg math iframe noscript noembed noframes object applet canvas audio video select datalist button".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_WALLS = frozenset("ul ol dl table menu nav div section article aside body".split())
#: HTML's own elements for what isn't the article; a header is one of them outside an article only.
_OFF_TAGS = frozenset("nav aside footer menu dialog fieldset label".split())
_MAIN_TAGS = frozenset(("article", "main"))
_HOLDS = frozenset("div section td body li details".split())
_ATTR = re.compile(r"\b(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none", re.I)
_PART = re.compile(r"[A-Z]?[a-zà-ÿ]+|[A-Z]+")
#: Parts of names that hint at something else than the article, and parts that say nothing.
_OFF_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu topbar toolbar breadcrumb breadcrumbs sidebar rail footer colophon masthead header cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin register comment comments commentlist respond reply replies disqus discussion share sharing social related recommended recommendations trending widget pagination pager copyright legal disclaimer skip search form paywall contentinfo complementary".split()
)
_EMPTY_WORDS = frozenset("box wrap wrapper container inner outer block area section item list top bottom left right unit slot bar site page wide small large buttons icons".split())
_NAMED_MAIN = frozenset("article content entry post story main maincontent articlebody".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "has_article", "held", "held_above", "off", "hint", "heading", "item")


def _hint(attrs: str) -> tuple[float, bool]:
    """How far an element's names hint at something else than the article: of the parts of one name that say anything, the share that does; and whether one names the article."""
    most, main = 0.0, False
    for m in _ATTR.finditer(attrs):
        for name in (m[2] or m[3] or m[4] or "").split():
            parts = [w.lower() for w in _PART.findall(name)]
            parts = [w for w in parts if w not in _EMPTY_WORDS]
            if parts:
                most = max(most, sum(w in _OFF_WORDS for w in parts) / len(parts))
                main = main or all(w in _NAMED_MAIN for w in parts)
    return most, main


class _Open(NamedTuple):
    """An open element, with what it has from those around it."""

    tag: str
    off: bool = False
    form: bool = False
    hint: float = 0.0
    article: int = -1  # number of the outermost article element, -1 for none
    main: bool = False
    holder: int = 0  # number of the nearest container, and of the one around it
    above: int = -1


def blocks(page: str) -> list[dict]:
    """The text blocks of a page in order: text, words, linked words, and what they stand in."""
    out: list[dict] = []
    stack: list[_Open] = [_Open("")]
    count: Counter = Counter()
    shut_from: dict[str, bool] = {}
    buf: list[str] = []
    linked: list[str] = []
    in_link = numbers = 0
    at, n = 0, len(page)
    begun: set[int] = set()  # articles that have a block already

    def flush():
        if not buf:
            return
        text = " ".join(html.unescape("".join(buf)).split())
        if text:
            top = stack[-1]
            links = len(html.unescape(" ".join(linked)).split())
            if top.hint <= 0.5 and not top.off:
                begun.add(top.article)
            out.append({
                "text": text, "words": len(text.split()), "linked": links, "off": top.off or top.form, "hint": top.hint, "article": top.article, "main": top.main,
                "holder": top.holder, "above": top.above, "heading": top.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), "item": "li" in (top.tag, stack[-2].tag if len(stack) > 1 else ""),
            })
        buf.clear()
        linked.clear()

    def add(piece: str):
        buf.append(piece)
        if in_link:
            linked.append(piece)

    def close(i: int):
        for gone in stack[i:]:
            count[gone.tag] -= 1
        del stack[i:]

    for m in _TOKEN.finditer(page):
        start = m.start()
        if start < at:
            continue
        if start > at:
            add(page[at:start])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:-3]))
            continue
        tag, end, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in _RAW:
            if end or attrs.endswith("/"):
                continue
            found = None if shut_from.get(tag) else _closing(tag).search(page, at)
            if not found:
                shut_from[tag] = True  # nor is there one further on
            at = found.end() if found else (n if tag in ("script", "style") else at)
            add(" ")
            continue
        if tag == "a":
            in_link = 0 if end else 1
            continue
        if tag == "br":
            add(" ")
            continue
        if tag == "hr" or tag in _BLOCK:
            flush()
        else:
            if tag == "head" and end:
                buf.clear()
            continue
        if tag in _VOID:
            continue
        if end:
            if count[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close(i)
            in_link = 0 if tag != "p" else in_link
            continue
        if stack[-1].tag == "p":
            close(len(stack) - 1)
        shut = _CLOSES.get(tag)
        if shut and any(count[t] for t in shut):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in shut:
                    close(i)
                    break
                if stack[i].tag in _WALLS:
                    break
        up = stack[-1]
        named, main = _hint(attrs) if attrs and "=" in attrs and tag not in ("body", "html") else (0.0, False)
        inside = tag in _MAIN_TAGS or main and tag in ("div", "section", "td")
        off = up.off or tag in _OFF_TAGS or tag == "header" and up.article < 0 and not up.main or bool(attrs and _HIDDEN.search(attrs))
        # the first h1 of an article is its headline, whatever the elements between are called
        above = 0.0 if tag == "h1" and up.article >= 0 and up.article not in begun else up.hint
        numbers += 1
        stack.append(_Open(
            tag, off, (up.form or tag == "form") and tag not in _MAIN_TAGS, max(above, named), numbers if up.article < 0 and inside and tag != "main" else up.article,
            up.main or inside, *((numbers, up.holder) if tag in _HOLDS or inside else (up.holder, up.above)),
        ))
        count[tag] += 1
    if at < n:
        add(page[at:])
    flush()
    return out


@cache
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)


def features(found: list[dict]) -> np.ndarray:
    """One row of FEATURES for each block.

    article: 0 outside an article element; inside, its share of the words in such
    elements, those of main outside any article taken together. held, held_above:
    the share of the page's unlinked words in the nearest container and in the one
    around it (0 for the whole page).
    """
    n = len(found)
    if not n:
        return np.empty((0, len(FEATURES)))
    col = lambda k: np.array([b[k] for b in found], float)
    words, linked = col("words"), col("linked")
    links = linked / words
    before, after = lambda x: np.append(0.0, x[:-1]), lambda x: np.append(x[1:], 0.0)
    off, hint = col("off"), col("hint")
    group = np.array([b["article"] if b["article"] >= 0 else (0 if b["main"] else -1) for b in found])
    inside = (group >= 0) & (off == 0) & (hint <= 0.5)
    _, of = np.unique(group, return_inverse=True)
    share = np.bincount(of, np.where(inside, words, 0))
    article = np.where(group >= 0, share[of] / max(1.0, words[inside].sum()), 0.0)
    plain = np.maximum(words - linked, 0)
    total = max(1.0, plain.sum())
    held: Counter = Counter()
    up = {b["holder"]: b["above"] for b in found}
    for b, w in zip(found, plain.tolist(), strict=True):
        held[b["holder"]] += w
    own = dict(held)
    for h, a in up.items():  # a container holds what the containers in it hold, one level down
        held[a] += own[h]
    near = np.array([held[b["holder"]] / total for b in found])
    above = np.array([held[b["above"]] / total if b["above"] > 0 else 0.0 for b in found])
    return np.stack([words, links, before(words), before(links), after(words), after(links), article, np.full(n, float(inside.any())), near, above, off, hint, col("heading"), col("item")], axis=1)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A decision tree by Gini impurity: nested (feature, threshold, left, right), leaves 0 or 1."""
    if depth == 0 or y.min() == y.max():
        return int(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= t
            a, b = y[left], y[~left]
            gini = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, float(t), left)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, t, left = best
    return (f, t, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1))


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages; a block's text begins with + if it belongs to the article, with - if not."""
    xs, ys = [], []
    for page in pages():
        found = blocks(page)
        ys += [b["text"][0] == "+" for b in found]
        xs.append(features(found))
    return np.concatenate(xs), np.array(ys, float)


@cache
def trained():
    return grow(*labelled())


def decide(tree, row) -> int:
    while isinstance(tree, tuple):
        f, t, left, right = tree
        tree = left if row[f] <= t else right
    return tree


def main_text(page: str | None, tree=None) -> str:
    """The blocks that the tree keeps, joined by one newline."""
    if not page:
        return ""
    found = blocks(page)
    tree = trained() if tree is None else tree
    return "\n".join(b["text"] for b, row in zip(found, features(found).tolist(), strict=True) if decide(tree, row))


def _extract(batches, tree):
    for batch in batches:
        texts = [main_text(h, tree) for h in batch.column(batch.schema.get_field_index("html")).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(table: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of table (page_id, url, html); other columns are left out."""
    tree = trained()
    return table.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(lambda b: _extract(b, tree), "page_id long, url string, text string, n_chars long")
