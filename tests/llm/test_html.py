"""Main text of pages: against a reader of the pages table written with html.parser, hand-made pages of many forms, and odd markup."""

import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import types as T

from kinograph.llm import html_blocks

SF = "/root/testdata/sf0.01"
LONG = "it was a long day by the sea and we went on until the light of the evening had gone from the hills"


class _Reader(HTMLParser):
    """The text of article elements, a line for each paragraph or heading."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.now, self.inside = [], [], False

    def cut(self):
        line = " ".join("".join(self.now).split())
        self.now = []
        if line:
            self.lines.append(line)

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        elif tag in ("p", "h1", "footer"):
            self.cut()
            self.inside = self.inside and tag != "footer"
        elif tag == "br":
            self.now.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.cut()
            self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.now.append(data)


def _read(page):
    r = _Reader()
    r.feed(page or "")
    r.close()
    r.cut()
    return "\n".join(r.lines)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF}/pages.parquet").collect()


def test_every_page_of_the_table(spark, rows):
    got = sorted(html_blocks.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect())
    assert got == sorted((r.page_id, r.url, t, len(t)) for r in rows for t in [_read(r.html)]) and len(got) > 200


def test_names_of_classes_decide_little(rows):
    """A tree that never sees them keeps the same blocks."""
    x, y = html_blocks.labelled()
    at = html_blocks.FEATURES.index("hint")
    x[:, at] = 0
    tree = html_blocks.grow(x, y)
    for r in rows:
        found = html_blocks.blocks(r.html or "")
        given = html_blocks.features(found)
        given[:, at] = 0
        assert "\n".join(b["text"] for b, f in zip(found, given.tolist(), strict=True) if html_blocks.decide(tree, f)) == html_blocks.main_text(r.html)


def test_tree_of_the_labelled_table():
    x, y = html_blocks.labelled()
    assert len(y) > 300 and [html_blocks.decide(html_blocks.trained(), r) for r in x.tolist()] == y.tolist()
    # held out: a tree grown from half of the table is right on most of the rest
    half = np.arange(len(y)) % 4 < 2
    tree = html_blocks.grow(x[half], y[half])
    assert np.mean([html_blocks.decide(tree, r) == k for r, k in zip(x[~half].tolist(), y[~half], strict=True)]) > 0.93


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<nav><a>one</a> <a>two</a></nav><div class=werbung>Jetzt kaufen und sparen</div><article><h1>Head</h1><p>{LONG}</p><p>Of.</p></article><div class=kommentare><p>{LONG}</p></div>", ["Head", LONG, "Of."]),
        (f"<article class=ad-free-article><h1>Head</h1><div class=header-image><p>a hill</p></div><p>{LONG}</p></article><footer>me</footer>", ["Head", "a hill", LONG]),
        (f"<main><article><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></article><section class=zwei><div><p>I liked it.</p></div></section></main>", ["Head", LONG, LONG]),
        (f"<article><h1>Head</h1><p>{LONG}</p><aside>{LONG}</aside><div class=ad>Buy</div><form><p>Your name</p></form><p>End.</p><footer>by me</footer></article>", ["Head", LONG, "End."]),
        (f"<div class=a><a>home</a> <a>news</a></div><div class=b><h1>A heading here</h1><p>{LONG}</p><p>{LONG} {LONG}</p><p>{LONG}</p></div><div class=c><a>privacy</a></div>", ["A heading here", LONG, f"{LONG} {LONG}", LONG]),
        (f"<article><h1>Head</h1><p>{LONG}</p></article><section id=comments><article class=comment><p>{LONG}</p></article></section>", ["Head", LONG]),
        (f"<form id=all><header><p>Site</p></header><article><p>{LONG}</p></article></form>", [LONG]),
    ],
)
def test_forms_of_pages(page, want):
    assert html_blocks.main_text(page).split("\n") == want


@pytest.mark.parametrize("n", [900, 1500, 5000, 40_000])
def test_depth_changes_nothing(n):
    page = f"<article><p>{LONG}</p></article>" + "<div>" * 1200 + "<aside>" + "<div>" * n + "side" + "</div>" * n + "</aside>" + "</div>" * 1200
    assert html_blocks.main_text(page) == LONG
    assert html_blocks.main_text("<article>" + "<div>" * n + LONG + "</div>" * n + "</article>") == LONG


def test_odd_markup_takes_linear_time():
    began = time.time()
    for page in ("<svg>" * 60_000, "<button>" * 60_000, "<div>" * 60_000 + "</nope></li>" * 60_000, "<li>x" * 60_000, "<!-- open " + "x" * 1_000_000, "<a href='" * 60_000):
        html_blocks.main_text(page)
    assert time.time() - began < 60


def test_odd_tables(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.StringType())])
    rows = [(1, "u", f"<article><p>{LONG}", "clash", "clash"), (1, "u", f"<article><p>{LONG}", "clash", "clash"), (None, None, "<article><p>é</article>", None, None), (3, "v", None, "", ""), (4, "v", "", "", "")]
    got = sorted(html_blocks.extract(spark.createDataFrame(rows, schema)).collect(), key=str)
    assert got == sorted([(1, "u", LONG, len(LONG)), (1, "u", LONG, len(LONG)), (None, None, "é", 1), (3, "v", "", 0), (4, "v", "", 0)], key=str)
    assert html_blocks.extract(spark.createDataFrame([], schema)).count() == 0


def test_a_headline_outweighs_the_names_around_it():
    """The first h1 of an article stays under a name that hints at something else; a later one, or one in an advert's own heading, doesn't."""
    prose = "<p>" + "The river rose again in the night and the men went out to the bridge. " * 4 + "</p>"
    page = lambda inner: f"<html><body><nav><a href=x>Home</a></nav><article>{inner}</article><footer>Contact us</footer></body></html>"
    text = html_blocks.main_text(page(f"<div class=header><h1>Title here</h1></div>{prose}"))
    assert text.startswith("Title here\nThe river rose")
    assert html_blocks.main_text(page(f"{prose}<div class=sponsor><h1>Buy this now</h1></div>{prose}")).count("Buy this") == 0
    assert html_blocks.main_text(page(f"<div class=sponsor><h3>Buy this now</h3></div><h1>Title here</h1>{prose}")).startswith("Title here\n")
