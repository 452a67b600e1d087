"""Line blocks: windows against brute force, hand-labelled pages with and without frames, broken markup, linear time."""

import random
import time

import pytest

from cellmorph.llm import html_text
from cellmorph.llm.html_text import main_text, stretches
from cellmorph.llm.queries import QUERIES

LINKS = "<ul><li><a href=1>One<li><a href=2>Two</a><li><a href=3>Three</a></ul>"
TEXT = "".join(f"<p>Paragraph {i} of the body has a good many words.</p>" for i in range(4))
WANT = [f"Paragraph {i} of the body has a good many words." for i in range(4)]


def by_windows(weights, window):
    """Every window looked at: a line is kept from the first weighing line on, until a whole window from it has no weight."""
    kept, on = [], False
    for i in range(len(weights)):
        if sum(weights[i : i + window]) == 0:
            on = False
        elif weights[i] > 0:
            on = True
        if on:
            kept.append(i)
    return kept


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_stretches_equal_all_windows(window):
    rng = random.Random(window)
    for _ in range(500):
        w = [rng.choice([0, 0, 0, 1, 50]) for _ in range(rng.randrange(30))]
        assert [i for a, b in stretches(w, window) for i in range(a, b)] == by_windows(w, window)


@pytest.mark.parametrize(
    "page,want",
    [
        ('<article><p class="ad">Buy now<p>Real text.<p>More text.</article>', ["Real text.", "More text."]),
        ("<article><ul><li class=ad>Buy<li>First point.<li>Second one.</ul><dl><dt class=promo>x<dd>Meaning.</dl></article>", ["First point.", "Second one.", "Meaning."]),
        ("<article><table><tr><td class=ad>Buy<td>Cell.<tr><td>Next.</table></article>", ["Cell.", "Next."]),
        ('<article><div class="skip"><p>One two.</p></div><p class="tags legal reply-intro">Three four.</p></article>', ["One two.", "Three four."]),
        (f"<article><header>{'word ' * 9000}<h1>Title</h1></header><p>Body.</p></article>", [("word " * 9000).strip(), "Title", "Body."]),
        ("<article><header><h2>T</h2><nav><a>x</a></nav></header><p>Body.</p></article>", ["Body."]),
        (f"<article>{TEXT}{LINKS}<p>Last words.</p></article>", [*WANT, "Last words."]),
        (f"<article>{TEXT}<p><a href=1>A line of nothing but a link</a></p><p>Last words.</p></article>", [*WANT, "A line of nothing but a link", "Last words."]),
        (f"<div>{TEXT}{LINKS}<p>Short last paragraph.</p></div>", [*WANT, "Short last paragraph."]),
        (f"<div>Menu</div>{LINKS}<h2><a href=1>A title</a></h2>{TEXT}{LINKS}<p>Top of page</p>", ["A title", *WANT]),
        (f'<div class="sidebar-layout">{TEXT}<div class="sidebar"><p>Side text.</p></div></div>', WANT),
        (f"<form id=page>{TEXT}<input><form><p>Mail us now.</p></form></form>", WANT),
        (f'<div class="ad"><p>{"An advert longer than the article. " * 9}</p></div><article><p>Short.</p></article>', ["Short."]),
        (f"<p title='{'<b>' * 3000}'>All of it is here.</p>", ["All of it is here."]),
        ("<p>İİİ one two three.<header>x</header><article><header><h1>İ</h1></header>Text of the article.</article>", ["İ", "Text of the article."]),
        ("<p hidden>No.<p>Yes it is here.<p style='display: none'>No.<p aria-hidden=true>No.", ["Yes it is here."]),
        ("<p>Words <span class=ad>Buy</span> go on.", ["Words go on."]),
        ("<p>a &lt; b &amp;&nbsp;c</p>", ["a < b & c"]),
    ],
)
def test_pages_by_hand(page, want):
    assert main_text(page) == "\n\n".join(want)


def test_windows_decide_in_framed_pages():
    page = f"<article>{TEXT}{LINKS}<p>Last words.</p></article>"
    assert "Two" not in main_text(page) and "Two" in main_text(page, window=9)


@pytest.mark.parametrize(
    "page",
    ["<p>" + "<b>x" * 40_000, "a " + "<" * 80_000, '<a href="' * 40_000, "<a " + "x" * 200_000 + ">y", "<li><ul>" + "<div>" * 20_000 + "<li></li>" * 20_000, '<div class="ad">' * 20_000 + "x", "<p class=ad>" * 40_000, "<a b='" + '<a c="' * 40_000, "<article>" + "<header><p>a b</p></header>" * 10_000, "word " * 100_000],
    ids=range(10),
)
def test_long_pages_take_linear_time(page):
    began = time.time()
    main_text(page)
    assert time.time() - began < 5


def test_query_reads_every_page(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in QUERIES["op10_main_text"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert set(got) == {r["page_id"] for r in pages}
    for r in pages:  # all pages of these tables have one article, closed, with unnested blocks
        body = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        blocks = [" ".join(html_text.html.unescape(html_text.re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in html_text.re.split("</?(?:p|h1)>", body)]
        assert got[r["page_id"]] == (t := "\n\n".join(b for b in blocks if b), len(t))


def test_repeated_pages_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>a b c."), (1, "u", "<p>a b c.")], "page_id long, url string, html string").selectExpr("*", "7 AS n_chars", "8 AS text", "9 AS lines")
    assert [tuple(r) for r in html_text.extract(df).collect()] == [(1, "u", "a b c.", 6)] * 2
