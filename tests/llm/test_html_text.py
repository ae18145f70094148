import html
import re
import time

import pytest

from reviewmill.llm.html_text import extract_pages, main_text, op2_main_text
from tests.llm.conftest import EXTRA, SF
from pyspark.sql import functions as F

LONG = "A sentence of the article that is long enough to count. "


def test_whole_table(spark):
    """In these pages the article is what stands in the article element."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op2_main_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id].html, re.DOTALL)[1]
        body = re.sub(r"<[^>]*>?", "", re.sub(r"</?(p|br|h1)\b[^>]*>", " ", body))
        assert r.text == " ".join(html.unescape(body).split())
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain text", "plain text"), ("<p>one<p>two", "one two"), ("<p>a &lt; b &amp; c&eacute;&#33;</p>", "a < b & cé!"),
        ("<p>x</p><script>var a = '<p>no</p>';</script><style>p{}</style><!-- no -->", "x"), ("<main><p>cut &am", "cut &am"), ("<p>a<b>b</b>c<br>d\n\t e</p>", "abc d e"),
        ("<nav>menu</nav><header>top</header><p>text</p><footer>end</footer><aside>side</aside><form>form</form>", "text"),
        ("<div class='cookie-notice'>We use</div><div id=sidebar>side</div><div class='main has-sidebar'><p>text</p></div><div class=adBox>ad</div>", "text"),
        ("<article><p>Article.</p><section class='comments'><p>I say</p></section></article><div>" + LONG * 9 + "</div>", "Article."),
        ("<table><tr><td>cell one<td>cell two</table>", "cell one cell two"), ("<article></article>", ""), ("<p hidden>no</p><p style='display: none'>no</p><p>yes", "yes"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_page_without_semantic_elements():
    links = "".join(f"<div><a href='/{i}'>Section {i}</a></div>" for i in range(12))
    page = f"<html><body><div>{links}</div><div><h2>Heading</h2><div>{LONG * 4}</div><div>Short.</div><div>{LONG * 3}</div></div><div>{links}</div></body></html>"
    assert main_text(page) == f"Heading {LONG * 4}Short. {LONG * 3}".strip()


def test_names_of_layout_wrappers():
    """A wrapper with a listed name is kept if it holds the page's text; real sidebars and comments still go."""
    paragraphs = [f"Paragraph {i}. {LONG}".strip() for i in range(6)]
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    side, said = "<div class='sidebar'><p>Short side.</p></div>", f"<div class='comments'><p>{LONG * 6}</p></div>"
    want = " ".join(paragraphs)
    assert main_text("".join(f"<div class='elementor-widget'><p>{p}</p></div>" for p in paragraphs) + side + said) == want
    assert main_text(f"<div id=page class='right-sidebar'><div>{body}</div>{side}</div>{said}") == want
    assert main_text(f"<div class='header-wrap search-form'><article>{body}</article></div>{side}") == want
    assert main_text("<span class='widget-text'>" + LONG * 3 + "</span><span class='ad'>buy</span>") == (LONG * 3).strip()


def test_split_articles():
    parts = [f"<article><h2>Part {i}</h2><p>{LONG * n}</p></article>" for i, n in enumerate((8, 3, 2))]
    links = "<ul>" + "".join(f"<li><a href='/{i}'>More {i}</a></li>" for i in range(20)) + "</ul>"
    want = " ".join(f"Part {i} {LONG * n}".strip() for i, n in enumerate((8, 3, 2)))
    assert main_text(f"<main>{''.join(parts)}{links}</main>") == want
    assert main_text(f"<main><article><p>{LONG * 6}</p></article><p>{LONG * 4}</p></main>") == f"{LONG * 10}".strip()


def test_a_form_around_the_page():
    body = "".join(f"<p>Paragraph {i}. {LONG}</p>" for i in range(4))
    want = " ".join(f"Paragraph {i}. {LONG}".strip() for i in range(4))
    contact = "<form><label>Your name</label><input><label>" + LONG * 20 + "</label></form>"
    assert main_text(f"<body><form action='/'><nav>menu</nav><div>{body}</div></form></body>") == want
    assert main_text(f"<div>{body}</div>{contact}") == want
    assert main_text(f"<div>{body}</div><form><p>Subscribe to our letter</p></form>") == want


def test_deep_pages():
    for tag in ("<div>", "<div class='widget'>", "<form><p>"):
        start = time.perf_counter()
        assert main_text(f"{tag}a " * 100_000).count("a") > 40_000  # of nested elements with one name the inner half goes
        assert time.perf_counter() - start < 10
    for n in range(3):
        assert main_text("<div class='sidebar'>" * n + f"<p>{LONG}</p>" + "</div>" * n) == LONG.strip()


def test_odd_rows(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, None), (2, None, ""), (3, "v", "<p>" + "w " * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("x").alias(c) for c in [*EXTRA, "text"]])
    got = extract_pages(pages).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 1, 1, 599_999]
    assert extract_pages(pages.limit(0)).count() == 0
