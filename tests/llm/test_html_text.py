import html
import re

import pytest

from cellfold.llm.html_text import Page, attributes, densities, extract_text, main_text, says_no_article
from cellfold.llm.queries import op12_html_extraction

from tests.conftest import SF

LONG = "A long paragraph of the article, with many words and few tags, that says what there is to say. "
ARTICLE = f"<h1>Head &amp; line</h1><p>{LONG}<b>bold</b>er<p>Short.</p><ul><li>one<li>two</ul>"
WANTED = f"Head & line {LONG.strip()} bolder Short. one two"
MENU = '<ul><li><a href="/a">Home</a><li><a href="/b">News</a><li><a href="/c">Contact us</a></ul>'

PAGES = {
    "article": (f"<html><head><title>T</title><style>p > a{{}}</style></head><body><nav>{MENU}</nav><article>{ARTICLE}</article><footer>&copy; me</footer></body></html>", WANTED),
    "names": (f'<body><div class="site-header">Site</div><div id="cookie-notice">We use cookies</div><main>{ARTICLE}</main><div class="sidebar">{LONG * 9}</div></body>', WANTED),
    "comments": (f'<article>{ARTICLE}<section class="comments"><article class="comment"><p>{LONG * 20}</p></article></section></article>', WANTED),
    "beside": (f'<article>{ARTICLE}</article><ol class="commentlist"><li>{LONG * 30}</li></ol>', WANTED),
    "plain": (f"<div><div>{MENU}</div><div>{ARTICLE}<p>{LONG}</p></div><div>{MENU}</div></div>", f"{WANTED} {LONG.strip()}"),
    "heading": (f"<div><h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p></div></div><div>{MENU}</div>", f"Title {LONG}{LONG}".strip()),
    "parts": (f"<main><div><p>{LONG}</p><p>x</p></div><div><p>last</p></div></main>", f"{LONG}x last"),
    "form": (f'<article>{ARTICLE}<form><label>Name</label><input></form><script>document.write("</p>")</script><aside>see also</aside></article>', WANTED),
    "hidden": (f'<article>{ARTICLE}<p hidden>no</p><p style="display: none">no</p><div role="navigation">no</div></article>', WANTED),
    "names of content": (f'<div class="no-sidebar"><div class="header-main"><article class="post has-comments">{ARTICLE}</article></div></div>', WANTED),
    "wrapped": (f'<div class="sidebar-box"><article>{ARTICLE}</article></div>', WANTED),
    "links": (f'<article>{ARTICLE}<p><a href="/x">{LONG}</a></p></article>', f"{WANTED} {LONG.strip()}"),
    "quotes": (f'<article title="a > b" data-x=\'<p>\'>{ARTICLE}</article>', WANTED),
    "comment markup": (f"<article><!-- <p>no</p> --><!--> {ARTICLE}<!-- a -- b --!></article>", WANTED),
    "capitals": (f"<ARTICLE>{ARTICLE}<SCRIPT>if (1 < 2) x()</SCRIPT ><STYLE></p></STYLE></ARTICLE>", WANTED),
    "broken end": (f"<article>{ARTICLE}</article><a href=\"never closed", WANTED),
    "misnested": (f"<article><p><b>{LONG}<br><p>two</b> three</p></i></article></div>", f"{LONG}two three"),
    "text only": ("just < some & text &amp; no&nbsp;tags", "just < some & text & no tags"),
    "references": ("<p>&lt;b&gt; &#65;&#x42; &eacute;&notin; &amp;amp; &unknown; &am</p>", "<b> AB é∉ &amp; &unknown; &am"),
    "white space": ("<article><p> a\n\t b<br>c </p>\r\n<p>d</p>e<i>f</i> g</article>", "a b c d ef g"),
    "table": ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a b c"),
    "empty": ("", ""),
    "nothing": ("<body><nav>menu</nav><div class='ad'>buy</div></body>", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, wanted = PAGES[name]
    assert main_text(page) == " ".join(wanted.split())


def test_density_decides_without_names():
    """Unnamed menus and a dense unnamed notice don't win over the element that holds the blocks."""
    page = Page(f"<div>{MENU * 3}</div><div>{'Buy now! ' * 12}</div><div>{f'<p>{LONG}</p>' * 4}</div>")
    density, total = densities(page)
    assert page.tags[max(range(len(total)), key=total.__getitem__)] == "div" and main_text(f"<div>{MENU * 3}</div><div>{'Buy now! ' * 12}</div><div>{f'<p>{LONG}</p>' * 4}</div>") == (LONG * 4).strip()
    assert density[page.tags.index("ul")] < density[page.tags.index("p")]


@pytest.mark.parametrize("name, dropped", [("ad", True), ("ad-slot-3", True), ("post-comments", True), ("CommentList", True), ("main-menu", True), ("shadow", False), ("header-image-text", False), ("reading", False), ("article-body", False), ("no-ads", False), ("load", False)])
def test_names(name, dropped):
    assert says_no_article("div", attributes(f' class="{name}"')) is dropped is says_no_article("div", attributes(f" id={name} "))


def test_hard_pages_take_linear_time():
    """Deep nesting, unclosed tags and quotes: a quadratic reader would never end."""
    n = 100_000
    assert main_text("<div>" * n + "x") == "x"
    assert main_text("<b><p>" * n + "x") == "x"
    assert main_text("x" + "<a " * n) == "x"
    assert main_text("x" + '<a b="' * n) == "x"
    assert main_text("x<!--" * n) == "x"
    assert main_text("<p>y</i></b></div>" * n) == " ".join(["y"] * n)
    assert main_text("<" * n) == "<" * n
    assert len(main_text(f"<article>{f'<p>{LONG}</p>' * 30_000}</article>")) == 30_000 * len(LONG) - 1


def test_odd_rows(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (2, None, None, None), (None, "", "", "y")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, __html string")
    found = extract_text(frame)
    assert found.columns == ["page_id", "url", "__html", "text", "n_chars"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(1, "u", "x", "a", 1), (1, "u", "x", "a", 1), (2, None, None, "", 0), (None, "", "y", "", 0)], key=repr)
    assert extract_text(frame.limit(0)).count() == 0
    with pytest.raises(ValueError, match="text"):
        extract_text(frame.withColumn("text", frame.url))


def test_query(spark):
    """On the table, an article is what stands between its tags."""
    found = {r.page_id: r for r in op12_html_extraction(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(found) == len(pages)
    for r in pages:
        inside = re.search("<article>(.*)</article>", r.html, re.S)[1]
        text = " ".join(html.unescape(re.sub("<[^>]*>", " ", inside)).split())
        assert (found[r.page_id].url, found[r.page_id].text, found[r.page_id].n_chars) == (r.url, text, len(text))
