import re
import time
from html import unescape

from bracketry.llm import html

PROSE = "The boats, which were in the harbour for the winter, are to be painted by the men of the village &amp; its sons."
PLAIN = "The boats, which were in the harbour for the winter, are to be painted by the men of the village & its sons."
PAGE = f"""<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var t="</p><p>{PROSE}</p>";</script></head><body>
<header><h1>Site, of all things, named so</h1></header><nav><ul><li><a href="/a">Menu, one</a></li></ul></nav>
<div class="notice">{PROSE}</div><div id="main"><!-- <p>{PROSE}</p> --><h2>Title here</h2><p>{PROSE}<p>Second,  one&nbsp;with
<b>bold</b> and <a href="/x">link</a>.<br>More, of it.<ul><li>Item one, <i>plain</i><li>Item two</ul><div class="ad-box ad">{PROSE}</div>
<form><p>{PROSE}</p></form></div><aside><p>{PROSE}</p></aside><section class="comments"><p>{PROSE}</p><p>{PROSE}</p></section><footer><p>{PROSE}</p></footer></body></html>"""


def test_article_without_boilerplate():
    assert html.main_text(PAGE) == "\n".join(["Title here", PLAIN, "Second, one with bold and link. More, of it.", "Item one, plain", "Item two"])


def test_siblings_and_article():
    page = f"<body><article><section><p>{PROSE}</p><p>{PROSE}</p></section><section><p>Short end.</p></section></article><div><p>x</p></div></body>"
    assert html.main_text(page) == f"{PLAIN}\n{PLAIN}\nShort end."


def test_named_parts_and_lists_of_links_in_an_article_stay():
    links = "".join(f'<li><a href="/{x}">Name {x}</a></li>' for x in "abc")
    for box in ("article", "main"):
        page = f"""<body><{box}><p>{PROSE}</p><section id="discussion"><h2 id="related-work">Related work</h2><p class="alert">{PROSE}</p></section>
<h2 id="search-methods">Search</h2><p>{PROSE}</p><ol>{links}</ol><ul class="nav">{links}</ul><div class="share-buttons">{PROSE}</div><div class="ad">{PROSE}</div></{box}></body>"""
        assert html.main_text(page) == "\n".join([PLAIN, "Related work", PLAIN, "Search", PLAIN, "Name a", "Name b", "Name c"])


def test_odd_pages():
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x") == html.main_text("<p") == ""
    assert html.main_text("just text") == "just text"
    assert html.main_text("<div><p>cut &am") == "cut &am"
    assert html.main_text("<p>" * 3000 + PROSE) == PLAIN
    deep = "<div>" * 5000 + f"<p>{PROSE}</p>"
    assert html.main_text(deep) == PLAIN


def test_whole_table_against_the_articles(spark, sf):
    for r in html.op8_html(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        m = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)
        want = [" ".join(unescape(re.sub(r"<[^>]*(?:>|$)", " ", x)).split()) for x in re.split(r"</?(?:p|h1)(?:>|$)", m[1])] if m else []
        assert r.text == "\n".join(x for x in want if x), r.page_id
        assert r.n_chars == len(r.text)


def test_empty_table_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, None, "x"), (1, PAGE, "y")], "page_id long, html string, text string")
    assert [r.text[:5] for r in html.extract_pages(pages).orderBy("text").collect()] == ["", "Title"]
    assert html.extract_pages(pages.limit(0)).collect() == []


def test_time_is_in_proportion_to_depth():
    prose = "".join(f"<p>{PROSE}</p>" for _ in range(50))
    for page in ("<div>" * 100_000 + prose, "<div>" * 50_000 + prose + "</span></article>" * 50_000, "<i>" * 50_000 + "<div></div>" * 50_000 + prose, f"<div><p>{PROSE}</p>" * 30_000, "<b>" * 20_000 + "</i>" * 50_000 + prose, "<object>" * 50_000 + prose):
        began = time.process_time()
        assert PLAIN in html.main_text(page)
        assert time.process_time() - began < 8


def test_names_that_say_something_else_stay_and_scripts_go():
    page = f"""<article><p>{PROSE}</p><div class="share-price">Up, by two per cent, on the day.</div><div class="commentary">Words, of it.</div><div class="share-bar left">{PROSE}</div>
<ul class="related-work">{'<li><a href="/x">Title one</a></li>' * 2}</ul><script src='x'/>var a = "{PROSE}";</script><svg/><p>End, of it.</p></article>"""
    assert html.main_text(page) == "\n".join([PLAIN, "Up, by two per cent, on the day.", "Words, of it.", "Title one", "Title one", "End, of it."])
