"""Extraction of planted pages, host consensus, broken markup."""

import pytest
from pyspark.sql import functions as F

from resonant.llm import html_extract as H
from tests.conftest import DATA

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><header><h2>Site</h2></header>
<div class="content post-{n}"><h1>Title {n}</h1><p>First &amp; foremost&nbsp;paragraph   {n}.<br>Second<b>bold</b> line.<p>Unclosed {text}
<form><input name=q><label>Search</label></form><div class="ad">Buy now</div><!-- c --></div>
<section class="comments"><p>Reader says hi, at great length and with many words so that it seems to be the text</p></section>
<aside>Side</aside><footer>&copy; site</footer></body></html>"""


def page(n, text="x"):
    return PAGE.format(n=n, text=text)


def test_main_text_of_a_page():
    want = "Title 3 First & foremost paragraph 3. Second" + "bold line. Unclosed body text"
    assert H.extract(page(3, "body text"), [">html>body>div.content.post-#"]) == want
    assert H.extract(page(3, "body text " * 10), None).startswith("Title 3 First & foremost")


def test_host_votes_decide_for_pages_of_little_text(spark):
    rows = [(i, f"http://one.example/{i}", page(i, "many words of the article itself " * 5)) for i in range(6)]
    rows.append((6, "http://ONE.example:80/x", "<html><body><div class='content post-77'><p>Ti.</p></div><div class='teaser2'><p>A long text that isn't the article, though it has more words</p></div></body></html>"))
    rows.append((7, "http://two.example/x", "<html><body><div class='teaser2'><p>Here it is the only text</p></div></body></html>"))
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[6] == "Ti." and got[7] == "Here it is the only text" and len(got) == 8


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a b"), ("<div><p>cut off <b>here</div><p>after", "cut off here after"), ("<p>a &lt; b &#233; &copy x &unknown; &am", "a < b é © x &unknown; &am"),
        ("<p>x</p></div></b>", "x"), ("<p>x <a", "x"), ("<p>x<!-- never closed <p>y", "x"), ("<p>x<script>if (a</b) {", "x"), ("<p>1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("<p title='a > b'>ok</p>", "ok"), ("<ul><li>a<li>b</ul>", "a b"),
        ("<p>in<span>li</span>ne\n\t x</p>", "inline x"), ("<div hidden><p>no</p></div><p>yes", "yes"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    ],
)
def test_odd_markup(html, want):
    parsed = H.parse(html)
    assert parsed.text([parsed.containers[0]]) == want


def test_nulls_repeats_clashes_and_empty(spark):
    rows = [(1, None, None), (1, None, "<p>abc</p>"), (None, "no url", "<p>def ghi</p>"), (2, "http://h/", "<p>" + "long " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("paths", F.lit(2)).withColumn("host", F.lit(3))
    got = sorted(((r.page_id or 0, r.text[:10], r.n_chars) for r in H.main_text(df).collect()))
    assert got == [(0, "def ghi", 7), (1, "", 0), (1, "abc", 3), (2, "long long ", 499_999)]
    assert H.main_text(df.limit(0)).count() == 0


def test_testdata_articles(spark):
    import html as lib
    import re

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r.text for r in H.main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        inner = re.sub(r"</?b>", "", article)
        want = " ".join(lib.unescape(re.sub(r"<[a-zA-Z/!][^>]*(>|\Z)", " ", inner)).split())
        assert got[r.page_id] == want


def nested(n):
    return f"<html><body><nav><a href='/'>Home</a></nav><article><h1>Title {n}</h1><p>{'lead ' * 20}</p><div class='body'><p>{'word ' * 200}</p></div></article><div class='teaser'><p>Other text</p></div></body></html>"


def test_article_around_the_winning_block_is_whole(spark):
    rows = [(i, f"http://nested.example/{i}", nested(i)) for i in range(4)]
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join([f"Title {i}", *["lead"] * 20, *["word"] * 200]) for i in range(4)}


LONG = "word " * 100
WORDS = LONG.strip()


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<main><h1>T</h1><article><section class='a'><p>{LONG}</section><section class='b'><p>rest</section></article></main>", f"T {WORDS} rest"),
        (f"<body><div class='post'><div class='t'><h1>T</h1></div><div class='in'><div class='text'><p>{LONG}</div></div></div><div class='teaser'><p>no</div></body>", f"T {WORDS}"),
        (f"<body><h1>T</h1><div class='w'><div class='text'><p>{LONG}</div><div class='more'><a href=x>a link</a></div></div><div class='teaser'><p>no</div></body>", f"T {WORDS}"),
        (f"<body><p><a href=x>only links</a></p><div class='text'><p>{LONG}</div></body>", WORDS),
        (f"<article><p>{LONG}<figure><img src=x><figcaption>A caption</figcaption></figure></article>", f"{WORDS} A caption"),
        (f"<article><p>{LONG}<math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></mrow><annotation>E=mc^2</annotation></semantics></math> holds</article>", f"{WORDS} E=mc2 holds"),
        (f"<article><p>{LONG}<svg><title/><defs/><path d='M0 0'/><text>axis</text></svg><object data=x><p>instead</p></object>end</article>", f"{WORDS} axis instead end"),
    ],
)
def test_nothing_of_an_article_is_left_out(html, want):
    assert H.extract(html, None) == want


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<div class='layout has-sidebar'><article><p>{LONG}</article></div>", WORDS),
        (f"<div class='post no-comments'><p>{LONG}</div>", WORDS),
        (f"<div class='post'><p>{LONG}<p class='notice-board-history'>More.</div>", f"{WORDS} More."),
        (f"<div class='page-header-fixed'><div id=header><p>Site</div><article><p>{LONG}</article></div>", WORDS),
        (f"<div class='navigation-on sidebar'><main><p>{LONG}</main><div class='widget'><p>w</div></div>", WORDS),
        (f"<div class='widget-area'><article><h1>T</h1><p>{LONG}</article></div><p>x</p>", f"T {WORDS}"),
        (f"<form id=aspnetForm><div><p>{LONG}<p>b<p>c</div><div class='search-form'><p>go</div></form>", f"{WORDS} b c"),
        (f"<article><p>{LONG}</article><section class='comments'><article><p>{LONG}<p>{LONG}<p>{LONG}</article></section>", WORDS),
        (f"<article><p>{LONG}</article><div class='cookie-notice'><p>{LONG}<p>{LONG}<p>{LONG}</div>", WORDS),
        (f"<article><p>{LONG}<div class='post-ad'><p>buy</div><div class='ad-slot-2'>buy</div><div id='sideBar'>s</div><div class='relatedPosts related'>r</div></article>", WORDS),
        (f"<article><p>{LONG}</article><form><label>Name</label><p>Write to us, we are glad.</form>", WORDS),
        (f"<article><header><p>by A</header><p>{LONG}</article><div class='share-buttons'>s</div><ul class='menu-items'><li>m</ul>", WORDS),
        ("<div class='cookie-notice'><p>We use cookies</div>", ""),
    ],
)
def test_words_of_a_wrapper_leave_nothing_out(html, want):
    assert H.extract(html, None) == want


def test_host_of_unique_paths_and_ties(spark):
    rows = [(i, "http://unique.example/", f"<div class='{chr(97 + i // 26)}x{chr(97 + i % 26)}y'><p>{LONG} {i}</div><div class=teaser><p>no</div>") for i in range(400)]
    rows += [(1000 + i, "http://tie.example/", f"<div class='{'ab'[i % 2]}'><p>{LONG}{i}</div>") for i in range(4)]
    rows.append((2000, "http://tie.example/", f"<div class='b'><p>Of b</div><div class='a'><p>Of a</div><div class=c><p>{LONG}</div>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    paths = {r.host: r.paths for r in H.host_paths(pages).collect()}
    assert paths == {"tie.example": [">div.a", ">div.b"]}
    got = {r.page_id: r.text for r in H.main_text(pages).collect()}
    assert all(got[i] == f"{WORDS} {i}" for i in range(400)) and got[2000] == "Of a"
    many = [(i, f"http://h{i % 40}.example/", f"<div class='c{'x' * (i % 80)}'><p>{LONG}{i}</div>") for i in range(400)] + [(i, None, None) for i in (5000, 5001)]
    pages = spark.createDataFrame(many, "page_id long, url string, html string").withColumn("lookup_key", F.lit(1))
    assert sorted(H.main_text(pages).collect()) == sorted(H.main_text(pages, broadcast_bytes=0).collect())
    assert max(len(r.paths) for r in H.host_paths(pages).collect()) <= H.MAX_PATHS


def test_deep_pages_take_time_in_proportion():
    deep = "<div class='some long name'>" * 60_000 + "<p>text " + "</i></b>" * 60_000 + "<b>" * 60_000 + "<p>end"
    assert H.extract(deep, [">div"]) == "text end"
