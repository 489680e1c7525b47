import html
import re

from quillon.llm import htmltext as H

LONG = "This is a sentence of some length, with commas, that reads as prose. " * 4


def page(main, extra=""):
    return f"""<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{{}}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies, yes.</div><div id="sidebar"><p>{LONG}</p></div>{main}
<div class="ad">Buy, buy, buy {LONG}</div><form><p>Name <input></p></form><section id="comments"><p>{LONG}</p></section>{extra}<footer>&copy; me</footer></body></html>"""


def clean(s):
    return re.sub(r"\s+", " ", html.unescape(s)).strip()


def test_layouts():
    a, b = LONG + "One &amp; two&nbsp;&#8212; é.", "Second\n  <b>bold</b> <a href='x'>link</a>, " + LONG
    want = [clean(a), clean(re.sub("<[^>]+>", "", b))]
    for main in (
        f"<article><h1>Head</h1><p>{a}<p>{b}</article>",
        f"<main><h1>Head</h1><div><p>{a}</p><p>{b}</p></div></main>",
        f"<div class='post-content'><h1>Head</h1><p>{a}</p><div><p>{b}</p></div></div>",
        f"<ARTICLE><H1>Head</H1><P>{a}<p>{b}<aside>x</aside><div class=share>Share</div><div class='comments'><p>{LONG}</p></div></ARTICLE>",
        f"<div id=content><h1>Head</h1>{a}<br><br><p>{b}</div>",
    ):
        assert H.main_text(page(main)).split("\n") == ["Head", *want], main


def test_short_items_and_entities_are_kept():
    got = H.main_text(page(f"<article><h1>&lt;b&gt; &quot;x&quot; &amp;lt;</h1><p>Yes.</p><ul><li>one<li>two <i>2</i></ul><pre>a\n b</pre><table><tr><td>c<td>d</table><p>{LONG}</p><p></p></article>"))
    assert got == '<b> "x" &lt;\nYes.\none\ntwo 2\na b\nc\nd\n' + clean(LONG)


def test_repository_pages(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        art = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [clean(re.sub(r"<[^>]+>", " ", x)) for x in re.split(r"</?(?:p|h1)>", art)]
        assert H.main_text(r.html) == "\n".join(x for x in parts if x)


def test_edges(spark):
    deep = "<div>" * 3000 + f"<p>{LONG}</p>" + "</div>" * 3000
    pages = [(1, "u", None), (2, None, ""), (3, "u", " \n"), (4, "u", "plain"), (5, "u", "<p"), (6, "u", "<<<>>>&&&;<!--"), (7, "u", deep), (7, "u", deep), (8, "u", "<script>" + "x" * 200_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = sorted(H.extract(df).collect(), key=lambda r: r.page_id)
    assert [r.page_id for r in got] == [1, 2, 3, 4, 5, 6, 7, 7, 8]
    assert got[0].text == got[1].text == got[2].text == "" and got[3].text == "plain" and got[6].text == clean(LONG)
    assert all(r.n_chars == len(r.text) for r in got)
    assert H.extract(df.where("page_id < 0")).count() == 0


def test_quotes_in_tags():
    assert H.main_text('<p class="x>Hello there</p>') == "Hello there"
    assert H.main_text('<p class="x>Hello</p><p class="y">there</p>') == "there"  # a value runs on to the next quote
    assert H.main_text("<p title=don't>one</p><p title='a > b'>two</p>") == "one\ntwo"
    assert H.main_text("<p " + '=" ' * 50_001) is not None


def test_names_weigh_and_do_not_delete():
    refs = "<ul><li><a href=1>First reference, with its title</a><li><a href=2>Second one</a><li><a href=3>Third</a></ul>"
    body = f"<h1>Head</h1><p>{LONG}</p><p class='notice'>Important finding, kept.</p>{refs}<div class='notice'>We use cookies.</div><ul class='share'><li>Send</ul><div class='comments'><p>Me too</p></div><p>{LONG}</p>"
    want = ["Head", clean(LONG), "Important finding, kept.", "First reference, with its title", "Second one", "Third", clean(LONG)]
    assert H.main_text(page(f"<article>{body}</article>")).split("\n") == want
    assert H.main_text(page(f"<div class='legal'><article>{body}</article></div>", "<div><p>tiny text here</p></div>")).split("\n") == want
    alone = f"<div class='legal'><h2>Terms</h2><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div>tiny text here</div>"
    assert H.main_text(alone).split("\n") == ["Terms", *[clean(LONG)] * 3]


def test_layouts_without_article():
    long, short = "word, " * 15 + "text " * 280, "word, " * 2 + "text " * 55
    for wrap in ("<div>{}</div>", "<section class='content'>{}</section>", "<table><tr><td>{}</table>"):
        got = H.main_text("<body><nav><a href=/>Home</a></nav>" + wrap.format(f"<div><p>{long}</div><div><p>{short}</div><h3>Sub</h3><p>Short.</p><math><mi>x</mi></math>") + "<footer>me</footer>")
        assert [x[:5] for x in got.split("\n")] == ["word,", "word,", "Sub", "Short", "x"], wrap
    menu = "<ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>More</a></ul>"
    assert H.main_text(f"<body>{menu}<div><p>{LONG}</p><p>{LONG}</p></div>{menu}").split("\n") == [clean(LONG)] * 2


def test_time_grows_with_length():
    import time

    for deep in ("<div>some words, of text" * 100_000, "<i><div>" + "<b>x" * 50_000 + "</i>" * 50_000, "<ul>" + "<li>x" * 50_000, "<p>" + "<section>some words, of text" * 50_000):
        began = time.perf_counter()
        assert H.main_text(deep)
        assert time.perf_counter() - began < 5
