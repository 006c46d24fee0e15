import html
import re
import time

import numpy as np
import pytest

from thermalframe.llm import main_text as M
from thermalframe.llm.queries import QUERIES

PARTS = ["The harbour opens at dawn", "Ships from the north, laden with timber, arrive first; the pilots wait for them at the mole.",
         "A short line", "When the tide turns, nobody moves: the cranes stand still, and the crews eat. It takes an hour, sometimes two.",
         "Prices rose again in spring. Merchants blame the weather, the weather blames nobody."]
ARTICLE = "<h1>{}</h1><p>{}</p><h2>{}</h2><p>{}</p><blockquote>{}</blockquote>".format(*PARTS)
WANT = " ".join(PARTS)
LINKS = "<ul>" + "".join(f'<li><a href="/{x}">{x.title()}</a></li>' for x in "home news sport weather culture travel".split()) + "</ul>"
NOISE = "We use cookies to improve this site, and to show you offers. Read on, or accept."
FORM = '<form action="/s"><label>Your name, please.</label><input name="q"><textarea>Say it.</textarea><button>Send</button></form>'
TALK = "".join(f'<article class="comment"><p>Reader {i}: I think, as always, that this is wrong. Very wrong, indeed!</p></article>' for i in range(12))

PAGES = {
    "semantic": f"<nav>{LINKS}</nav><header><h2>The Daily, since 1880.</h2></header><main><article>{ARTICLE}</article></main><aside><p>{NOISE}</p></aside>"
                f"<footer><p>&copy; The Daily. All rights reserved.</p></footer>",
    "classes": f'<div class="site-header"><a href="/">The Daily</a></div><div id="main-menu">{LINKS}</div><div class="post-content">{ARTICLE}</div>'
               f'<div class="sidebar"><p>{NOISE}</p></div><div id="comments">{TALK}</div><div class="cookieNotice"><p>{NOISE}</p></div>',
    "plain": f"<div>{LINKS}</div><div>{ARTICLE}</div><div>Printed in town.</div>",
    "wrapper": f'<body class="has-sidebar"><div class="page with-comments"><form id="aspnet"><header>{LINKS}</header><article>{ARTICLE}</article>{FORM}</form></div>',
    "inside": f'<article><header><h1>{PARTS[0]}</h1></header><p>{PARTS[1]}</p><div class="ad"><p>{NOISE}</p></div><h2>{PARTS[2]}</h2><script>var a="<p>no</p>";'
              f'</script><p>{PARTS[3]}</p>{FORM}<blockquote>{PARTS[4]}</blockquote><div class="share-buttons">{LINKS}</div><footer>By A. Writer, staff.</footer>'
              f'<section id="comments">{TALK}</section></article>',
    "teasers": f'<article>{ARTICLE}</article><div class="related"><article><p>Another story, told.</p></article></div><aside><article><p>{NOISE}</p></article></aside>',
    "long talk": f'<div class="content">{ARTICLE}</div><ol class="commentlist">' + "<li><p>No, no, and no. I was there, and it was not so.</p></li>" * 60 + "</ol>",
    "hidden": f'<article>{ARTICLE}<p hidden>Not seen.</p><div style="display: none">Nor this, ever.</div></article><noscript>Turn it on, please.</noscript>',
    "unclosed": f"<nav>{LINKS}</nav><article><h1>{PARTS[0]}</h1><p><b>{PARTS[1]}<p>{PARTS[2]}<p><i>{PARTS[3]}</b></i><p>{PARTS[4]}</article><footer>Fin, at last.",
    "table": f"<table><tr><td>{LINKS}<td>{ARTICLE}</table>",
    "role": f'<div role="navigation">{LINKS}</div><div role="main">{ARTICLE}</div><div role="contentinfo"><p>{NOISE}</p></div>',
}


@pytest.mark.parametrize("name", PAGES)
def test_templates(name):
    head = "<!DOCTYPE html><html><head><title>The harbour</title><style>p{color:red}</style><meta name=x content='a > b'></head>"
    assert M.main_text(head + PAGES[name]) == WANT


@pytest.mark.parametrize("page, text", [
    ("", ""), ("<html></html>", ""), ("just words", "just words"), ("<p>a<b>b</b> c<br>d</p>", "ab c d"), ("<p>x &amp; y&nbsp;&lt;z&gt; &#233;&#x41; &amp", "x & y <z> éA &"),
    ("<p>a < b and c</p>", "a < b and c"), ("<!-- <p>no</p> --><p>yes, it is.</p><!-- open", "yes, it is."), ("<p title=\"a > b\">kept</p>", "kept"),
    ("<article><p>one\n\t two\x0b three</p></article>", "one two three"), ("<article>\x00</article>", "\x00"), ("<script>only</script>", ""),
    ("<p onclick=\"if (a < b) go('x>y')\">shown</p>", "shown"), ("</p></div>text, alone", "text, alone"), ("<article><ul><li>one<li>two</ul></article>", "one two")])
def test_small_pages(page, text):
    assert M.main_text(page) == text


@pytest.mark.parametrize("piece", ['<a "', "<div>", "<!--", "<p title='", "<", "<li><div>", "&amp;", "<script>", "</div>", "<p>a", "<table><tr><td>",
                                   '<a href="x>', "<b '\"", "<h1>x", "<ul><li>", "<div class='a"])
def test_time_grows_with_length(piece):
    M.main_text(piece * 1000)
    start = time.perf_counter()
    M.main_text(piece * 60_000)
    assert time.perf_counter() - start < 10


def test_smooth():
    x = np.random.default_rng(1).random(9)
    for n in range(1, 10):
        weights = [[np.exp(-0.5 * (i - j) ** 2) if abs(i - j) <= 2 or n <= 4 else 0 for j in range(n)] for i in range(n)]
        assert np.allclose(M.smooth(x[:n]), [np.average(x[:n], weights=w) for w in weights])


def test_paths_are_thresholded():
    paths = np.array([1, 1, 2, 2, 2, 1, 1, 1, 3])
    got = M.content_nodes(paths, np.array([12., 9, 300, 20, 250, 14, 11, 8, 30]), np.array([0., 0, 9, 0, 7, 0, 0, 0, 1]),
                          np.array([12., 9, 0, 0, 0, 14, 11, 8, 0]))
    assert got.tolist() == [False, False, True, True, True, False, False, False, False]


def plain(page):
    inner = re.search(r"<article>(.*?)</article>", page or "", re.S)
    if not inner:
        return ""
    inner = re.sub(r"<(?:/?(?:p|h1)|br)>", " \n", inner[1])
    return " ".join(html.unescape(re.sub(r"</?b>", "", inner)).split())


def test_query_equals_plain_version(spark):
    got = {r.page_id: r for r in QUERIES["op11_html_main_text"](spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(got) == len(rows) > 200
    for r in rows:
        assert (got[r.page_id].text, got[r.page_id].url, got[r.page_id].n_chars) == (plain(r.html), r.url, len(plain(r.html)))


def test_rows(spark):
    rows = [(1, "u", "<article>a, b.</article>", "x", 5), (1, "u", "<article>a, b.</article>", "y", 6), (None, None, None, None, None),
            (2, None, "", "z", 7), (3, "w", "<div>" * 5000 + "deep, very.", "z", 7), (4, "v", "<p>" + "long text. " * 200_000, "z", 8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = sorted((str(r.page_id), str(r.url), r.text[:20], len(r.text)) for r in M.extract_text(df).collect())
    assert got == sorted([("1", "u", "a, b.", 5), ("1", "u", "a, b.", 5), ("None", "None", "", 0), ("2", "None", "", 0),
                          ("3", "w", "deep, very.", 11), ("4", "v", "long text. long text", 2_199_999)])
    assert M.extract_text(df.where("false")).collect() == []
