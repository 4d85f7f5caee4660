import re
import time
from html import unescape

import pytest
from helpers import clashing

from tessella.llm import html


def page(body):
    return f"<html><head><title>no</title><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_every_page_of_a_table(spark):
    d = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    rows = html.query(spark, d).collect()
    assert len(rows) == len(pages)
    for r in rows:  # here the main text is what stands in <article>
        inside = re.sub(r"</?b>|<br>", "", re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1])
        blocks = (re.sub(r"\s+", " ", unescape(x)).strip() for x in re.split(r"</?p>|</?h1>", inside))
        assert r.text == "\n".join(x for x in blocks if x)
        assert r.n_chars == len(r.text)


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<header><h1>Site</h1></header><main><article><h1>T &amp; x</h1><p>Hello <b>wor</b>ld<br>x</p><aside>see also</aside><p>Short.</p></article></main><footer>c</footer>", "T & x\nHello world x\nShort."),
        ("<article><p>One.<p>Two.<ul><li>a<li>b</ul></article><section id='comments'><h3>Comments</h3><div class=comment><p>very nice</p></div></section>", "One.\nTwo.\na\nb"),
        ("<div id=wrap><div class='nav'><a href=x>a</a></div><div><p>Some words that make up a whole paragraph.</p><p>two</p></div><form>Sign up <input></form></div>", "Some words that make up a whole paragraph.\ntwo"),
        ("<article><div class='ad'>Buy</div><p>Text</p><div class='cookie-notice'>We use cookies</div></article>", "Text"),
        ("<article><p><a href='x'>All of it a link</a></p><p>Some long enough paragraph with many words.</p></article>", "All of it a link\nSome long enough paragraph with many words."),
        ("<div id='content'><h1>Title</h1><p>Some words that make up a whole paragraph.</p></div><div id='sidebar'><p>About me</p></div>", "Title\nSome words that make up a whole paragraph."),
        ("<div class='main'><div class='post'><h2>T</h2><p>Some words.</p><table><tr><td>1</td><td>2</td></tr></table></div><div class='comments'><p>I liked this a lot.</p></div></div>", "T\nSome words.\n1\n2"),
        ("<article><header><h1>Head</h1></header><p>Text of it.</p><div class='related'><a href=1>Other</a></div><footer>Filed</footer></article>", "Head\nText of it."),
        ("<script>x</script><style>y</style><!-- z -->", ""),
        ("<article><p>a&nbsp;&lt;b&gt;\n\t c</article>", "a <b> c"),
        ("<nav><ul><li><a href=/>x</a></li></ul></nav>", ""),
    ],
)
def test_pages(body, text):
    assert html.trained().extract(page(body)) == text


def test_edges(spark):
    m = html.trained()
    assert m.extract(None) == m.extract("") == m.extract("<") [:0] == ""
    for broken in ["<p", "<!-- x", "</p></div>", "<script>x", "<a href='", "<div " + "x" * 100000, "<div>" * 3000 + "deep", "\x00", "<p>" + "w " * 200000]:
        assert isinstance(m.extract(broken), str)
    pages = spark.createDataFrame([(None, None, None), (1, "u", "<article><p>x</p></article>")], "page_id long, url string, html string")
    pages = clashing(pages.unionByName(pages), "main_text", "page", "text")
    assert sorted((r.page.page_id or 0, r.main_text, r.page.main_text) for r in html.extract(pages).collect()) == [(0, "", "own")] * 2 + [(1, "x", "own")] * 2
    assert html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("junk", ["a <b ", "a <b \" ", "a <b ' ", "<div>", "<li>x", "<button>", "<head>", "<!", "<!-- ", "<script", "</p>", "<ul><li>", "<td><div>", "<a href='"])
def test_floods_take_linear_time(junk):
    m = html.trained()
    began = time.process_time()
    assert isinstance(m.extract("<article><p>x</p>" + junk * 20_000), str)
    assert time.process_time() - began < 8


def test_deep_trees_take_linear_time():
    began = time.process_time()
    html.parse("<div>" * 20_000 + "</li>" * 20_000 + "<li></li>" * 20_000)
    assert time.process_time() - began < 8


def test_letters_that_grow_when_lowered():
    body = "<p>\u0130</p><article><SCRIPT>var a = '<p>';</SCRIPT ><h1>T</h1><p>Text of it, all.</p><Style>x</STYLE></article>"
    assert html.trained().extract(page(body)) == html.trained().extract(page(body.replace("\u0130", "I"))).replace("I\n", "\u0130\n")
    assert html.trained().extract(page(body)).endswith("T\nText of it, all.")


def test_names_that_tell_nothing():
    """The look of the text decides where class names are unknown."""
    text = "<p>Some words that make up a whole paragraph, with a pause and an end.</p>" * 3
    got = html.trained().extract(page(f"<div class='gdprbar'>We use things to see you</div><article><h1>T</h1>{text}</article>"))
    assert got.startswith("T\n") and got.count("paragraph") == 3
    got = html.trained().extract(page(f"<div class='x1'><a href=a>Home</a> <a href=b>News</a></div><div class='x2'><h1>T</h1>{text}</div><div class='x3'>Copyright us</div>"))
    assert got.startswith("T\n") and got.endswith("end.")


def test_marginals_match_enumeration():
    from itertools import product
    from math import exp

    m = html.trained()
    nodes, _ = html.parse("<div><p>a</p><nav><a>b</a></nav></div>")
    local = []
    for f in html.evidence(nodes):
        own = m.table.get(f[0]) or m.table.get(f[1])
        local.append([exp(sum(x)) for x in zip(own, *(m.table[g] for g in f[2:] if g in m.table), strict=True)])
    total = [[0.0] * html.STATES for _ in nodes]
    for states in product(range(html.STATES), repeat=len(nodes)):
        if states[0] != html.FRAME:
            continue
        w = 1.0
        for k, s in enumerate(states):
            w *= local[k][s] * (m.edges[states[nodes[k].parent]][s] if k else 1)
        for k, s in enumerate(states):
            total[k][s] += w
    for got, want in zip(m.marginals(nodes), total, strict=True):
        assert got == pytest.approx([x / sum(want) for x in want], rel=1e-6)
