"""Main text of web pages by a tree-structured graphical model.

A page's block elements form a tree. Every node is a frame (holds both kinds), content or boilerplate, the latter two
split into the top block of such a part and those inside it. A node's evidence is the naive Bayes product of its tag
with the words of its class, id and role, of its link density, and of its text: how long it is, how often a sentence ends
or pauses in it, and its share of the page's longest block; parent-child potentials connect the nodes.
Sum-product messages go up and down the tree once, which gives the exact marginals; the text of a block is kept where
content is likelier than boilerplate. The potentials are smoothed counts over labelled pages: ``labelled_pages`` writes
them from templates, with the state of each block in ``data-y``.

Scripts, styles, comments, heads and form controls never are text. Inline markup joins its block, ``br`` is white
space. Unclosed and stray tags are read as browsers do: a block start ends an open paragraph, an end tag closes what
is open inside it, a stray one is ignored, and the end of the page closes everything. A ``<`` that begins no tag, or a tag
without end, is text. Every page is read in one pass forward, whatever it holds.

Nulls: a null page gives empty text; null ids and urls are kept. Repeated rows give equal results. Empty in, empty out.
Columns of any other name are carried inside one struct, so none can clash.
"""

from __future__ import annotations

import random
import re
from functools import cache
from html import unescape
from math import exp, log
from operator import mul

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States: frame, the top and the inside of content, the top and the inside of boilerplate; KIND: 0 frame, 1 content, 2 boiler.
FRAME, STATES, KIND = 0, 5, (0, 1, 1, 2, 2)
SKIP = {"script", "style", "head", "noscript", "template", "iframe", "svg", "textarea", "select", "button", "object", "title", "math", "canvas", "audio", "video"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img input".split())
SELF_CLOSING = {"li": {"ul", "ol", "menu"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
# Words that pages put into class, id and role attributes.
GOOD_WORDS = set("article content entry post story body main text prose page paragraph blog news".split())
BAD_WORDS = set(
    """nav navigation navbar menu header masthead topbar footer foot bottom sidebar side aside rail ad ads advert adverts advertisement banner
    promo sponsor sponsored cookie cookies consent gdpr notice notices alert warning popup modal overlay newsletter subscribe subscription signup
    form login search comment comments discussion disqus reply replies respond reader feedback review reviews related recommended more share sharing
    social follow breadcrumb breadcrumbs pagination pager copyright legal widget widgets tags meta toolbar tool tools skip contentinfo complementary
    credits disclaimer print hidden""".split()
)
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^'\">]|\"[^\"]*\"|'[^']*')*+>")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_STATE = re.compile(r"data-y=(\d)")
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "names", "parent", "chars", "linked", "marks", "state")

    def __init__(self, tag, names, parent, state=None):
        self.tag, self.names, self.parent, self.state = tag, names, parent, state
        self.chars = self.linked = self.marks = 0  # of the text right inside: characters, those in links, punctuation marks


class _Tags:
    """The tags of a page from front to back: (begin, end, name or None, whether it ends, attributes).

    What has been searched for in vain up to the page's end is not searched for again.
    """

    def __init__(self, html: str):
        self.html, self.vain, self.quoted = html, set(), True

    def find(self, what: str, at: int) -> int:
        if what in self.vain:
            return -1
        if (found := self.html.find(what, at)) < 0:
            self.vain.add(what)
        return found

    def search(self, pattern: str, at: int) -> re.Match | None:
        if pattern in self.vain:
            return None
        if (found := re.compile(pattern, re.I | re.A).search(self.html, at)) is None:
            self.vain.add(pattern)
        return found

    def next(self, at: int) -> tuple | None:
        html = self.html
        while (begin := self.find("<", at)) >= 0:
            at = begin + 1
            if html.startswith("!--", at):
                end = self.find("-->", begin + 4)
                return begin, len(html) if end < 0 else end + 3, None, False, ""
            if (end := self.find(">", at)) < 0:  # no tag ends any more
                continue
            m = _NAME.match(html, at)
            if not m and not html.startswith(("!", "?"), at):
                continue
            if not m:
                return begin, end + 1, None, False, ""
            if self.quoted and ('"' in html[m.end() : end] or "'" in html[m.end() : end]):
                whole = _REST.match(html, m.end())
                self.quoted = whole is not None  # a quotation that never ends: from here on, a tag ends at the first >
                end = whole.end() - 1 if whole else end
            return begin, end + 1, m[2].lower(), m[1] == "/", html[m.end() : end]
        return None


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes in page order (parents first) and the page's runs of block text as (node, text)."""
    nodes = [Node("#page", "", -1)]
    open_, runs, run = [0], [], []  # open_: indexes of open blocks
    places: dict[str, list[int]] = {}  # of each tag, where in open_ it stands
    tags, links, at, size = _Tags(html), 0, 0, len(html)

    def flush():
        if run:
            text = _SPACE.sub(" ", unescape("".join(run))).strip()
            if text:
                runs.append((open_[-1], text))
                nodes[open_[-1]].marks += sum(map(text.count, ".!?,;:"))
            run.clear()

    def close_to(k):
        flush()
        for i in open_[k:]:
            places[nodes[i].tag].pop()
        del open_[k:]

    def last(tag):
        return places[tag][-1] if places.get(tag) else 0

    while at < size:
        found = tags.next(at)
        end = found[0] if found else size
        if end > at:
            piece = html[at:end]
            run.append(piece)
            n = nodes[open_[-1]]
            n.chars += len(piece)
            n.linked += len(piece) if links else 0
        if not found:
            break
        _, at, tag, ends, attributes = found
        if tag is None:
            continue
        if ends:
            if tag == "a":
                links = max(0, links - 1)
            if tag == "br":
                run.append(" ")
            if tag not in INLINE and last(tag):
                close_to(last(tag))
                links = 0
            continue
        if tag in RAW or tag in SKIP:
            if attributes.endswith("/") and tag not in RAW:
                continue
            if tag == "head":  # its text is never shown; it ends at its end tag or at the body
                stop = tags.search(r"</head\s*>|<body\b", at)
                at = (stop.end() if stop[0][1] == "/" else stop.start()) if stop else at
                continue
            stop = tags.search(rf"</{tag}(?=[\s/>]|\Z)", at) if tag.isalnum() else None
            if stop is None:
                at = size if tag in RAW else at
                continue
            stop = tags.find(">", stop.end())
            at = size if stop < 0 else stop + 1
            continue
        if tag in INLINE:
            if tag == "a":
                links += 1
            elif tag == "br":
                run.append(" ")
            continue
        flush()
        links = 0
        top = nodes[open_[-1]].tag
        if top == "p" or tag in SELF_CLOSING and top == tag:
            close_to(len(open_) - 1)
        elif tag in SELF_CLOSING and last(tag) > max(map(last, SELF_CLOSING[tag])):
            close_to(last(tag))
        if tag in VOID:
            continue
        names = " ".join(_NAMES.findall(attributes)).lower() if attributes else ""
        state = _STATE.search(attributes) if attributes else None
        nodes.append(Node(tag, names, open_[-1], int(state[1]) if state else None))
        places.setdefault(tag, []).append(len(open_))
        open_.append(len(nodes) - 1)
    flush()
    return nodes, runs


def evidence(nodes: list[Node]) -> list[tuple]:
    """The features of each node, over its whole subtree."""
    chars, linked, marks = ([getattr(n, x) for n in nodes] for x in ("chars", "linked", "marks"))
    for k in range(len(nodes) - 1, 0, -1):
        parent = nodes[k].parent
        chars[parent] += chars[k]
        linked[parent] += linked[k]
        marks[parent] += marks[k]
    longest = max(n.chars for n in nodes) or 1
    out = []
    for n, c, l, m in zip(nodes, chars, linked, marks, strict=True):
        words = _WORDS.findall(n.names)
        named = 2 if any(w in BAD_WORDS for w in words) else 1 if any(w in GOOD_WORDS for w in words) else 0
        share = l / c if c else 0
        length = 0 if c < 40 else 1 if c < 160 else 2 if c < 640 else 3
        pause = 0 if not m else 1 if 80 * m < c else 2
        part = 0 if 8 * c < longest else 1 if 2 * c < longest else 2
        out.append((("own", (n.tag, named)), ("named", named), ("links", 0 if share < 0.2 else 1 if share < 0.6 else 2), ("text", (length, pause, part))))
    return out


class Model:
    """Potentials: log p(feature | state) and p(child state | parent state)."""

    def __init__(self, pages: list[str]):
        seen, totals, kinds = {}, {}, {}
        edges = [[0.5] * STATES for _ in range(STATES)]
        for html in pages:
            nodes, _ = parse(html)
            for n, features in zip(nodes, evidence(nodes), strict=True):
                above = nodes[n.parent].state if n.parent >= 0 else FRAME
                kind = KIND[above] if n.state is None else n.state  # a block that has no label is as its parent
                y = n.state = FRAME if kind == 0 else 2 * kind - (kind != KIND[above])
                if n.parent >= 0:
                    edges[above][y] += 1
                for name, value in features:
                    kinds.setdefault(name, set()).add(value)
                    for x in (0, 1, 2, 4) if name == "text" and y != 3 else (y,):  # the text's look tells the top of boilerplate from all else
                        seen[name, value, x] = seen.get((name, value, x), 0) + 1
                        totals[name, x] = totals.get((name, x), 0) + 1
        self.edges = [[x / sum(row) for x in row] for row in edges]
        self.table = {
            (name, value): tuple(log((seen.get((name, value, y), 0) + 0.5) / (totals.get((name, y), 0) + 0.5 * len(values) + 0.5)) for y in range(STATES))
            for name, values in kinds.items()
            for value in values
        }

    def marginals(self, nodes: list[Node]) -> list[list[float]]:
        """p(state) of every node by one upward and one downward pass."""
        local = []
        for features in evidence(nodes):
            own = self.table.get(features[0]) or self.table.get(features[1])  # a tag never seen counts by its names alone
            known = [own, *(t for f in features[2:] if (t := self.table.get(f)))]
            s = [sum(x) for x in zip(*known, strict=True)] or [0.0] * STATES
            top = max(s)
            local.append([exp(x - top) for x in s])
        e, states = self.edges, range(STATES)
        up, belief = [None] * len(nodes), local
        for k in range(len(nodes) - 1, 0, -1):
            z = sum(belief[k])
            b = belief[k] = [x / z for x in belief[k]]
            m = up[k] = [sum(map(mul, row, b)) for row in e]
            parent = nodes[k].parent
            p = list(map(mul, belief[parent], m))
            z = max(p)
            belief[parent] = [x / z for x in p]
        belief[0] = [1.0] + [0.0] * (STATES - 1)  # the page itself is a frame
        turned = [list(x) for x in zip(*e, strict=True)]
        for k in range(1, len(nodes)):
            down = [x / y for x, y in zip(belief[nodes[k].parent], up[k], strict=True)]
            b = [belief[k][x] * sum(map(mul, down, turned[x])) for x in states]
            z = sum(b)
            belief[k] = [x / z for x in b]
        return belief

    def extract(self, html: str | None) -> str:
        """The blocks that are likelier content than boiler; text right inside a frame counts as either."""
        if not html:
            return ""
        nodes, runs = parse(html)
        p = self.marginals(nodes)
        return "\n".join(text for k, text in runs if p[k][1] + p[k][2] >= p[k][3] + p[k][4])


def labelled_pages(n: int = 400, seed: int = 20260501) -> list[str]:
    """Training pages from templates: the state of each block is in data-y, 0 frame, 1 content, 2 boiler."""
    r = random.Random(seed)

    def words(a, b):
        return " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(r.randint(a, b)))

    def prose(a, b):
        """Words in sentences; now and then without a mark."""
        if r.random() < 0.1:
            return words(a, b)
        return " ".join(w + r.choices([".", ",", ""], [1, 1, 8])[0] for w in words(a, b).split()) + "."

    def links(tag, a, b):
        return "".join(f'<{tag}><a href="/{words(1, 1)}">{words(1, 3)}</a></{tag}>' for _ in range(r.randint(a, b)))

    def boiler(tag, names, inside):
        if names and r.random() < 0.3:  # a name that tells nothing
            names = words(1, 1)
        return f"<{tag} data-y=2{f' class="{names}"' if names else ''}>{inside}</{tag}>"

    def block(kind):
        pick = r.choice
        if kind == "menu":
            tag = pick(["nav", "nav", "div", "ul"])
            return boiler(tag, "" if tag == "nav" else pick(["menu", "navbar", "breadcrumbs"]), links("li", 3, 8) if tag == "ul" else f"<ul>{links('li', 3, 8)}</ul>")
        if kind == "header":
            tag = pick(["header", "div"])
            return boiler(tag, "" if tag == "header" else pick(["header", "masthead", "topbar"]), f"<h1>{words(1, 4)}</h1><p>{words(3, 9)}</p>")
        if kind == "footer":
            tag = pick(["footer", "footer", "div"])
            return boiler(tag, "" if tag == "footer" else pick(["footer", "copyright"]), pick([f"&copy; {words(4, 14)}", f"<p>{words(4, 20)}</p>", f"<p>{links('span', 2, 4)}</p>"]))
        if kind == "side":
            tag = pick(["aside", "aside", "div", "section"])
            return boiler(tag, "" if tag == "aside" else pick(["sidebar", "related", "widget", "recommended"]), f"<h3>{words(1, 4)}</h3>" + pick([f"<ul>{links('li', 2, 6)}</ul>", f"<p>{words(8, 30)}</p>"]))
        if kind == "ad":
            return boiler(pick(["div", "div", "section", "p", "ins"]), pick(["ad", "ads", "advert", "banner", "sponsored", "promo"]), pick([words(3, 25), f"<p>{words(3, 25)}</p>"]))
        if kind == "notice":
            return boiler(pick(["div", "section", "p", "dialog"]), pick(["cookie", "notice", "consent", "alert", "newsletter", "popup"]), pick([words(5, 30), f"<p>{words(5, 30)}</p>"]))
        if kind == "form":
            return boiler("form", "", f"<p>{words(1, 5)}</p><label>{words(1, 3)}</label><input>{pick(['', f'<fieldset>{words(1, 4)}</fieldset>'])}")
        tag = pick(["div", "section", "ol"])  # reader comments
        one = pick(["div", "article", "li"])
        return boiler(tag, pick(["comments", "comment-list", "discussion", "replies"]), f"<h3>{words(1, 3)}</h3>" + "".join(f'<{one} class="comment"><p>{prose(3, 40)}</p></{one}>' for _ in range(r.randint(1, 4))))

    def paragraphs():
        out = []
        for _ in range(r.randint(1, 9)):
            out.append(r.choice([f"<p>{words(1, 5)}</p>", *[f"<p>{prose(15, 90)}</p>"] * 5, f"<h2>{words(1, 8)}</h2>", f"<ul><li>{words(2, 20)}</li><li>{words(2, 20)}</li></ul>", f"<blockquote><p>{prose(5, 40)}</p></blockquote>", f"<pre>{words(4, 30)}</pre>", f"<figure><figcaption>{words(3, 12)}</figcaption></figure>", f"<table><tr><td>{words(1, 6)}</td><td>{words(1, 6)}</td></tr></table>", f'<p>{prose(9, 30)} <a href="/x">{words(1, 3)}</a> {prose(5, 30)}</p>', f"<div>{prose(10, 60)}</div>", f'<p><a href="/x">{words(3, 12)}</a></p>', f"<ul>{links('li', 2, 4)}</ul>", f"<section>{prose(10, 60)}<p>{prose(10, 60)}</p>{block(r.choice(['ad', 'side']))}</section>"]))
            if r.random() < 0.1:
                out.append(block(r.choice(["ad", "side", "form", "notice"])))
        return "".join(out)

    out = []
    for _ in range(n):
        tag, names = r.choice([("article", ""), ("article", ""), ("article", "post"), ("div", "content"), ("div", "post-body"), ("div", "article entry"), ("section", "story"), ("td", "text"), ("main", ""), ("div", "")])
        head = r.choice([f"<h1>{words(2, 9)}</h1>", f"<header><h1>{words(2, 9)}</h1><p>{words(2, 8)}</p></header>", ""])
        body = f"<{tag} data-y=1{f' class="{names}"' if names else ''}>{head}{paragraphs()}</{tag}>"
        if r.random() < 0.15:  # no container
            body = "".join(f"<p data-y=1>{r.choice([words(1, 6), prose(10, 80)])}</p>" for _ in range(r.randint(1, 6)))
        before = [block(k) for k in ("menu", "header", "ad", "notice", "form") if r.random() < 0.5]
        after = [block(k) for k in ("side", "comments", "ad", "form", "notice", "footer") if r.random() < 0.5]
        r.shuffle(before)
        inner = "".join([*before, body, *after])
        if r.random() < 0.5:
            wrap = r.choice([("div", "container"), ("div", "wrapper"), ("main", ""), ("div", ""), ("section", "")])
            inner = f"<{wrap[0]} data-y=0{f' class="{wrap[1]}"' if wrap[1] else ''}>{inner}</{wrap[0]}>"
        out.append(f"<html data-y=0><body data-y=0>{inner}</body></html>")
    return out


@cache
def trained() -> Model:
    return Model(labelled_pages())


def extract(pages: DataFrame, html_col: str = "html", model: Model | None = None) -> DataFrame:
    """(page, main_text): each row of ``pages`` as a struct, and its main text."""
    model = model or trained()

    @F.pandas_udf("string")
    def main_text(html: pd.Series) -> pd.Series:
        return html.map(model.extract, na_action=None)

    return pages.select(F.struct(*pages.columns).alias("page"), main_text(F.col(html_col)).alias("main_text"))


def query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    text = extract(pages).select("page.page_id", "page.url", F.col("main_text").alias("text"))
    return text.withColumn("n_chars", F.length("text").cast("long"))
