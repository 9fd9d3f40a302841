"""Page texts against a second, slower reader that builds a tree with the standard library's parser."""

import os
from collections import defaultdict
from html.parser import HTMLParser
from urllib.parse import urlsplit

import duckdb
import pytest

from vidspark.llm import html_text as ht

DATA = "/root/testdata/sf0.01/pages.parquet"


class Node:
    def __init__(self, tag, attributes, parent):
        self.tag, self.attributes, self.parent, self.kids = tag, attributes, parent, []

    def all(self):
        yield self
        for kid in self.kids:
            if isinstance(kid, Node):
                yield from kid.all()

    def inside(self, test):
        node = self
        while node is not None:
            if test(node):
                return True
            node = node.parent
        return False

    def text(self):
        return "".join(k if isinstance(k, str) else k.text() for k in self.kids)

    def outline(self):
        return (self.tag, tuple(self.attributes), tuple(k if isinstance(k, str) else k.outline() for k in self.kids))


class Tree(HTMLParser):
    """For well-formed pages, as those of the table are."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.at = self.root = Node("", [], None)
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attributes):
        node = Node(tag, attributes, self.at)
        self.at.kids.append(node)
        if tag not in ht.VOID:
            self.at = node

    def handle_startendtag(self, tag, attributes):
        self.at.kids.append(Node(tag, attributes, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def names(node):
    """The verdict on a role, class or id, word by word."""
    in_article = node.parent is not None and node.parent.inside(lambda n: n.tag == "article")
    for name, value in node.attributes:
        value = (value or "").lower()
        if name == "role" and value in ht.ROLES:
            return True
        if name in ("class", "id") and node.tag not in ht.OUTER:
            for token in value.split():
                parts = [p for p in "".join(c if c.isascii() and c.isalpha() else " " for c in token).split()]
                if not parts or len(parts) > 1 and parts[0] in ht.ABOUT:
                    continue
                said = {w for w in (parts[-1], "".join(parts)) if w in ht.MARKS} | {w for w in parts[:1] if w in ht.FIRST}
                if node.tag == "article":
                    said = {w for w in said if w in ht.OTHER_ARTICLES}
                elif in_article:
                    said = {w for w in said if w not in ht.HEADINGS}
                if said:
                    return True
    return False


def never(node):
    return node.tag in ht.NEVER or any(n == "hidden" or (n, v) == ("aria-hidden", "true") for n, v in node.attributes)


def aside(node):
    in_article = node.parent is not None and node.parent.inside(lambda n: n.tag == "article")
    return node.tag in ht.ASIDE and not (node.tag == "header" and in_article) or names(node)


def countable(node):
    text_block = node.tag in ht.TEXT_BLOCKS and node.inside(lambda n: n.tag == "article")
    return node.tag and node.tag not in ht.INLINE and node.tag not in ht.VOID and not text_block and not node.inside(never)


def slow_texts(rows):
    trees = {i: Tree(page or "").root for i, _, page in rows}
    on = defaultdict(set)
    host = lambda url: urlsplit(url or "").hostname
    for i, url, page in rows:
        for node in trees[i].all():
            if countable(node):
                on[host(url), node.outline()].add(page)
    out = {}
    for i, url, _ in rows:
        root = trees[i]
        size = lambda n: len("".join(n.text().split())) if not n.inside(never) else 0
        held = [n for n in root.all() if n.tag == "article" and size(n) and not aside(n)] or [
            n for n in root.all() if n.tag == "main" and size(n)]
        safe = set()
        if held:
            node = max(held, key=size)
            while node is not None:
                safe.add(id(node))
                node = node.parent
        blocks, run = [], []

        def flush():
            if block := " ".join("".join(run).split()):
                blocks.append(block)
            run.clear()

        def walk(node):
            for kid in node.kids:
                if isinstance(kid, str):
                    run.append(kid)
                    continue
                if kid.tag == "br":
                    run.append(" ")
                elif kid.tag not in ht.INLINE:
                    flush()
                template = countable(kid) and len(on[host(url), kid.outline()]) >= ht.MIN_PAGES
                if not (never(kid) or template or aside(kid) and id(kid) not in safe):
                    walk(kid)
                if kid.tag not in ht.INLINE:
                    flush()

        walk(root)
        flush()
        out[i] = " ".join(blocks)
    return out


@pytest.mark.skipif(not os.path.exists(DATA), reason="no pages")
@pytest.mark.parametrize("sent", [200_000, 0])
def test_pages_equal_a_slow_reader(spark, monkeypatch, sent):
    monkeypatch.setattr(ht, "SENT_TEMPLATES", sent)
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{DATA}'").fetchall()
    got = {r.page_id: r.text for r in ht.extracted(spark.read.parquet(DATA)).collect()}
    want = slow_texts(rows)
    assert got == want and sum(map(len, want.values())) > 10_000


@pytest.mark.parametrize("sent", [200_000, 0])
def test_a_box_of_a_part_of_a_large_host(spark, monkeypatch, sent):
    """On five of sixty pages, nothing names it; copies of one page count once."""
    monkeypatch.setattr(ht, "SENT_TEMPLATES", sent)
    box, rare = "<section><p>from our shop</p></section>", "<section><p>seldom</p></section>"
    rows = [(k, "http://a.example/x", f"<div><p>own {k}</p></div>{box if k < 5 else rare if k < 9 else ''}") for k in range(60)]
    rows += [(100 + k, "http://a.example/y", rows[8][2]) for k in range(9)] + [(200, "http://other.example", rows[0][2])]
    out = {r.page_id: r.text for r in ht.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [out[k] for k in (0, 4, 8, 59, 108, 200)] == ["own 0", "own 4", "own 8 seldom", "own 59", "own 8 seldom", "own 0 from our shop"]


@pytest.mark.parametrize("page,text", [
    ('<div class="layout has-sidebar"><article><p>one</p></article></div>', "one"),
    ('<div class="post no-comments"><p>two</p></div>', "two"),
    ('<article><div class="share-price-table">three</div><p>x</p></article>', "three x"),
    ("<article><header><h1>four</h1></header><p>x</p></article>", "four x"),
    ('<article><div class="article-header"><h1>five</h1></div><p>x</p></article>', "five x"),
    ('<form><div class="sidebar-layout"><article><p>six</p></article><div class="sidebar">no</div></div></form>', "six"),
    ('<main><p>b</p><section class="comments"><article class="comment"><p>' + "long " * 50 + "</p></article></section></main>", "b"),
    ('<div class="widget"><p>all of it</p></div><div class="footer">f</div>', "all of it"),
    ('<div class="ad-slot">buy</div><div class="cookie-notice">ok</div><p>rest</p>', "rest"),
    ("<header><h1>site</h1></header><p>rest</p>", "rest"),
    ("<p>" + "word " * 400_000 + "</p>", ("word " * 400_000).strip()),
])
def test_what_names_say(page, text):
    assert ht.read_page(page)[0] == text
