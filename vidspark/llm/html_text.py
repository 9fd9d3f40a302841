"""Main text of web pages by site template removal.

Each page is read once for its element subtrees: a subtree's hash covers its tags and text. Hashes are counted per host in
Spark, over pages with different bodies, so copies of one page count once; a subtree that recurs on MIN_PAGES pages of its
host, however large that is, is part of the site's template. A second reading leaves these subtrees out.

With them goes what is no article by its element, role, visibility, class or id: menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments. A class or id says so as a whole, by its last part, or by its
first part where that is plain; names like has-sidebar or no-comments say nothing. Whatever a name says, the element that
holds the page's largest article stays, and on a page without article and main the one that holds most of its text.
Headers inside an article stay, as they hold its heading. Paragraphs, headings and other text blocks of an article are
never taken for a template, however often they recur. All other blocks stay in page order, inside and outside of article
and main.

The recurring subtrees are sent to all tasks while there are at most SENT_TEMPLATES of them. Beyond that the subtrees of
each page are joined to them by host and hash and gathered by page, with the same result.

Defined results: null or empty html gives an empty text; broken markup is read as browsers do (open elements end with what
holds them, an unfinished tag or comment hides the rest); a null url is a host of its own; repeated rows give repeated
rows; pages of any length are read whole; other columns are left out; an empty table gives no row.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vidspark.llm.common import batch_of, materialize, text_slices

#: A subtree is part of a template if it is on so many different pages of a host.
MIN_PAGES = 5
#: Recurring subtrees are sent to all tasks up to so many (some 20 MB).
SENT_TEMPLATES = 200_000

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
#: Elements that are never article text, and those that are not unless they hold the article.
NEVER = frozenset("head script style noscript template button select textarea title iframe object svg math menu audio video "
                  "canvas datalist noembed noframes input".split())
ASIDE = frozenset("nav header footer aside form dialog".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote article main body html".split())
OUTER = frozenset("html body main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead comment comments disqus reply replies respond related recommended share sharing social "
    "popup modal overlay login signup paywall widget toolbar pagination pager skip".split())
#: Marks that say the same as the first part of a name, such as ad-slot or comment-list.
FIRST = frozenset("ad ads adv advert adverts advertisement sponsor sponsored promo cookie cookies consent gdpr newsletter "
                  "sidebar nav navbar breadcrumb breadcrumbs comment comments disqus related recommended popup".split())
#: What an article itself must be called to be none, and what names a heading inside of one.
OTHER_ARTICLES = frozenset("comment comments reply related recommended sponsored promo ad".split())
HEADINGS = frozenset("header masthead banner".split())
#: First parts of names that tell of something else than the element.
ABOUT = frozenset("has no not with without is hide show".split())
_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""",
                        re.I)
_PARTS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _hidden(attributes: str) -> bool:
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return True
    return False


def _marked(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether role, class or id say that an element isn't article text."""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role" and value in ROLES:
            return True
        if name not in ("class", "id") or tag in OUTER:
            continue
        for token in value.split():
            parts = _PARTS.findall(token)
            if not parts or parts[0] in ABOUT and len(parts) > 1:
                continue
            said = {parts[-1], "".join(parts)} & MARKS | ({parts[0]} & FIRST)
            if tag == "article":
                said &= OTHER_ARTICLES
            elif in_article:
                said -= HEADINGS
            if said:
                return True
    return False


class _Element:
    """parent: number of the element around it; never, aside: left out always, or unless it holds the article."""
    __slots__ = ("tag", "parent", "never", "aside", "article", "skipped", "parts", "code", "size")

    def __init__(self, tag: str, parent: int, never: bool, aside: bool, article: bool, skipped: bool, parts: list):
        self.tag, self.parent, self.never, self.aside, self.article, self.skipped, self.parts = (
            tag, parent, never, aside, article, skipped, parts)
        self.code, self.size = None, 0


def read_page(page: str, templates: frozenset = frozenset()) -> tuple[str, set[int]]:
    """Text of a page without ``templates``, and the hashes of its subtrees that may belong to a template."""
    elements = [_Element("", 0, False, False, False, False, [])]
    stack = [0]
    opened: dict[str, int] = {}
    pieces: list[tuple[int, str | None]] = []  # element and its text; None: a block ends
    found: set[int] = set()

    def close() -> None:
        element = elements[stack.pop()]
        opened[element.tag] -= 1
        if element.tag not in INLINE:
            pieces.append((0, None))
        code = int.from_bytes(blake2b("\x00".join(element.parts).encode("utf-8", "replace"), digest_size=8).digest(),
                              "little", signed=True)
        element.parts = None
        elements[stack[-1]].parts.append(f"\x01{code:x}")
        if element.tag not in INLINE and not (element.article and element.tag in TEXT_BLOCKS) and not element.skipped:
            found.add(code)
            element.code = code

    def text(piece: str) -> None:
        if piece:
            elements[stack[-1]].parts.append(piece)
            if not elements[stack[-1]].never:
                pieces.append((stack[-1], entities.unescape(piece)))

    at, size, whole = 0, len(page), True
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        ahead = page[lt + 1:lt + 3]
        if ahead[:1] in ("!", "?"):
            text(page[at:lt])
            mark = "-->" if page.startswith("<!--", lt) else ">"
            end = page.find(mark, lt + 1)
            at = size if end < 0 else end + len(mark)
            continue
        name = ahead[1:2] if ahead[:1] == "/" else ahead[:1]
        if not ("a" <= name <= "z" or "A" <= name <= "Z"):
            text(page[at:lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        match = _TAG.match(page, lt) if whole else None
        if match:
            tag, attributes, at = match[1].lower(), match[2], match.end()
        else:  # a quote that never ends, or no end at all
            whole = False
            end = page.find(">", lt)
            if end < 0:
                break
            body = page[lt + 1 + (ahead[:1] == "/"):end]
            tag = re.match(r"[^\s/>]+", body)[0].lower()
            attributes, at = body[len(tag):], end + 1
        if ahead[:1] == "/":
            if opened.get(tag, 0) > 0:
                while elements[stack[-1]].tag != tag:
                    close()
                close()
            elif tag not in INLINE:
                pieces.append((0, None))
            continue
        if tag == "br":
            pieces.append((stack[-1], " "))
        elif tag not in INLINE:
            pieces.append((0, None))
        if tag in VOID:
            elements[stack[-1]].parts.append(f"\x02{tag}")
            continue
        if tag == "p" and opened.get("p", 0) > 0:
            depth = len(stack) - 1
            while elements[stack[depth]].tag in INLINE:
                depth -= 1
            if elements[stack[depth]].tag == "p":
                while len(stack) > depth:
                    close()
        parent = elements[stack[-1]]
        never = parent.never or tag in NEVER or bool(attributes) and _hidden(attributes)
        aside = tag in ASIDE and not (tag == "header" and parent.article) or bool(attributes) and _marked(tag, attributes, parent.article)
        elements.append(_Element(tag, stack[-1], never, aside, parent.article or tag == "article",
                                 parent.skipped or never, [tag, attributes]))
        stack.append(len(elements) - 1)
        opened[tag] = opened.get(tag, 0) + 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            elements[-1].parts.append(page[at:end.start() if end else size])
            at = end.start() if end else size
    while len(stack) > 1:
        close()
    return _kept_text(elements, pieces, templates), found


def _kept_text(elements: list[_Element], pieces: list[tuple[int, str | None]], templates: frozenset) -> str:
    for of, piece in pieces:
        if piece is not None:
            elements[of].size += len(piece.strip())
    for element in reversed(elements[1:]):
        elements[element.parent].size += element.size
    # the way from the largest article, or main, or else the one with most of the text, up to the page is no aside
    held = [k for tag in ("article", "main") for k, e in enumerate(elements)
            if e.tag == tag and e.size and not e.never and not (tag == "article" and e.aside)]
    articles = [k for k in held if elements[k].tag == "article"] or held
    if articles:
        k = max(articles, key=lambda k: elements[k].size)
    else:
        k = max((k for k, e in enumerate(elements) if e.aside and 2 * e.size > elements[0].size), default=0)
    while k:
        elements[k].aside = False
        k = elements[k].parent
    gone = [False] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        gone[k] = gone[e.parent] or e.never or e.aside or e.code in templates
    blocks, run = [], []
    for of, piece in [*pieces, (0, None)]:
        if piece is not None:
            if not gone[of]:
                run.append(piece)
        elif run:
            if block := " ".join("".join(run).split()):
                blocks.append(block)
            run = []
    return " ".join(blocks)


def _host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[^/?#]*//(?:[^/?#@]*@)?([^/?#:]*)", 1))


_SUBTREES = pa.schema([("host", pa.int64()), ("page", pa.int64()), ("subtree", pa.int64())])


def _subtrees(pages: DataFrame) -> DataFrame:
    """(host, page, subtree) of every page's subtrees, from (host, page, html)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, texts in text_slices(batches, "html"):
            found = [sorted(read_page((data or b"").decode())[1]) for data in texts]
            times = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield batch_of(_SUBTREES, [batch.column(0).take(times), batch.column(1).take(times), [c for f in found for c in f]])

    return pages.select("host", "page", "html").mapInArrow(run, "host long, page long, subtree long")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, subtree) of the subtrees that recur on so many different pages of a host, from (host, page, html)."""
    return _subtrees(pages).distinct().groupBy("host", "subtree").agg(F.count("*").alias("n")) \
        .where(F.col("n") >= min_pages).select("host", "subtree")


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
              min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text) of every page."""
    whole = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.xxhash64(_host(url)).alias("host"),
                        F.xxhash64(whole).alias("page"), whole.alias("html"))
    recurring = materialize(templates(rows, min_pages), "templates")
    schema = rows.select("page_id", "url", F.lit("").cast("string").alias("text")).schema
    if recurring.count() > SENT_TEMPLATES:
        of_page = _subtrees(rows).join(recurring, ["host", "subtree"]).groupBy("host", "page").agg(
            F.collect_set("subtree").alias("template"))  # a page has no more than its own subtrees
        joined = rows.join(of_page, ["host", "page"], "left").select("page_id", "url", "html", "template")

        def read(batches: Iterator[pa.RecordBatch]):
            for batch, texts in text_slices(batches, "html"):
                out = [read_page((data or b"").decode(), frozenset(t or ()))[0]
                       for data, t in zip(texts, batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())],
                                                 names=["page_id", "url", "text"])
        return joined.mapInArrow(read, schema)
    by_host: dict[int, set] = {}
    for r in recurring.collect():  # at most SENT_TEMPLATES rows
        by_host.setdefault(r["host"], set()).add(r["subtree"])
    sent = pages.sparkSession.sparkContext.broadcast({h: frozenset(t) for h, t in by_host.items()})

    def run(batches: Iterator[pa.RecordBatch]):
        known = sent.value
        for batch, texts in text_slices(batches, "html"):
            out = [read_page((data or b"").decode(), known.get(host, frozenset()))[0]
                   for data, host in zip(texts, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())],
                                             names=["page_id", "url", "text"])

    return rows.select("page_id", "url", "host", "html").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extracted(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
