"""Main text of web pages, with site templates removed.

Python parses each page into text blocks and the hashes of the element
subtrees around them (tag, text and child hashes; attributes don't count). The
hashes are written once; Spark counts, per host, in how many pages each
occurs, with sums on the map side. A subtree is a template of its host when at
least ``LEAST_PAGES`` of its pages hold it, however many pages the host has;
copies of a page are one page. The rows of (page, hash) are joined to the
host's frequent hashes, so that each page learns its own templates only, and
nothing holds all templates of a host. Then the pages are parsed again (less
disk than keeping all their blocks as well as dealing them out) and blocks
inside a template go; the rest is the text. An element around blocks is kept as
the run of blocks that it covers, so a page's blocks and elements take memory
in proportion to its length, however deep they nest.

Besides templates, elements go that say what they are by tag, role, class or
id: menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, reader comments. Where articles (else a main element) are marked, only
they are read. Paragraphs, headings and other text blocks inside them are
never taken for templates, since articles may quote or repeat each other.

Text: character references decoded, white space inside a block made one
space, trimmed, blocks in page order joined by an empty line.

Defined cases: null or empty html gives an empty text; unclosed, misnested and
cut-off tags are closed where the page or a parent ends; quoted attribute
values are read whole, of any length; a null url is a host
of its own; repeated pages are each answered; an empty table gives an empty
table; extra columns are left aside, whatever their names. Parsing is linear in
time and memory and not recursive: the nearest open element of a name is looked
up, not searched, so depth and length are bounded by the page alone.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape
from itertools import accumulate

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import isolate, write_once

LEAST_PAGES = 5
#: One part in so many of all rows makes a hash hot.
HOT = 1000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements whose text stands on its own.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
                  "summary table tbody tfoot thead tr ul".split())
CONTAINER = frozenset("aside center details div dl fieldset figure footer form header menu nav ol section table ul".split())
#: Opening one of these closes an open element of the same group.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "body": ("head",)}
SCOPE = frozenset("ul ol dl menu table select html body article section div".split())
#: Elements that are never the article's text.
DROP_TAGS = frozenset("nav footer aside form script style noscript template iframe button select textarea dialog svg canvas head "
                      "title menu object embed audio video input fieldset".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar form alert".split())
DROP_WORDS = frozenset("ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
                       "gdpr notice notices popup modal overlay newsletter subscribe subscription signup sidebar widget widgets menu nav "
                       "navbar navigation breadcrumb breadcrumbs masthead footer comment comments commentlist disqus respond replies "
                       "share sharing social related recommended recommendations pagination pager login toolbar copyright paywall "
                       "disclaimer hidden".split())
MARKED = frozenset(("article", "main"))

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*))", re.S)
_PLAIN = re.compile(r"[^>\"']*")
#: A whole quoted value is no place to look for names.
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
_NAME = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b", re.I)
_WORD = re.compile(r"[a-z0-9]+")


class Attributes:
    """Where the attributes of a page's tags end: at the first ``>`` outside quotes, or, where a quote has
    no partner, at the first ``>`` of all. Quotes without partner are remembered, and so are all that a
    scan opened before it met one, so that reading is linear whatever the page holds."""

    def __init__(self, html: str):
        self.html, self.alone, self.lost = html, {}, set()

    def end(self, at: int) -> int:
        html, i, opened = self.html, at, []
        while True:
            i = _PLAIN.match(html, i).end()
            if i == len(html) or html[i] == ">":
                return i
            quote = html[i]
            close = -1 if i in self.lost or i >= self.alone.get(quote, len(html)) else html.find(quote, i + 1)
            opened.append(i)
            if close < 0:
                if i not in self.lost:
                    self.alone[quote] = min(i, self.alone.get(quote, i))
                self.lost.update(opened)
                stop = html.find(">", at)
                return len(html) if stop < 0 else stop
            i = close + 1


def attributes(attrs: str):
    """(name, value) of the attributes that may tell what an element is."""
    for name, a, b, c in _ATTR.findall(attrs):
        for m in _NAME.finditer(name):
            yield m.group(1).lower(), (a or b or c).lower() if m.end() == len(name) else ""


class Page:
    """Elements in page order (``tag``, ``attrs``, ``parent``, ``digest``) and the run of opens, texts and closes."""

    def __init__(self, html: str):
        self.tag, self.attrs, self.parent, self.parts = ["html"], [""], [-1], [[]]
        self.run: list[tuple] = []   # (node, text); text None opens the node, False closes it
        self.digest = [0]
        self.full = [False]
        self.open = [0]
        self.names: defaultdict = defaultdict(list)   # where in ``open`` the elements of each tag are
        at, end, attributes_of = 0, len(html), Attributes(html)
        while m := _TAG.search(html, at):
            if m.start() > at:
                self.text(html[at:m.start()])
            at = m.end()
            name = m.group(2)
            if name is None:
                if m.group(0).startswith("<![CDATA["):
                    self.text(m.group(0)[9:].removesuffix("]]>"))
                continue
            name, stop = name.lower(), attributes_of.end(at)
            attrs, at = html[at:stop], min(stop + 1, end)
            if m.group(1):
                self.end(name)
                continue
            self.start(name, attrs)
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(html, at)
                stop = close.start() if close else end
                self.text(html[at:stop])
                at = stop
        if at < end:
            self.text(html[at:])
        while self.open:
            self.close()

    def text(self, raw: str) -> None:
        node = self.open[-1]
        text = unescape(raw) if "&" in raw else raw
        self.run.append((node, text))
        flat = " ".join(text.split())
        if flat:
            self.parts[node].append(flat)
            self.full[node] = True

    def start(self, name: str, attrs: str) -> None:
        if name in ("html",) or name == "body" and self.names["body"]:
            return
        if name in BLOCK and self.names["p"]:
            self.up_to(("p",), SCOPE - {"div", "section"})
        if name in CLOSES:
            self.up_to(CLOSES[name], SCOPE - {"table"} if name in ("td", "th", "tr", "tbody", "tfoot") else SCOPE)
        self.tag.append(name)
        self.attrs.append(attrs or "")
        self.parent.append(self.open[-1])
        self.parts.append([])
        self.digest.append(0)
        self.full.append(False)
        node = len(self.tag) - 1
        self.names[name].append(len(self.open))
        self.open.append(node)
        self.run.append((node, None))
        if name in VOID:
            self.close()

    def up_to(self, names: tuple, scope) -> None:
        """Close the nearest open element of ``names``, unless one of ``scope`` is nearer."""
        k = self.nearest(names)
        if k and k >= self.nearest(scope):
            while len(self.open) > k:
                self.close()

    def nearest(self, names) -> int:
        """Where in ``open`` the nearest element of ``names`` is; 0 if none is open."""
        return max((self.names[name][-1] for name in names if self.names.get(name)), default=0)

    def end(self, name: str) -> None:
        if not self.names[name]:
            return
        while self.tag[self.open[-1]] != name:
            self.close()
        self.close()

    def close(self) -> None:
        node = self.open.pop()
        if self.open:
            self.names[self.tag[node]].pop()
        self.run.append((node, False))
        if self.full[node]:
            told = f"{self.tag[node]}\x00" + "\x00".join(map(str, self.parts[node]))
            self.digest[node] = xxhash.xxh64_intdigest(told.encode("utf-8", "surrogatepass")) - (1 << 63)
            up = self.parent[node]
            if up >= 0:
                self.parts[up].append(self.digest[node])
                self.full[up] = True
        self.parts[node] = []


def marked(page: Page) -> list[bool]:
    """Whether each element is, or is inside, an article or main element."""
    inside = [False] * len(page.tag)
    for i, tag in enumerate(page.tag):   # parents come first
        inside[i] = tag in MARKED or page.parent[i] >= 0 and inside[page.parent[i]]
    return inside


def holds_marked(page: Page) -> list[bool]:
    held = [tag in MARKED or tag in ("html", "body") for tag in page.tag]
    for i in range(len(page.tag) - 1, 0, -1):
        if held[i]:
            held[page.parent[i]] = True
    return held


def boilerplate(page: Page, i: int, inside: bool) -> bool:
    tag, attrs = page.tag[i], page.attrs[i]
    if tag in DROP_TAGS or tag == "header" and not inside:
        return True
    if attrs:
        for name, value in attributes(attrs):
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            words = _WORD.findall(value)
            if name == "role":
                if DROP_ROLES.intersection(words):
                    return True
            elif DROP_WORDS.intersection(words) or not inside and "header" in words:
                return True
    return False


def main_blocks(html: str | None) -> tuple[list[str], list[tuple[int, int, int]]]:
    """The page's text blocks without marked boilerplate, and (hash, first, end) of each element that may be a
    template of the site and holds blocks ``first`` to ``end`` - 1. Those elements begin and end blocks, so
    that none covers a part of one."""
    if not html:
        return [], []
    page = Page(html)
    inside, holds = marked(page), holds_marked(page)
    size = len(page.tag)
    gone, article, main, told = [False] * size, [False] * size, [False] * size, [False] * size
    for i, tag in enumerate(page.tag):
        up = page.parent[i]
        if up >= 0:
            gone[i], article[i], main[i] = gone[up], article[up], main[up]
        if gone[i] or not page.full[i]:
            continue
        gone[i] = (not holds[i] or tag == "article") and boilerplate(page, i, inside[i])
        article[i], main[i] = not gone[i] and (article[i] or tag == "article"), not gone[i] and (main[i] or tag == "main")
        told[i] = not holds[i] and (tag in CONTAINER or not inside[i] and tag in BLOCK)
    keep = next((part for part in (article, main) if any(part)), None)
    blocks, here, spans, first = [], [], [], [0] * size
    for node, text in [*page.run, (0, False)]:
        if text is None or text is False:
            tag = page.tag[node]
            if tag in BLOCK:
                joined = " ".join("".join(here).split())
                if joined:
                    blocks.append(joined)
                here = []
                if text is None:
                    first[node] = len(blocks)
                elif told[node] and first[node] < len(blocks):
                    spans.append((page.digest[node], first[node], len(blocks)))
            elif tag in ("br", "td", "th"):
                here.append(" ")
        elif not gone[node] and (keep is None or keep[node]):
            here.append(text)
    return blocks, spans


def outside(blocks, spans, templates) -> str:
    """The text of the blocks that no template covers."""
    edge = [0] * (len(blocks) + 1)
    templates = set(templates)
    for digest, first, end in spans:
        if digest in templates:
            edge[first] += 1
            edge[end] -= 1
    return "\n\n".join(text for text, covered in zip(blocks, accumulate(edge)) if not covered)


def main_text(html: str | None, templates=()) -> str:
    """One page's text, for known template hashes."""
    return outside(*main_blocks(html), templates)


def page_templates(seen: DataFrame, least_pages: int = LEAST_PAGES, hot: int = HOT) -> DataFrame:
    """(host, digest, templates) from distinct pages (host, digest, around: a page's distinct hashes), for pages with any.
    Rows of (page, hash) meet their host's frequent hashes; the fewer than ``hot`` hashes with more than
    1 / ``hot`` of all those rows are broadcast, so no key of the shuffled join holds more than that."""
    pages = write_once(seen, "subtrees")
    rows = pages.select("host", "digest", F.explode("around").alias("hash"))
    often = write_once(rows.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages), "often")
    limit = (often.agg(F.sum("n")).first()[0] or 0) / hot
    most = F.broadcast(often.where(F.col("n") > limit).select("host", "hash"))
    found = rows.join(most, ["host", "hash"]).unionByName(
        rows.join(most, ["host", "hash"], "left_anti").join(often.where(F.col("n") <= limit).select("host", "hash"), ["host", "hash"]))
    return found.groupBy("host", "digest").agg(F.collect_list("hash").alias("templates"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    base, at = isolate(pages)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(at[url_col]), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))

    @F.pandas_udf("array<long>")
    def around_of(html: pd.Series) -> pd.Series:
        return html.map(lambda h: sorted({digest for digest, _, _ in main_blocks(h)[1]}))

    @F.pandas_udf("blocks array<string>, digests array<long>, firsts array<int>, ends array<int>")
    def blocks_of(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(blocks, [s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans])
                             for blocks, spans in map(main_blocks, html)], columns=["blocks", "digests", "firsts", "ends"])

    @F.pandas_udf("string")
    def text_of(page: pd.DataFrame, templates: pd.Series) -> pd.Series:
        return pd.Series([None if found is None else outside(blocks, zip(digests, firsts, ends), found)
                          for blocks, digests, firsts, ends, found in
                          zip(page["blocks"], page["digests"], page["firsts"], page["ends"], templates)], dtype=object)

    html = F.col(at[html_col]).cast("string")
    # 128 bits: pages of one host and digest are copies
    keyed = base.select(F.col(at[id_col]).alias("page_id"), F.col(at[url_col]).alias("url"), host.alias("host"), html.alias("html"),
                        F.struct(F.xxhash64(html), F.xxhash64(F.lit(5), html)).alias("digest"))
    seen = keyed.select("host", "digest", around_of("html").alias("around")).groupBy("host", "digest").agg(F.first("around").alias("around"))
    # written, so that Spark plans the join by the table's true size and need not shuffle the texts for a small one
    templates = write_once(page_templates(seen, least_pages), "templates")
    # only the blocks of pages with templates go to Python again
    left = text_of(F.when(F.col("templates").isNotNull(), F.col("parsed")), "templates")
    text = F.when(F.col("templates").isNull(), F.array_join("parsed.blocks", "\n\n")).otherwise(left)
    return (keyed.select("page_id", "url", "host", "digest", blocks_of("html").alias("parsed"))
            .join(templates, ["host", "digest"], "left").select("page_id", "url", F.coalesce(text, F.lit("")).alias("text"))
            .withColumn("n_chars", F.char_length("text").cast("long")))


def query(pages: DataFrame) -> DataFrame:
    return extract(pages)
