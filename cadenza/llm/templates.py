"""The main text of web pages: what a site repeats on many of its pages is removed.

Every page is read into a tree of elements, and every block element gets a hash of its subtree: its tag, class, text and its
children's hashes. Spark counts for each host on how many different pages a subtree occurs. Subtrees on MANY pages and
on SHARE of the host's pages are the site's template: menus, headers, footers, notices, adverts. They are deleted, as are elements that
say by their tag, role, class or id that they aren't the article, which covers hosts with few pages. What
remains of the page's article (or main part, or body where there is neither) is its text.

Paragraphs, headings and items inside the article are the author's own, also where many articles repeat them: there only
elements with a class, id or role of their own, or mostly made of links, count as template. Pages of one host with equal articles count
once, so that copies of an article don't become one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, stored

MANY, SHARE = 5, 0.005
#: Template keys that every task may hold, 8 bytes each; more are joined.
HELD_KEYS = 2_000_000

# Fixed values of HTML: elements without content, with raw content, and inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("script style template noscript iframe object svg canvas audio video button select option optgroup textarea math meter progress output picture map a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Where an open item, cell or row is not sought any further.
BARRIER = {"li": frozenset("ul ol menu table td th".split()), "dt": frozenset(("dl", "table")), "dd": frozenset(("dl", "table"))}
BARRIER |= {"tr": frozenset(("table",)), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table"))}
CLOSES = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}

# What isn't part of an article, by tag, by role, and by words of class and id.
NOT_TAGS = frozenset("head nav aside footer form script style noscript template iframe object svg canvas audio video button select textarea dialog datalist title xmp noembed noframes menu".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NOT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs pager pagination sidebar widget related recommended"
    " recommendations footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus reply replies respond toolbar masthead".split()
)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TAG = re.compile(r"""<(?:!--(?:.*?)(?:--!?>|\Z)|(?:[!?]|/(?=[^a-zA-Z]))[^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>)""", re.S)
_BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")


class Page:
    """The elements of a page, parents before children, and its pieces of text. A piece belongs to an element and a block."""

    def __init__(self, text: str):
        self.tags, self.parents, self.classes, self.unwanted, self.named = ["html"], [-1], [""], [False], [False]
        self.main = [False]
        self.digests: list[int] = [0]
        self.pieces: list[tuple[int, int, str]] = []
        self.stack, self.parts, self.open = [0], [[]], {"html": 1}
        self.block = 0
        self._read(text)
        while self.stack:
            self._pop()
        self._measure()

    def _read(self, text: str) -> None:
        at, end, last = 0, len(text), text.rfind(">")
        while at < end:
            begin = text.find("<", at)
            if begin < 0:
                begin = end
            found = None
            if begin < end:
                found = _TAG.match(text, begin) or _BROKEN.match(text, begin)
                if not found:
                    opens = text[begin + 1 : begin + 2]
                    if begin > last and opens.isascii() and (opens.isalpha() or opens in ("/", "!", "?")):
                        self._text(text[at:begin])  # an unfinished tag at the end is no text
                        return
                    # A lone character; what follows up to the next tag is one piece with it.
                    following = text.find("<", begin + 1)
                    begin = end if following < 0 else following
                    self._text(text[at:begin])
                    at = begin
                    continue
            if begin > at:
                self._text(text[at:begin])
            if not found:
                return
            at = found.end()
            if found.lastindex is None:
                continue  # comments and declarations
            tag = found[2].lower()
            if found[1]:
                self._close(tag)
            else:
                self._start(tag, found[3])
                if tag in RAW:
                    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(text, at)
                    at = close.start() if close else end

    def _text(self, raw: str) -> None:
        if raw.strip():
            self.pieces.append((self.stack[-1], self.block, raw))
            self.parts[-1].append(" ".join(raw.split()).encode("utf-8", "surrogatepass"))
        elif self.pieces and self.pieces[-1][1] == self.block:
            self.pieces.append((self.stack[-1], self.block, " "))

    def _start(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag == "hr":
                self.block += 1
            elif tag == "br":
                self._text(" ")
            return
        inline = tag in INLINE
        if not inline:
            self._close_paragraph()
            if tag in BARRIER:
                self._close_open(CLOSES.get(tag, (tag,)), BARRIER[tag])
            self.block += 1
        given: dict[str, str] = {}
        if attributes and not attributes.isspace():
            for name, *values in _ATTRIBUTE.findall(attributes):
                given.setdefault(name.lower(), values[0] or values[1] or values[2])
        names = given.get("class", ""), given.get("id", "")
        role = given.get("role", "").lower()
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
        words = {w.lower() for n in names if n for w in _NAME.findall(n)} if tag not in ("html", "body") else set()
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.classes.append(names[0])
        self.named.append(bool(names[0] or names[1] or role))
        self.unwanted.append(tag in NOT_TAGS or role in NOT_ROLES or hidden or not words.isdisjoint(NOT_NAMES))
        self.main.append(not self.unwanted[-1] and (tag in ("article", "main") or role in ("article", "main") or given.get("itemprop") == "articleBody"))
        self.digests.append(0)
        self.stack.append(len(self.tags) - 1)
        if not inline:
            self.parts.append([])
        self.open[tag] = self.open.get(tag, 0) + 1

    def _pop(self) -> None:
        e = self.stack.pop()
        tag = self.tags[e]
        self.open[tag] -= 1
        if tag in INLINE:
            return
        own = self.parts.pop()
        self.block += 1
        if own:
            self.digests[e] = xxhash.xxh64_intdigest(b"\0".join((f"{tag} {self.classes[e]}".encode("utf-8", "surrogatepass"), *own)))
            if self.parts:
                self.parts[-1].append(b"\1" + self.digests[e].to_bytes(8, "big"))

    def _close(self, tag: str) -> None:
        if not self.open.get(tag) or tag == "html":
            return
        if tag in INLINE:
            k = len(self.stack) - 1
            while self.tags[self.stack[k]] in INLINE and self.tags[self.stack[k]] != tag:
                k -= 1
            if self.tags[self.stack[k]] != tag:
                return
        elif tag == "p":
            self._close_paragraph()
            return
        else:
            k = len(self.stack) - 1
            while self.tags[self.stack[k]] != tag:
                k -= 1
        while len(self.stack) > k:
            self._pop()

    def _close_paragraph(self) -> None:
        if self.open.get("p"):
            k = len(self.stack) - 1
            while self.tags[self.stack[k]] in INLINE:
                k -= 1
            if self.tags[self.stack[k]] == "p":
                while len(self.stack) > k:
                    self._pop()

    def _close_open(self, tags: tuple[str, ...], barrier: frozenset[str]) -> None:
        if not any(self.open.get(t) for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[k]]
            if tag in tags:
                while len(self.stack) > k:
                    self._pop()
                return
            if tag in barrier:
                return

    def _measure(self) -> None:
        """Characters of text and of links below each element, and the part of the page that holds the article."""
        n = len(self.tags)
        self.sizes, self.linked = [0] * n, [0] * n
        for e, _, raw in self.pieces:
            self.sizes[e] += len(raw)
        self.links = [self.tags[e] == "a" for e in range(n)]
        for e in range(1, n):
            self.links[e] = self.links[e] or self.links[self.parents[e]]
        for e in range(n):
            self.linked[e] = self.sizes[e] if self.links[e] else 0
        for e in range(n - 1, 0, -1):
            self.sizes[self.parents[e]] += self.sizes[e]
            self.linked[self.parents[e]] += self.linked[e]
        largest = lambda some: max(some, key=lambda e: (self.sizes[e], -e), default=0)
        candidates = [e for e in range(1, n) if self.main[e] and self.sizes[e]]
        whole = largest(e for e in candidates if self.tags[e] != "article")
        own = largest(e for e in candidates if self.tags[e] == "article")
        self.region = own if own and (not whole or self._above(own, whole) and 2 * self.sizes[own] >= self.sizes[whole]) else whole
        self.inside = [self.region == 0] * n
        for e in range(1, n):
            self.inside[e] = self.inside[e] or e == self.region or self.inside[self.parents[e]]
        self.around = {self.region}
        e = self.region
        while e > 0:
            e = self.parents[e]
            self.around.add(e)

    def _above(self, e: int, ancestor: int) -> bool:
        while e > ancestor:
            e = self.parents[e]
        return e == ancestor

    def may_repeat(self, e: int) -> bool:
        """Whether the element can be a part of the site's template."""
        if not self.digests[e] or e in self.around or self.tags[e] in ("html", "body"):
            return False
        return not self.region or not self.inside[e] or self.named[e] or 2 * self.linked[e] >= self.sizes[e]

    def subtrees(self) -> list[int]:
        return [e for e in range(1, len(self.tags)) if self.may_repeat(e)]

    def context(self) -> int:
        """Stands for the page when it is counted: equal articles count once."""
        return xxhash.xxh64_intdigest("\n".join(raw for e, _, raw in self.pieces if self.inside[e]).encode("utf-8", "surrogatepass"))

    def not_article(self, e: int) -> bool:
        """By tag, role, class or id."""
        if e in self.around:
            return False
        if self.tags[e] == "header":
            return not self.region or not self.inside[e]
        if not self.unwanted[e]:
            return False
        # A form or a class over most of a page without an article says nothing about its parts.
        return bool(self.region) or self.tags[e] in NOT_TAGS and self.tags[e] != "form" or 2 * self.sizes[e] <= self.sizes[0]

    def article(self, template: set[int]) -> tuple[str, int, int]:
        """(text, subtrees deleted as template, elements deleted as no article); ``template`` holds elements."""
        gone, counts = [False] * len(self.tags), [0, 0]
        for e in range(1, len(self.tags)):
            if gone[self.parents[e]]:
                gone[e] = True
            elif e in template:
                gone[e] = True
                counts[0] += 1
            elif self.not_article(e):
                gone[e] = True
                counts[1] += self.sizes[e] > 0
        blocks: dict[int, list[str]] = {}
        for e, block, raw in self.pieces:
            if self.inside[e] and not gone[e]:
                blocks.setdefault(block, []).append(html.unescape(raw))
        texts = (" ".join("".join(pieces).split()) for pieces in blocks.values())
        return "\n\n".join(t for t in texts if t), *counts


def keys_of(page: Page, site: bytes) -> dict[int, int]:
    """Of each element that may repeat the key of its subtree on this site, as a signed long."""
    return {e: _signed(xxhash.xxh64_intdigest(site + page.digests[e].to_bytes(8, "big"))) for e in page.subtrees()}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _host(url: str = "url") -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def site_templates(pages: DataFrame, many: int = MANY, share: float = SHARE) -> DataFrame:
    """(key) of the subtrees that are on ``many`` different pages of their host and on ``share`` of them; stored.

    A key is the hash of host and subtree. ``pages`` needs url and html; null ones count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: set[tuple[int, int, int]] = set()
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = Page(text.as_py())
                own, context = host.encode("utf-8", "surrogatepass"), _signed(page.context())
                site = _signed(xxhash.xxh64_intdigest(own))
                rows.add((site, site, context))
                rows.update((site, k, context) for k in keys_of(page, own).values())
            columns = np.array(sorted(rows), np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(columns[:, i]) for i in range(3)], names=["site", "key", "context"])

    rows = pages.select(_host().alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "site long, key long, context long")
    counts = stored(rows.distinct().groupBy("site", "key").agg(F.count("*").alias("n")), "subtrees")
    sites = counts.where("site = key").select("site", F.col("n").alias("pages"))
    frequent = join_small(counts.where((F.col("n") >= many) & (F.col("site") != F.col("key"))), sites, "site", "inner")
    return stored(frequent.where(F.col("n") >= share * F.col("pages")).select("key").distinct(), "templates")


EXTRACTED = "text string, n_templates long, n_other long"


def _extracted(rows: DataFrame, found: Column | None, keys: np.ndarray | None) -> DataFrame:
    """page_id, url, text, n_templates, n_other of rows (page_id, url, host, html, keys: of this page's template subtrees).

    ``keys``: all of them, sorted, where tasks hold them."""
    held = rows.sparkSession.sparkContext.broadcast(keys) if keys is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = held.value if held is not None else None
        for batch in batches:
            made = []
            for k in range(len(batch)):
                page = Page(batch.column(3)[k].as_py())
                own = keys_of(page, batch.column(2)[k].as_py().encode("utf-8", "surrogatepass"))
                if everywhere is None:
                    known = set(batch.column(4)[k].as_py() or ())
                    template = {e for e, x in own.items() if x in known}
                else:
                    asked = np.fromiter(own.values(), np.int64, len(own))
                    at = np.searchsorted(everywhere, asked)
                    hit = everywhere[np.minimum(at, len(everywhere) - 1)] == asked if len(everywhere) else np.zeros(len(own), bool)
                    template = {e for e, x in zip(own, hit.tolist()) if x}
                made.append(page.article(template))
            columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["page_id", "url", "text", "n_templates", "n_other"])

    rows = rows.withColumn("keys", found if found is not None else F.lit(None).cast("array<long>"))
    kinds = ", ".join(f"{c} {t}" for c, t in rows.select("page_id", "url").dtypes)
    return rows.mapInArrow(run, f"{kinds}, {EXTRACTED}")


def _own_keys(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """(page: digest of host and html, keys: of its template subtrees) for templates of any number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, host, text in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                own = sorted(set(keys_of(Page(text.as_py()), host.encode("utf-8", "surrogatepass")).values()))
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(own), pa.string()), pa.array(own, pa.int64())], names=["page", "key"])

    asked = rows.select("page", "host", "html").mapInArrow(run, "page string, key long").distinct()
    return stored(join_small(asked, templates, "key", "left_semi", salts=8).groupBy("page").agg(F.collect_list("key").alias("keys")), "page-templates")


def main_texts(pages: DataFrame, many: int = MANY, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars (code points of the text), n_templates (subtrees deleted as the site's template),
    n_other (elements deleted by tag, role, class or id).

    Blocks of the text are separated by an empty line, their white space (also of line breaks) is one space, character
    references are decoded. A null or empty html has an empty text, a null url is a host of its own name; repeated
    rows give repeated rows; an empty table gives no rows; other columns, whatever they are called, are left out. Pages of
    any length, broken markup and unfinished tags are read to their end."""
    templates = site_templates(pages, many, share)
    rows = pages.select("page_id", "url", _host().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    if templates.count() <= HELD_KEYS:
        made = _extracted(rows, None, np.sort(templates.toArrow()["key"].to_numpy()))
    else:
        rows = rows.withColumn("page", F.md5(F.concat_ws("\0", "host", "html").cast("binary")))
        made = _extracted(join_small(rows, _own_keys(rows, templates), "page").select("page_id", "url", "host", "html", "keys"), F.col("keys"), None)
    return made.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_templates", "n_other")
