"""Main text of web pages: page structure, and differencing with the nearest URL.

Every page is read into lines (blocks of text) in page order, each in a zone: in
an article or main element, in an element that is never content (menus,
headers, footers, sidebars, adverts, notices, forms, comments), or in neither. Pages of a
host stand in order of their URL path; each is paired with the page before it
(the first one with the page after it). The lines of the two are aligned by their longest common
subsequence, and shared lines are template and are deleted: outside article and main all of them,
in main all that stand outside its article, and in an article those that are no
paragraph text and stand at the same place of both articles (share bars, notices).
What then remains of the never-content zones goes too, and on a page that
has an article or main element what stands outside it.

Paragraphs of an article are never deleted, as quoted passages are
shared by pages too; a page that shares nearly all of its main lines (``COPY``) is a copy,
tells nothing about the template, and keeps them.
Menus of random links differ between pages, so differencing alone cannot find
all that is not content; the structure rules are the exact check that follows it.

Only hashes of lines meet those of the neighbour; a hot host is one run of the
global order, spread over range partitions. Pages are parsed
twice: for the hashes and zones that neighbours get, which alone are staged, and
for the lines, which are shuffled once, compressed. Null pages have no text; null
URLs are a host of their own; equal rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlift.llm.base import ascii_lower, by_size, whole
from arborlift.session import stage

# Element names and the words of class, id and role that tell what is not content.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video select option button textarea title head".split())
NEVER = frozenset("nav header footer aside form dialog menu".split())
BLOCKS = frozenset(
    "p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption section article main blockquote pre "
    "figure figcaption address details summary fieldset hr body html center nav header footer aside form dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "header footer masthead comment comments commentlist disqus replies respond related recommended share sharing social widget "
    "complementary contentinfo search dialog pagination pager skip".split())
#: Marks of what may hold articles that are not the page's own, and of the head of an article.
TEASERS = frozenset(
    "comment comments commentlist disqus replies respond related recommended ad ads adv advert adverts advertisement advertising adsense "
    "sponsor sponsored promo promotion".split())
HEADS = frozenset("header masthead".split())
KEEPS_PLACE = frozenset({"html", "body", "article", "main"})
OF_HEAD = frozenset("title meta link style script noscript template base".split())
#: Paragraphs of an article, text in neither, never content, other lines of an article, and lines of main outside its article.
MAIN, OPEN, NOT_CONTENT, LOOSE, AROUND = 0, 1, 2, 3, 4
WRAPPED = 10  # added to a zone inside an article that a marked wrapper holds
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption".split())
COPY = 0.8
SPACE = re.compile(r"\s+")
UNFINISHED = re.compile(r"<[A-Za-z/!?][^<>]*\Z")


class _Lines(HTMLParser):
    """Blocks of text with their zones."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: Name, and what it starts: "", "silent", "never", "marked" or "teasers" (never by class or id alone), "article-header",
        #: "main", or "wrapped" (an article inside "marked").
        self.open: list[tuple[str, str]] = []
        self.buffer: list[str] = []
        self.lines: list[tuple[int, str]] = []
        self.whole_main: list[int] = []  # zones of the lines if main is the article
        self.has_main = self.has_article = False

    def _zone(self) -> int:
        for name, kind in reversed(self.open):
            if kind in ("never", "marked", "teasers"):
                return NOT_CONTENT
            if kind == "wrapped":
                return WRAPPED + self._paragraph()
            if kind == "main":
                return self._paragraph() if ("article", "main") in self.open else AROUND
        return OPEN

    def _paragraph(self) -> int:
        return MAIN if any(n in PARAGRAPHS for n, _ in self.open) else LOOSE

    def settled(self) -> list[tuple[int, str]]:
        """Lines with zones; where main has no article, it is the article."""
        framed = False
        if not self.has_main and any(z >= WRAPPED for z, _ in self.lines):
            size = [sum(len(text) for z, text in self.lines if z == OPEN), sum(len(text) for z, text in self.lines if z >= WRAPPED)]
            framed = size[1] >= size[0]  # else teasers beside the text
            self.has_main = self.has_article = framed
        self.lines = [(z if z < WRAPPED else z - WRAPPED if framed else NOT_CONTENT, text) for z, text in self.lines]
        inside = [self.whole_main[k] if z == AROUND and not self.has_article else z for k, (z, _) in enumerate(self.lines)]
        return [(z, text) for z, (_, text) in zip(inside, self.lines, strict=True)]

    def _flush(self) -> None:
        if self.buffer:
            text = SPACE.sub(" ", "".join(self.buffer)).strip()
            self.buffer = []
            if text:
                self.lines.append((self._zone(), text))
                self.whole_main.append(self._paragraph())

    def _kind(self, tag: str, attrs) -> str:
        if tag in SILENT:
            return "silent"
        inside = any(k in ("main", "wrapped") for _, k in self.open)
        if tag in NEVER:
            return "article-header" if tag == "header" and inside else "never"
        kind = ""
        if tag not in KEEPS_PLACE:
            for name, value in attrs:
                if name in ("class", "id", "role") and value and (found := MARKS.intersection(re.split(r"[^a-z]+", value.lower()))):
                    if inside and found <= HEADS:
                        kind = kind or "article-header"
                    elif name == "role":
                        return "never"
                    else:
                        kind = "teasers" if found & TEASERS or kind == "teasers" else "marked"
                if name == "hidden" or (name == "aria-hidden" and value == "true"):
                    return "never"
        elif tag in ("article", "main"):
            return "main"
        return kind

    def handle_starttag(self, tag: str, attrs) -> None:
        self._close_head(tag)
        if tag == "br":
            self.buffer.append(" ")
            return
        if tag in BLOCKS:
            self._flush()
            self._close_implied(tag)
        if tag in VOID:
            return
        kind = self._kind(tag, attrs)
        if kind == "main":
            # an article does not stand inside a menu or header that someone forgot to close
            while any(n in NEVER for n, k in self.open if k == "never") and not any(
                    k in ("marked", "teasers") or k == "never" and n not in NEVER for n, k in self.open):
                self.open.pop()
            kind = self._accepted(tag)
            if kind == "main":
                self.has_main = True
                self.has_article |= tag == "article"
        self.open.append((tag, kind))

    def _accepted(self, tag: str) -> str:
        """What an article or main starts here: a wrapper that is marked by class or id alone may be the page's frame."""
        marked = False
        for _, kind in reversed(self.open):
            if kind in ("main", "wrapped"):
                return "" if marked else kind
            if kind == "never" or (kind == "teasers" and tag == "article"):
                return ""
            marked |= kind in ("marked", "teasers")
        return "wrapped" if marked and tag == "article" else "main"

    def _close_implied(self, tag: str) -> None:
        """A new block ends an open paragraph with what is open in it; a list item ends the one before."""
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name == "p" or (name == tag and tag in ("li", "dt", "dd", "tr", "td", "th")):
                del self.open[k:]
                return
            if name in BLOCKS:
                return

    def _close_head(self, tag: str) -> None:
        """The body, and all that may not stand in a head, end a head that was left open."""
        at = next((k for k, (n, _) in enumerate(self.open) if n == "head"), None)
        if at is not None and (tag == "body" or (at == len(self.open) - 1 and tag not in OF_HEAD)):
            del self.open[at:]

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in VOID or tag == "br":
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return
            if self.open[k][0] in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                return  # a stray end tag does not close the article

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._close_head("")
        kinds = [k for _, k in self.open]
        if "silent" in kinds:
            return
        if "article-header" in kinds and not any(n in HEADINGS for n, _ in self.open):
            return  # of an article's own header only the heading is text
        self.buffer.append(data)


def page_lines(html: str) -> tuple[bool, list[tuple[int, str]]]:
    """Whether the page has an article or main element, and its lines with zones."""
    parser = _Lines()
    cut = UNFINISHED.search(html[-4096:]) if len(html) > 4096 else UNFINISHED.search(html)
    parser.feed(html[:len(html) - (len(cut.group()) if cut else 0)])
    parser.close()
    parser._flush()
    return parser.has_main, parser.settled()


def common_lines(a: list[int], b: list[int], at_most: int = 1 << 29) -> list[int]:
    """Places in ``a`` of one longest common subsequence, by bit vectors.

    One bit per pair of lines is kept for the way back; beyond ``at_most`` bits
    ``a`` is halved and ``b`` split where the halves together are longest.
    """
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    head, tail = list(range(first)), list(range(len(a) - last, len(a)))
    x, y = a[first:len(a) - last], b[first:len(b) - last]
    if not x or not y:
        return head + tail
    if len(x) * len(y) > at_most and len(x) > 1:
        half = len(x) // 2
        left = _lengths(x[:half], y)
        right = _lengths(x[half:][::-1], y[::-1])[::-1]
        cut = max(range(len(y) + 1), key=lambda k: left[k] + right[k])
        inner = common_lines(x[:half], y[:cut], at_most) + [half + k for k in common_lines(x[half:], y[cut:], at_most)]
    else:
        steps = _vectors(x, y)
        inner, i, j = [], len(x), len(y)
        while i and j:
            if steps[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if not i or steps[i - 1] >> (j - 1) & 1:
                    inner.append(i)
                    j -= 1
        inner.reverse()
    return head + [first + k for k in inner] + tail


def _vectors(x: list[int], y: list[int]) -> list[int]:
    """For each prefix of ``x``: bits at the places of ``y`` that do not lengthen the subsequence."""
    where: dict[int, int] = {}
    for k, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << k
    every = (1 << len(y)) - 1
    now, out = every, []
    for v in x:
        match = where.get(v, 0)
        hit = now & match
        now = ((now + hit) | (now - hit)) & every
        out.append(now)
    return out


def _lengths(x: list[int], y: list[int]) -> list[int]:
    last = _vectors(x, y)[-1]
    out = [0]
    for k in range(len(y)):
        out.append(out[-1] + (1 - (last >> k & 1)))
    return out


def kept_lines(
    has_main: bool, zones: list[int], lines: list[int], other: list[int] | None, other_zones: list[int] | None = None,
) -> list[int]:
    """Places of the lines that are main text, given the neighbour's lines and their zones."""
    gone: set[int] = set()
    if other is not None:
        shared = set(common_lines(lines, other))
        gone = {k for k in shared if zones[k] in (OPEN, NOT_CONTENT)}  # template
        open_ = [k for k, z in enumerate(zones) if z == OPEN]
        if not has_main and open_ and sum(k in gone for k in open_) >= COPY * len(open_):
            gone -= set(open_)  # a copy tells nothing about the template
        body = next((b for z in (MAIN, LOOSE, AROUND) if (b := [k for k, at in enumerate(zones) if at == z])), [])
        if sum(k in shared for k in body) < COPY * len(body):
            place = _same_place(zones, lines, other, other_zones or [])
            gone |= {k for k in shared if zones[k] == AROUND or zones[k] == LOOSE and k in place}
    return [k for k, z in enumerate(zones) if k not in gone and (z in (MAIN, LOOSE, AROUND) or (z == OPEN and not has_main))]


def _same_place(zones: list[int], lines: list[int], other: list[int], other_zones: list[int]) -> set[int]:
    """Lines of the article that the other article has too, as far from its beginning or its end."""
    one = [k for k, z in enumerate(zones) if z in (MAIN, LOOSE)]
    two = [other[k] for k, z in enumerate(other_zones) if z in (MAIN, LOOSE)]
    begin = {k for k, v in zip(one, two) if lines[k] == v}
    return begin | {k for k, v in zip(reversed(one), reversed(two)) if lines[k] == v}


OUTLINE = "row_key long, zones array<int>, lines array<string>"
PARSED = "row_key long, page_id long, gone boolean, url string, has_main boolean, zones array<int>, lines array<string>, packed binary"


def _outline(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in by_size(frames, "html", 4_000_000):
        read = [page_lines(h)[1] for h in frame["html"]]
        out = frame[["row_key"]].reset_index(drop=True)
        out["zones"] = [[z for z, _ in r] for r in read]
        out["lines"] = [[t for _, t in r] for r in read]
        yield out


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines twice: for their hashes, and packed; no line has a line end within."""
    for frame in by_size(frames, "html", 4_000_000):
        read = [page_lines(h) for h in frame["html"]]
        out = frame[["row_key", "page_id", "gone", "url"]].reset_index(drop=True)
        out["has_main"] = [r[0] for r in read]
        out["zones"] = [[z for z, _ in r[1]] for r in read]
        out["lines"] = [[t for _, t in r[1]] for r in read]
        out["packed"] = [zlib.compress("\n".join(lines).encode(), 1) for lines in out["lines"]]
        yield out


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = []
        for row in frame.itertuples(index=False):
            other = None if row.other is None else row.other.tolist()
            other_zones = None if row.other_zones is None else row.other_zones.tolist()
            kept = kept_lines(row.has_main, row.zones.tolist(), row.codes.tolist(), other, other_zones)
            lines = zlib.decompress(row.packed).decode().split("\n")
            texts.append("\n\n".join(lines[k] for k in kept))
        out = frame[["page_id", "gone", "url"]].reset_index(drop=True)
        out["text"], out["n_chars"] = texts, [len(t) for t in texts]
        yield out


def neighbours(keyed: DataFrame) -> DataFrame:
    """(row_key, partner) for the pages of each host in order of path; no partner on a host of one page."""
    order = ["host", "path", "row_key"]
    placed = keyed.select(*order).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(placed.withColumn("part", F.spark_partition_id()), "url-order")
    w = Window.partitionBy("part").orderBy(*order)
    page = F.struct("host", "row_key")
    ends = placed.groupBy("part").agg(F.min(F.struct(*order)).alias("low"), F.max(F.struct(*order)).alias("high"))
    across = Window.orderBy("part")  # one row per range partition
    ends = ends.select(
        "part", F.lag(F.struct("high.host", "high.row_key")).over(across).alias("before_part"),
        F.lead(F.struct("low.host", "low.row_key")).over(across).alias("after_part"))
    near = placed.withColumns({"before": F.lag(page).over(w), "after": F.lead(page).over(w)}).join(ends, "part")
    before, after = F.coalesce("before", "before_part"), F.coalesce("after", "after_part")
    partner = F.when(before["host"] == F.col("host"), before["row_key"]).when(after["host"] == F.col("host"), after["row_key"])
    return near.select("row_key", partner.alias("partner"))


def extract(pages: DataFrame, *, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    address = whole(url)
    rest = F.when(address.contains("://"), F.element_at(F.split(address, "://", 2), 2)).otherwise(F.lit(""))
    keyed = pages.select(
        F.coalesce(F.col(page).cast("bigint"), F.lit(0)).alias("page_id"), F.col(page).isNull().alias("gone"),
        F.col(url).alias("url"), whole(html).alias("html"), F.xxhash64(page, url, html).alias("row_key"),
        ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)).alias("host"), F.regexp_extract(rest, "^[^/?#]*(.*)$", 1).alias("path"))
    codes = F.transform("lines", lambda x: F.xxhash64(x))
    outlines = keyed.select("row_key", "html").mapInPandas(_outline, OUTLINE).select(
        F.col("row_key").alias("partner"), codes.alias("other"), F.col("zones").alias("other_zones"))
    others = stage(outlines, "page-lines").dropDuplicates(["partner"])
    near = neighbours(keyed).where(F.col("partner").isNotNull()).join(others, "partner").select("row_key", "other", "other_zones")
    parsed = keyed.select("row_key", "page_id", "gone", "url", "html").mapInPandas(_parse, PARSED)
    whole_rows = parsed.withColumn("codes", codes).drop("lines").join(near, "row_key", "left")
    out = whole_rows.mapInPandas(_cut, "page_id long, gone boolean, url string, text string, n_chars long")
    return out.select(F.when(~F.col("gone"), F.col("page_id")).alias("page_id"), "url", "text", "n_chars")
