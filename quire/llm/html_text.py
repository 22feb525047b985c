"""Main text of web pages by nearest-URL page differencing (operator 7).

Pages are range-partitioned and sorted by host and path, so the page with the
nearest URL of the same host is a neighbour: of the two, the one that shares
the longer start of the path.  Both pages become text lines.  A line's
identity is its text, or for a line inside a menu, notice, advert or the like
its place in the markup, since templates repeat the place and not always the
words.  The longest common subsequence of the two lists is what the template
gave both pages, and these lines are deleted.  Copies tell nothing of the
template: pages in a row of which each has the lines of the one before, or all
but a few (``COPY``), are one run, and the neighbour is the nearest page of the
host outside the run.  Where there is none, or where the subsequence would
leave nothing, markup alone decides.

Differencing alone cannot be right for pages whose article is copied on the
same host, or that are alone there, so markup has the last word on both sides:
lines of an ``article`` or ``main`` element are kept even if a neighbour has
them, and lines inside containers of boilerplate go even if no neighbour has
them.  Where a page has an ``article`` or ``main``, nothing else is kept.

A host with a third of the pages is many ranges.  Range limits come from a
sample of keys (a bounded number for each range); the last page before and the
first page after a range that are no copies of its ends are copied into it, so
pairing does not depend on the limits.  They are found on hashes of the lines,
of which the driver gets the two ends of each range.  A task holds a run of
copies (equal lists of lines once) and a page on both sides.

Defined cases: null or empty html gives an empty text; null urls are a host
of their own; equal rows are paired like any others; nothing is cut off.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.url_filter import with_url_parts

HIDDEN = {"script", "style", "noscript", "template", "title", "iframe", "object", "svg", "canvas", "audio", "video",
          "datalist", "math"}
CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "textarea", "label",
          "fieldset"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
          "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
          "wbr", "img", "input", "ruby", "rt", "rp"}
CHROME_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs",
                "comment", "comments", "consent", "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "gdpr",
                "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
                "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "respond",
                "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe",
                "tags", "toolbar", "widget"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu",
                "menubar", "alertdialog", "toolbar"}
#: A class like ``with-sidebar`` is on the element beside the sidebar.
ABOUT = {"with", "without", "has", "no", "not", "show", "hide", "is"}
TOKENS = re.compile(r"[a-z0-9]+")
#: Pages are copies if what they share is this percentage of the longer one's characters, boilerplate aside.
COPY = 95
#: A tag that the page breaks off in.
CUT_TAG = re.compile(r"<[/!a-zA-Z][^<>]*\Z")


class PageLines(HTMLParser):
    """Collects ``(text, kind, key)`` lines: kind is article, chrome or open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str, str]] = []  # tag, kind, place
        self.lines: list[tuple[str, str, str]] = []
        self.text: list[str] = []

    def state(self) -> tuple[str, str]:
        return self.stack[-1][1:] if self.stack else ("open", "")

    def flush(self) -> None:
        line = " ".join("".join(self.text).split())
        self.text = []
        if line:
            kind, place = self.state()
            if kind != "hidden":
                self.lines.append((line, kind, place if kind == "chrome" else line))

    def kind_of(self, tag: str, attrs: dict[str, str | None], kind: str) -> str:
        if kind == "hidden" or tag in HIDDEN:
            return "hidden"
        if tag in MAIN or attrs.get("role") == "main":
            return kind if kind == "chrome" and tag == "article" else "article"  # a comment may be an article too
        if kind == "chrome":
            return kind
        # A header inside an article holds its title.
        if tag in CHROME and not (tag == "header" and kind == "article"):
            return "chrome"
        if attrs.get("role") in CHROME_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
            return "chrome"
        if tag in ("html", "body"):
            return kind
        for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split():
            named = TOKENS.findall(name)
            if named and named[0] not in ABOUT and not CHROME_WORDS.isdisjoint(named):
                return "chrome"
        return kind

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        found = dict(attrs)
        kind, place = self.state()
        new = self.kind_of(tag, found, kind)
        if new != kind:
            self.flush()
        if new == "chrome":
            place = f"{place}/{tag}.{found.get('class') or ''}"
        self.stack.append((tag, new, place))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag not in INLINE or any(s[0] not in INLINE for s in self.stack[i:]) or self.stack[i][1] != (
                        self.stack[i - 1][1] if i else "open"):
                    self.flush()
                del self.stack[i:]
                return
            if self.stack[i][0] in MAIN and tag in INLINE | {"p", "li"}:
                return  # a stray end tag does not reach out of the article

    def handle_data(self, data):
        self.text.append(data)


def page_lines(html: str | None) -> list[tuple[str, str, str]]:
    parser = PageLines()
    parser.feed(CUT_TAG.sub("", html or ""))
    parser.close()
    parser.flush()
    return parser.lines


def _lengths(a: list[int], b: np.ndarray) -> np.ndarray:
    """Lengths of the common subsequences of all ``a`` with each start of ``b``."""
    row = np.zeros(len(b) + 1, dtype="int32")
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Indices in ``a`` of a longest common subsequence with ``b``, in space linear in their lengths."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    inner, other = a[head:len(a) - tail], b[head:len(b) - tail]
    found = list(range(head))
    if len(inner) == 1:
        found += [head] if inner[0] in other else []
    elif inner and other:
        half, arr = len(inner) // 2, np.array(other, dtype="int64")
        cut = int((_lengths(inner[:half], arr) + _lengths(inner[half:][::-1], arr[::-1])[::-1]).argmax())
        found += [head + i for i in common_lines(inner[:half], other[:cut])]
        found += [head + half + i for i in common_lines(inner[half:], other[cut:])]
    return found + list(range(len(a) - tail, len(a)))


def main_text(lines: list[tuple[str, str, str]], neighbour: list[tuple[str, str, str]] | None) -> str:
    """The lines that remain after differencing with ``neighbour``'s."""
    shared: set[int] = set()
    if neighbour is not None:
        numbers: dict[str, int] = {}
        # Lines that markup settles as the article take no part.
        open_ = [i for i, x in enumerate(lines) if x[1] != "article"]
        mine = [numbers.setdefault(lines[i][2], len(numbers)) for i in open_]
        theirs = [numbers.setdefault(x[2], len(numbers)) for x in neighbour if x[1] != "article"]
        shared = {open_[i] for i in common_lines(mine, theirs)}
    marked = [x for x in lines if x[1] != "chrome"]
    left = [x for i, x in enumerate(lines) if i not in shared and x[1] != "chrome"] or marked
    if any(x[1] == "article" for x in left):
        left = [x for x in left if x[1] == "article"]
    return "\n".join(x[0] for x in left)


def outline(lines: list[tuple[str, str, str]]) -> tuple[list[int], list[int]] | None:
    """Hashes and lengths of the lines outside boilerplate; none for a page with an article, which needs no neighbour."""
    if any(x[1] == "article" for x in lines):
        return None
    own = [x for x in lines if x[1] != "chrome"]
    return [xxhash.xxh3_64_intdigest(x[2].encode("utf-8", "replace")) - (1 << 63) for x in own], [len(x[0]) for x in own]


def copies(a: tuple[list[int], list[int]] | None, b: tuple[list[int], list[int]] | None) -> bool:
    """Whether two outlines are equal or nearly so."""
    if a is None or b is None or a == b:
        return a is not None and b is not None
    least, most = sorted((sum(a[1]), sum(b[1])))
    if 100 * least < COPY * most:
        return False
    numbers: dict[int, int] = {}
    mine, theirs = ([numbers.setdefault(k, len(numbers)) for k in x[0]] for x in (a, b))
    return 100 * sum(a[1][i] for i in common_lines(mine, theirs)) >= COPY * most


def runs(pages: Iterable, joins) -> Iterator[list]:
    """``pages`` in runs, of which each page ``joins`` the one before."""
    run: list = []
    for page in pages:
        if run and not joins(run[-1], page):
            yield run
            run = []
        run.append(page)
    if run:
        yield run


def range_ends(dealt: DataFrame, parts: int) -> list[dict]:
    """For each range in order its ``first`` and ``last`` page as (host, path, page_id, outline), and the key of the page
    ``after`` its first and ``before`` its last run, if there is one."""
    page = "host string, path string, page_id long, keys array<long>, sizes array<int>"

    def outlines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *key, html = (batch.column(c).to_pylist() for c in ("part", "host", "path", "page_id", "html"))
            found = [outline(page_lines(h)) or (None, None) for h in html]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                [*key, [x[0] for x in found], [x[1] for x in found]], (pa.int32(), pa.string(), pa.string(), pa.int64(), *lists))],
                names=["part", "host", "path", "page_id", "keys", "sizes"])

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("part", "host", "path", "page_id", "keys", "sizes"))))
        for part, pages in groupby(rows, lambda r: r[0]):
            first = last = after = before = None
            for p in ((*r[1:4], None if r[4] is None else (r[4], r[5])) for r in pages):
                if first is None:
                    first = p
                elif not same_run(last, p):
                    after, before = after or p, last
                last = p
            yield pa.RecordBatch.from_pylist([{"part": part} | {name: p and dict(
                host=p[0], path=p[1], page_id=p[2], keys=p[3] and p[3][0], sizes=p[3] and p[3][1])
                for name, p in (("first", first), ("last", last), ("after", after), ("before", before))}], schema)

    lists = (pa.list_(pa.int64()), pa.list_(pa.int32()))
    fields = pa.struct(list(zip(("host", "path", "page_id", "keys", "sizes"), (pa.string(), pa.string(), pa.int64(), *lists))))
    schema = pa.schema([("part", pa.int32()), *((n, fields) for n in ("first", "last", "after", "before"))])
    key = ["part", "host", "path", "page_id"]
    found = (dealt.select(*key, "html").mapInArrow(outlines, f"part int, {page}").repartition(parts, "part").sortWithinPartitions(*key)
             .mapInArrow(ends, "part int, " + ", ".join(f"{n} struct<{page.replace(' ', ':').replace(',:', ', ')}>" for n in ("first", "last", "after", "before"))))
    plain = lambda p: p and (p["host"], p["path"], p["page_id"], None if p["keys"] is None else (list(p["keys"]), list(p["sizes"])))
    return sorted(({"part": r["part"]} | {n: plain(r[n]) for n in ("first", "last", "after", "before")} for r in found.collect()),
                  key=lambda r: r["part"])


def same_run(x: tuple, y: tuple) -> bool:
    """Whether two (host, path, page_id, outline) that follow each other are copies on one host."""
    return x[0] == y[0] and copies(x[3], y[3])


def edge_keys(ends: list[dict]) -> list[tuple]:
    """``(host, path, page_id, part)`` of the nearest page on both sides of each range that is in no run with its end."""
    joined = [same_run(x["last"], y["first"]) for x, y in zip(ends, ends[1:])]
    out = []
    for i, r in enumerate(ends):
        for j in range(i - 1, -1, -1):
            found = ends[j]["before"] if joined[j] else ends[j]["last"]
            if found:
                out.append((*found[:3], r["part"]))
                break
        for j in range(i + 1, len(ends)):
            found = ends[j]["after"] if joined[j - 1] else ends[j]["first"]
            if found:
                out.append((*found[:3], r["part"]))
                break
    return out


def limits(keys: DataFrame, parts: int, per_part: int = 50) -> list[tuple]:
    """``parts - 1`` keys that cut ``keys(host, path, page_id)`` evenly, from about ``per_part * parts`` sampled rows."""
    n = keys.count()
    if n == 0 or parts < 2:
        return []
    drawn = sorted(tuple(r) for r in keys.sample(min(1.0, per_part * parts / n), seed=1).collect())
    return [drawn[len(drawn) * i // parts] for i in range(1, parts)] if len(drawn) >= parts else drawn


def in_ranges(pages: DataFrame) -> DataFrame:
    """``pages`` sorted within ranges ``part``, with ``edge`` copies of the neighbouring pages of each range."""
    spark = pages.sparkSession
    key = ["host", "path", "page_id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = limits(pages.select(*key), parts)

    @F.pandas_udf("int")
    def part_of(host: pd.Series, path: pd.Series, page: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, k) for k in zip(host, path, page)], dtype="int32")

    dealt = pages.withColumn("part", part_of(*key))
    near = spark.createDataFrame(edge_keys(range_ends(dealt, parts)), "host string, path string, page_id long, part int")
    edges = pages.join(F.broadcast(near), key).dropDuplicates([*key, "part"])
    both = dealt.withColumn("edge", F.lit(False)).unionByName(edges.withColumn("edge", F.lit(True)))
    return both.repartitionByRange(parts, "part").sortWithinPartitions("part", *key, "edge")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            old = None
            for batch in batches:
                for *head, html in zip(*(batch.column(c).to_pylist() for c in columns)):
                    lines = page_lines(html)
                    if lines == old:
                        lines = old  # copies hold one list
                    yield (*head, lines, outline(lines))
                    old = lines

        def joins(x, y) -> bool:
            return not x[5] and not y[5] and same_run((x[3], None, None, x[7]), (y[3], None, None, y[7]))

        def nearness(x, y) -> int:
            same = x is not None and y is not None and x[2:4] == y[2:4]
            return len(os.path.commonprefix([x[4], y[4]])) if same else -1

        before, current, out = None, [], []
        for after in chain(runs(rows(), joins), [None]):
            for page in current:
                if page[5]:
                    continue
                b, a = nearness(before, page), nearness(page, after and after[0])
                partner = None if max(a, b) < 0 else before if b >= a else after[0]
                text = main_text(page[6], partner and partner[6])
                out.append((page[0], page[1], text, len(text)))
                if len(out) >= 500:
                    yield to_batch(out)
                    out = []
            before, current = current[-1] if current else None, after
        if out:
            yield to_batch(out)

    def to_batch(out) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                          names=["page_id", "url", "text", "n_chars"])

    columns = ("page_id", "url", "part", "host", "path", "edge", "html")
    types = (pa.int64(), pa.string(), pa.string(), pa.int64())
    # A null id cannot be compared; it becomes the least one and null again at the end.
    least = F.lit(-(1 << 63)).cast("long")
    parsed = with_url_parts(pages.select(F.coalesce(F.col("page_id").cast("long"), least).alias("page_id"), "url", "html"))
    texts = in_ranges(parsed).mapInArrow(run, "page_id long, url string, text string, n_chars long")
    return texts.withColumn("page_id", F.nullif("page_id", least))
