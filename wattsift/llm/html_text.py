"""Main text of web pages by differencing with the page of the nearest URL.

A page is cut into lines: the text of one block, with character references decoded and white
space made one space. Every page is differenced, whatever its markup. Pages of a host with equal lines are one page; pages
are ordered by the path of their URLs, one is paired with the neighbour of another path (of other lines, in a host of
one path) that shares the longer beginning of the path with it (the one before in a tie), and their lines are
aligned by longest common subsequence. Lines that both have are template, the others are text. A page alone in its host has only lines
of its own.

A check by markup follows, as two articles may share a short sentence, and menus change from page to page. Lines of menus, headers of the
page, footers, sidebars, forms and blocks with a class, id or role that is the name of an advert, a menu or
comments are taken out, though only this page has them; lines of an article or main element, besides those, come back, though
the neighbour has them, whatever wraps that element. Names that only hold such a word, or that sections of a text have as well, settle nothing:
of their lines inside an article, and of a page without such an element, differencing has the last word. Lines
outside of an article never count where the page has one. Scripts and styles are no lines.

Only the hashes of lines travel between pages, and one bit for each line to the page's text. Order is made by
a range partitioning of (host, path, id), so a host with a third of all pages is many partitions.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattsift.sources.staging import stage

OPEN, TEXT, DOUBT = 0, 1, 2
_WRAPPED, _WRAPPED_TALK = 3, 4
# Ruled out by markup.
OUT = 5
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*)(?:>|\Z)", re.S)
# Elements whose content is no markup.
_RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp", "noembed", "noframes")
_RAW_END = {name: re.compile(rf"</{name}\s*[^>]*(?:>|\Z)", re.I) for name in _RAW}
_DROPPED = frozenset((
    "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "object", "canvas", "audio", "video"))
_INLINE = frozenset((
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
    "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
    "var", "wbr", "ruby", "rb", "rt", "rp"))
_VOID = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_MAIN = frozenset(("article", "main"))
# A new one of these ends an open one of the same kind.
_CLOSED_BY = {
    "p": frozenset(("p",)), "li": frozenset(("li",)), "option": frozenset(("option",)), "tr": frozenset(("tr", "td", "th")),
    "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd"))}
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_UNWANTED = frozenset((
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "comment",
    "comments", "disqus", "discussion", "replies", "sidebar", "aside", "nav", "navbar", "navigation", "menu", "breadcrumb",
    "breadcrumbs", "footer", "header", "masthead", "cookie", "cookies", "consent", "notice", "popup", "modal", "newsletter",
    "subscribe", "signup", "share", "social", "related", "pagination", "pager", "widget", "complementary", "contentinfo",
    "search", "toolbar", "copyright", "disclaimer"))
# Names that sections of a text have as well.
_DOUBTFUL = frozenset((
    "banner", "notice", "discussion", "related", "share", "social", "search", "widget", "toolbar", "copyright", "disclaimer"))
_TALK = frozenset(("comment", "comments", "disqus", "replies"))
_SPACE = re.compile(r"\s+")


def _names(attributes: str, inside: int) -> tuple[bool, bool, bool]:
    """Whether an element is called unwanted, by names of readers' comments only, or perhaps unwanted."""
    whole: set[str] = set()
    parts: set[str] = set()
    for m in _NAMES.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        whole.update(value.split())
        parts.update(_WORDS.findall(value))
    # Inside of an article, what is called its header holds its title.
    none = {"header"} if inside else set()
    found = (whole & _UNWANTED) - _DOUBTFUL - none
    return bool(found), bool(found) and found <= _TALK, bool((parts & _UNWANTED) - none)


def lines_of(page: str) -> list[tuple[str, int]]:
    """Lines of a page in order, each open, ruled out, settled as text, or in doubt: inside an article, but perhaps not of it."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    opened: dict[str, int] = {}  # how often an element is on the stack
    stack: list[tuple[str, int, int, int]] = []  # element; in an unwanted one, in a main one, of what kind
    bad = main = 0  # bad: 1 by its element, 2 by its name, 3 by a name of comments
    kind = OPEN
    at, n = 0, len(page)

    def flush() -> None:
        if held:
            line = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            if line:
                out.append((line, OUT if bad else kind))
            held.clear()

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            held.append(page[at:lt])
            at = lt
            continue
        m = _TOKEN.match(page, at)
        if not m:
            held.append("<")
            at += 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in _RAW:
            if not m[1]:
                flush()
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else n
            continue
        if name in _INLINE:
            if name == "br":
                held.append(" ")
            continue
        flush()
        if name in _VOID:
            continue
        if m[1]:
            # Nothing is looked for that is not open; what is found leaves the stack.
            while opened.get(name):
                closed, bad, main, kind = stack.pop()
                opened[closed] -= 1
                if closed == name:
                    break
            continue
        closed = _CLOSED_BY.get(name, frozenset(("p",)))
        if stack and stack[-1][0] in closed:
            last, bad, main, kind = stack.pop()
            opened[last] -= 1
        stack.append((name, bad, main, kind))
        opened[name] = opened.get(name, 0) + 1
        if name in _MAIN:
            # An unwanted name around an article is that of a wrapper; settled when the whole page is known.
            if bad >= 2 and not main:
                bad, kind = 0, _WRAPPED if bad == 2 else _WRAPPED_TALK
            elif not main:
                kind = TEXT
            main = 1
            continue
        # The header of an article is part of it; that of the page is not.
        if name in _DROPPED and not (name == "header" and main):
            bad = 1
        elif name not in ("html", "body") and not bad:
            unwanted, talk, perhaps = _names(m[3], main)
            if unwanted:
                bad = 3 if talk else 2
            elif perhaps and kind == TEXT:
                kind = DOUBT
    flush()
    return _unwrapped(out)


def _unwrapped(found: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """An article in a wrapper of unwanted name is text where the page has no other, else in doubt or a comment."""
    kinds = {k for _, k in found}
    other = bool(kinds & {TEXT, DOUBT})
    meant = {_WRAPPED: DOUBT if other else TEXT, _WRAPPED_TALK: OPEN if other or _WRAPPED in kinds else TEXT}
    return [(x, meant.get(k, k)) for x, k in found]


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which lines of `a` are in a longest common subsequence of both."""
    n, m = len(a), len(b)
    shared = np.zeros(n, bool)
    lo = 0
    while lo < min(n, m) and a[lo] == b[lo]:
        shared[lo] = True
        lo += 1
    hi = 0
    while hi < min(n, m) - lo and a[n - 1 - hi] == b[m - 1 - hi]:
        shared[n - 1 - hi] = True
        hi += 1
    # Lines that the other page has not cannot be in it.
    own = np.flatnonzero(np.isin(a[lo : n - hi], b[lo : m - hi])) + lo
    other = b[lo : m - hi][np.isin(b[lo : m - hi], a[own])]
    shared[own[_common_places(a[own], other)]] = True
    return shared


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of a with every beginning of b."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def _common_places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in `a` of a longest common subsequence, in memory linear in both (divide and conquer)."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64)
    if len(a) == 1:
        return np.zeros(int((b == a[0]).any()), np.int64)
    half = len(a) // 2
    split = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
    return np.concatenate([_common_places(a[:half], b[:split]), half + _common_places(a[half:], b[split:])])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], list[list[tuple[str, int]]], pa.Array]]:
    """Some pages, which are the last column, at a time: the other columns, the lines, and their hashes."""
    from xxhash import xxh64_intdigest

    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            *others, html_of = batch.slice(at, 500).columns
            every = [lines_of(p.as_py()) for p in html_of]
            hashes = [np.array([xxh64_intdigest(x.encode()) for x, _ in f], np.uint64).view(np.int64) for f in every]
            yield others, every, pa.array(hashes, pa.list_(pa.int64()))


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for others, _, hashes in _cut(batches):
        yield pa.RecordBatch.from_arrays([*others, hashes], names=["row", "key", "host", "path", "hashes"])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that may be text, as they travel, and what markup says of each."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    for others, every, hashes in _cut(batches):
        kinds = [np.array([k for _, k in f], np.int8) for f in every]
        # Lines in a main element rule out those outside of it.
        kinds = [np.where(k == OPEN, OUT if np.isin(k, (TEXT, DOUBT)).any() else DOUBT, k) for k in kinds]
        # No line holds a line feed.
        lines = [pack.compress("\n".join("" if out else x for (x, _), out in zip(f, (k == OUT).tolist())).encode())
                 for f, k in zip(every, kinds)]
        yield pa.RecordBatch.from_arrays(
            [*others, pa.array(lines, pa.binary()), pa.array([k.astype(np.int8).tobytes() for k in kinds], pa.binary()), hashes],
            names=["page_id", "url", "host", "lines", "kinds", "hashes"])


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bit for each line of a page: the neighbour has it, too."""
    for batch in batches:
        pairs = zip(batch.column("hashes").to_pylist(), batch.column("other").to_pylist())
        bits = [np.packbits(common(np.array(a, np.int64), np.array(b or [], np.int64))).tobytes() for a, b in pairs]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("host", "content")), pa.array(bits, pa.binary())], names=["host", "content", "shared"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that the neighbour has not, but for those that markup rules out, and those of a text that it has, too."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        texts, counts = [], []
        for lines, kinds, bits in zip(*(batch.column(c).to_pylist() for c in ("lines", "kinds", "shared"))):
            shared = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(kinds)).tolist()
            found = zip(unpack.decompress(lines).decode().split("\n"), kinds, shared)
            texts.append("\n\n".join(x for x, k, s in found if (k != OUT if not s else k == TEXT)))
            counts.append((len(kinds), sum(shared)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             *(pa.array(c, pa.int64()) for c in (zip(*counts) if counts else ([], [])))],
            names=["page_id", "url", "text", "n_lines", "n_shared"])


def neighbours(pages: DataFrame) -> DataFrame:
    """row, other: the row of the nearest URL in the same host, by order of (host, path, row)."""
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "path", "row"]
    placed = stage(
        pages.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()),
        "url-order")
    me = F.struct("host", "path", "row")
    near = Window.partitionBy("part").orderBy(*order)
    # One row per part: what stands before and after it.
    across = Window.orderBy("part")
    ends = placed.groupBy("part").agg(F.min(me).alias("first"), F.max(me).alias("last")).select(
        "part", F.lag("last").over(across).alias("left"), F.lead("first").over(across).alias("right"))
    seen = placed.withColumn("before", F.lag(me).over(near)).withColumn("after", F.lead(me).over(near)).join(ends, "part")
    seen = seen.withColumn("before", F.coalesce("before", "left")).withColumn("after", F.coalesce("after", "right"))

    def alike(side: str):
        # Length of the common beginning: the first place where the paths differ.
        a, b = F.col("path"), F.col(f"{side}.path")
        same = F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))),
            F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
            lambda s, i: F.struct(
                F.when(s["on"] & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(s["n"]).alias("n"),
                (s["on"] & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))).alias("on")),
            lambda s: s["n"])
        return F.when(F.col(f"{side}.host") == F.col("host"), same).otherwise(-1)

    left, right = F.coalesce(alike("before"), F.lit(-1)), F.coalesce(alike("after"), F.lit(-1))
    return seen.select(
        "row", F.when((left >= 0) & (left >= right), F.col("before.row")).when(right >= 0, F.col("after.row")).alias("other"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row; n_lines, and how many of them its neighbour has, too (n_shared).

    A null or empty html has the empty text. Pages without a URL are of one host of no name.
    Repeated rows have a row each. Pages of a host with equal lines are one node and are differenced
    once; a node is compared with one of the nearest other path, or, where its host has
    only one path, with the nearest of other lines. Pages are read twice, so that only hashes are stored.
    """
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host")
    page, html = F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).alias("html")
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path")
    cut = stage(
        pages.select(F.monotonically_increasing_id().alias("row"), F.coalesce(page, F.lit(0)).alias("key"), host, path, html)
        .mapInArrow(_line_hashes, "row long, key long, host string, path string, hashes array<long>")
        .withColumn("content", F.xxhash64("hashes")), "page-lines")
    nodes = stage(cut.groupBy("host", "content").agg(F.min(F.struct("path", "row")).alias("first")).select(
        "host", "content", "first.path", "first.row"), "page-nodes")
    paths = nodes.groupBy("host", "path").agg(F.min("row").alias("row"))
    # The other path's page first, which no copy or version of the same page can be.
    across = neighbours(paths).join(paths, "row").select("host", "path", F.col("other").alias("far"))
    within = neighbours(nodes).select("row", F.col("other").alias("near"))
    placed = nodes.join(within, "row").join(across, ["host", "path"]).select(
        "row", "host", "content", F.coalesce("far", "near").alias("other"))
    theirs = cut.select(F.col("row").alias("other"), F.col("hashes").alias("there"))
    shared = placed.join(theirs, "other", "left").select("row", "host", "content", F.col("there").alias("other")).join(
        cut.select("row", "hashes"), "row").mapInArrow(_differ, "host string, content long, shared binary")
    # By page as well, or all copies of a page would meet in one task with their texts.
    each = cut.select("key", "host", "content").distinct().join(shared, ["host", "content"])
    texts = pages.select(page, "url", host, html).mapInArrow(
        _parse, "page_id long, url string, host string, lines binary, kinds binary, hashes array<long>").select(
        F.coalesce("page_id", F.lit(0)).alias("key"), "page_id", "url", "host", "lines", "kinds", F.xxhash64("hashes").alias("content"))
    return texts.join(each, ["host", "content", "key"]).select("page_id", "url", "lines", "kinds", "shared").mapInArrow(
        _settle, "page_id long, url string, text string, n_lines long, n_shared long").select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_shared")
