"""Main text of web pages: nearest-URL page differencing, with block zones for the cases it cannot decide.

Each page is parsed into text blocks ("lines"). Pages of one host with equal lines count as one, by the first of
their URLs. They are sorted by URL path, each is compared with the closer of its two neighbours by longest common
subsequence, and the lines it shares are deleted as the site's boilerplate; the copies take the result of the page
that stands for them. Where a host has no differing page nothing is shared.

``extract(pages, zones=False)`` is that and no more. It gives wrong results where an article's passage recurs on
the neighbouring page, and where a menu, footer or advert differs between neighbours. So by default the markup
corrects it in two cases: shared lines inside a declared article or main element are put back, and lines that no
other page has go if the markup declares them a menu, header, footer, sidebar, notice, advert, form or comment.
Differencing decides all other lines: those outside declared content that no name marks, on pages with and without an
article, and those inside an article in elements whose names merely hint (share, related, search, notice, ...).

Only line hashes meet in the pairs; the text moves once, compressed, to meet its page's decisions.
"""

from __future__ import annotations

import html as entities
import os
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.scratch import Scratch, partitions

PLAIN, CONTENT, CHROME, HINTED = 0, 1, 2, 3
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
# quotes count only behind "="; anywhere else they are plain characters
_REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in "script style noscript template textarea title iframe xmp noembed noframes svg annotation annotation-xml".split()}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {  # an opening tag -> what it closes, unless one of the second list stands inside
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_PARAGRAPH = (("p",), ("article", "main", "body", "div", "section"))
_CHROME_TAGS = frozenset("nav footer aside form dialog menu button select head fieldset search object audio video canvas datalist".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_ZONED = _CHROME_TAGS | {"article", "main", "header"}  # these matter without attributes
# fixed values: parts of class names and ids of menus, notices, adverts and reader comments, wherever they stand
_DECLARED = frozenset(
    """
    ad ads adv advert adverts advertisement advertising advertise adbox adsense adslot sponsor sponsored sponsors
    cookie cookies cookiebar consent gdpr notice notices notification alert alerts toast popup modal overlay paywall newsletter subscribe subscription signup login
    nav navbar navlist navigation topnav subnav sidenav sitenav menu menus menubar mainmenu submenu breadcrumb breadcrumbs pagination pager toolbar topbar skip
    sidebar sidebars comment comments commentlist disqus replies footer masthead searchbox hidden
    """.split()
)
# fixed values: parts that do so outside declared content only, and inside it hint at it
_HINTS = frozenset(
    """
    banner leaderboard promo promotion rail widget widgets related recommended recommendations trending
    share sharing social reply respond feedback copyright search
    """.split()
)
_HEADER_WORDS = frozenset("header head".split())
_ABOUT = frozenset("has with without no not is".split())  # as in "has-sidebar": about the page, not of the element
_CONTENT_IDS = re.compile(r"(?:article|post|entry|story|main|page)[-_]?(?:body|content|text)|content[-_]?(?:body|main)|articlebody", re.I)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def _name_words(names: str) -> set[str]:
    """The lower-case parts of class names and ids."""
    words: set[str] = set()
    for name in names.split():
        parts = re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
        if parts[0] not in _ABOUT:
            words.update(parts)
    return words


def _zone(tag: str, raw: str, zone: int) -> int:
    """The zone inside an element, given the one around it."""
    if zone == CHROME or tag in _CHROME_TAGS:
        return CHROME
    declared = zone in (CONTENT, HINTED)
    inside = CONTENT if tag in ("article", "main") and not declared else zone
    if tag == "header" and not declared:
        return CHROME
    if raw and not raw.isspace():
        a = _attributes(raw)
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
            return CHROME
        if a.get("role", "").lower() in _CHROME_ROLES:
            return CHROME
        names = f"{a.get('class', '')} {a.get('id', '')}"
        if tag not in ("html", "body") and not names.isspace():
            words = _name_words(names)
            if words & _DECLARED and tag != "main":
                return CHROME
            if words & _HINTS and tag != "main":
                return HINTED if declared else CHROME
            if words & _HEADER_WORDS and not declared and inside != CONTENT:
                return CHROME
            if _CONTENT_IDS.search(names) and not declared:
                inside = CONTENT
        if (a.get("itemprop", "").lower() == "articlebody" or a.get("role", "").lower() in ("main", "article")) and not declared:
            inside = CONTENT
    return inside


class _Open:
    """The open elements. Where the last of a name stands is known without a search, so that no nesting, however deep
    or broken, costs more than its length."""

    def __init__(self) -> None:
        self._names: list[str] = []
        self._zones: list[int] = []
        self._at: dict[str, list[int]] = defaultdict(list)
        self._blocks: list[int] = []

    def push(self, name: str, zone: int) -> None:
        self._at[name].append(len(self._names))
        if name in _BLOCKS:
            self._blocks.append(len(self._names))
        self._names.append(name)
        self._zones.append(zone)

    def cut(self, k: int) -> None:
        """Close all from place k on."""
        while len(self._names) > k:
            name = self._names.pop()
            self._zones.pop()
            self._at[name].pop()
            if name in _BLOCKS:
                self._blocks.pop()

    def last(self, names: Iterable[str]) -> int:
        best = -1
        for x in names:
            places = self._at.get(x)
            if places and places[-1] > best:
                best = places[-1]
        return best

    def block_above(self, k: int) -> bool:
        return bool(self._blocks) and self._blocks[-1] > k

    def zone(self, below: int | None = None) -> int:
        """Of the innermost element, or of the one around place ``below``."""
        k = len(self._zones) if below is None else below
        return self._zones[k - 1] if k else PLAIN

    def close(self, names: Iterable[str], until: Iterable[str]) -> None:
        """Close the last of names, unless an element of until stands inside it."""
        k = self.last(names)
        if k >= 0 and k > self.last(until):
            self.cut(k)


def page_lines(html: str) -> list[tuple[str, int]]:
    """(text, zone) of every block with text, in page order. Scripts, styles and the like have no text.

    Linear in the page, hostile ones included: a tag without end is text, and behind the first tag whose quotes never
    close, tags end at their first ">".
    """
    out: list[tuple[str, int]] = []
    held = _Open()
    text: list[str] = []
    text_zone = zone = PLAIN

    def flush() -> None:
        if text:
            block = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if block:
                out.append((block, text_zone))

    at, n, last, quotes = 0, len(html), html.rfind(">"), True
    while at < n:
        start = html.find("<", at)
        comment = start >= 0 and html.startswith("<!--", start)
        if start < 0 or (start > last and not comment):
            start = n
        if start > at:
            text_zone = zone
            text.append(html[at:start])
        if start == n:
            break
        if comment:
            end = html.find("-->", start + 4)
            at = end + 3 if end >= 0 else n
            continue
        m = _NAME.match(html, start + 1)
        if m is None:
            if html[start + 1] in "!?":
                at = html.find(">", start) + 1
            else:
                text_zone = zone
                text.append("<")
                at = start + 1
            continue
        rest = _REST.match(html, m.end()) if quotes else None
        if rest is None:
            quotes = False
            end = html.find(">", m.end())
            raw, at = html[m.end() : end], end + 1
        else:
            raw, at = rest[1], rest.end()
        tag = m[2].lower()
        block = tag in _BLOCKS
        if block:
            flush()
        if m[1]:
            k = held.last((tag,))
            if k >= 0 and (block or not held.block_above(k)):  # an inline end tag does not close blocks around it
                if held.zone(k + 1) != held.zone(k):
                    flush()
                held.cut(k)
                zone = held.zone()
            continue
        if tag in _RAW:
            if not raw.endswith("/") or tag != "svg":
                closing = _RAW[tag].search(html, at)
                end = html.find(">", closing.end()) if closing else -1
                at = end + 1 if end >= 0 else n
            continue
        if tag == "br":
            text.append(" ")
        if tag in _VOID:
            continue
        if block:
            held.close(*_PARAGRAPH)
            if tag in _CLOSES:
                held.close(*_CLOSES[tag])
            zone = held.zone()
        inside = _zone(tag, raw, zone) if raw or tag in _ZONED else zone
        if inside != zone:
            flush()
        held.push(tag, inside)
        zone = inside
    flush()
    return out


def common_lines(a: list, b: list, most_bits: int = 1 << 26) -> tuple[set[int], set[int]]:
    """Positions in a and in b of a longest common subsequence, exact at every size.

    Row i of the table of lengths is one integer, whose bit j is unset where the length grows at b[j]. Equal ends
    are taken off first; tables of up to ``most_bits`` bits are walked back from their last corner, larger ones cut in
    two by a where the lengths of both halves add up to the most (Hirschberg), so memory stays bounded.
    """
    mine: set[int] = set()
    other: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            mine.add(i)
            other.add(j)
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            mine.add(n)
            other.add(m)
        if i == n or j == m:
            continue
        if n - i == 1 or (n - i) * (m - j) <= most_bits:
            rows = list(_length_rows(a[i:n], b[j:m]))
            width, row = (m - j + 7) // 8, None
            while i < n and j < m:
                if a[n - 1] == b[m - 1]:
                    n, m, row = n - 1, m - 1, None
                    mine.add(n)
                    other.add(m)
                    continue
                row = row or rows[n - i - 1].to_bytes(width, "little")
                if row[(m - 1 - j) >> 3] >> ((m - 1 - j) & 7) & 1:
                    m -= 1
                else:
                    n, row = n - 1, None
        else:
            half = (i + n) // 2
            left, right = _lengths(a[i:half], b[j:m]), _lengths(a[half:n][::-1], b[j:m][::-1])
            cut = j + int(np.argmax(left + right[::-1]))
            todo += [(i, half, j, cut), (half, n, cut, m)]
    return mine, other


def _length_rows(a: list, b: list, most_held: int = 1 << 25) -> Iterator[int]:
    """The row after each line of a. Places of lines in b are held as integers up to ``most_held`` bytes in all."""
    where: dict = defaultdict(list)
    for j, x in enumerate(b):
        where[x].append(j)
    full, places, room = (1 << len(b)) - 1, {}, most_held // (len(b) // 8 + 64)
    row = full
    for x in a:
        if x in where:
            at = places.get(x)
            if at is None:
                if len(where[x]) < 8:
                    at = sum(1 << j for j in where[x])
                else:
                    marks = np.zeros(len(b), dtype=np.uint8)
                    marks[where[x]] = 1
                    at = int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")
                if len(places) < room:
                    places[x] = at
            hit = row & at
            row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(a: list, b: list) -> np.ndarray:
    """The lengths of common subsequences of a with the first 0, 1, ... len(b) lines of b."""
    for row in _length_rows(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes((len(b) + 7) // 8, "little"), dtype=np.uint8), count=len(b), bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def kept_lines(zones: Iterable[int], shared: set[int], use_zones: bool = True) -> list[int]:
    """Positions of the lines left when those shared with the nearest page are deleted, and the markup has corrected it."""
    if not use_zones:
        return [k for k, _ in enumerate(zones) if k not in shared]
    return [k for k, z in enumerate(zones) if z == CONTENT or (z != CHROME and k not in shared)]


def main_text(lines: list[tuple[str, int]], shared: set[int], use_zones: bool = True) -> str:
    """The article of one page, given the positions of lines shared with its nearest page."""
    return "\n\n".join(lines[k][0] for k in kept_lines([z for _, z in lines], shared, use_zones))


def path_order(url: Column) -> tuple[Column, Column]:
    """(host, path): the parts that pages are sorted by. A URL without a host is its own host."""
    bare = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(host == "", bare).otherwise(host), F.when(host == "", F.lit("")).otherwise(path)


KEY = ["page_id", "url", "body"]  # body: the page's hash, so rows that share an id keep apart


def nearest_pages(hashed: DataFrame, scratch: Scratch) -> DataFrame:
    """host, digest, path, zones, hashes, before, after of one page for each (host, digest), that is for all pages of a
    host with equal lines: the first by path. before and after are its neighbours by path (path, hashes; null: none).

    A range exchange sorts the pages, so a hot host spreads over tasks; where a range ends, the neighbour comes from
    a table of two rows for each range.
    """
    page = F.struct("path", *KEY, "zones", "hashes")
    first = hashed.groupBy("host", "digest").agg(F.min(page).alias("p")).select("host", "digest", "p.*")
    first = scratch.table(first, "first")
    order = [F.col(c).asc_nulls_first() for c in ("host", "path", *KEY)]
    ranged = first.repartitionByRange(2 * partitions(hashed.sparkSession), *order).withColumn("_part", F.spark_partition_id())
    ranged = scratch.table(ranged, "ranged")
    own = F.struct("host", "path", *KEY, "hashes")
    ends = ranged.groupBy("_part").agg(F.min(own).alias("first"), F.max(own).alias("last"))  # a row for each range
    ranges = Window.orderBy("_part")
    ends = ends.select("_part", F.lag("last").over(ranges).alias("_last"), F.lead("first").over(ranges).alias("_first"))
    inside = Window.partitionBy("_part").orderBy(*order)
    beside = ranged.withColumns({"_before": F.lag(own).over(inside), "_after": F.lead(own).over(inside)}).join(F.broadcast(ends), "_part")
    near = lambda x: F.when(x["host"] == F.col("host"), F.struct(x["path"].alias("path"), x["hashes"].alias("hashes")))
    return beside.select("host", "digest", "path", "zones", "hashes", near(F.coalesce("_before", "_last")).alias("before"), near(F.coalesce("_after", "_first")).alias("after"))


def same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["page_id"].eqNullSafe(b["page_id"]) & a["url"].eqNullSafe(b["url"]) & (a["body"] == b["body"])


def shared_with_nearest(path: str, zones: bytes, hashes: bytes, before: dict | None, after: dict | None, use_zones: bool = True) -> set[int]:
    """Positions of the lines that a page shares with the closer of its neighbours, which is the one with the longer
    common beginning of the path, the one before if equal. If that would leave nothing of a page, the other
    neighbour decides; what stands in both is boilerplate."""
    alike = lambda x: len(os.path.commonprefix([path, x["path"]]))
    others = sorted((x for x in (before, after) if x), key=alike, reverse=True)
    lines = lambda h: [h[k : k + 8] for k in range(0, len(h), 8)]
    shared: set[int] = set()
    for x in others:
        shared = common_lines(lines(hashes), lines(x["hashes"]))[0]
        if kept_lines(zones, shared, use_zones):
            break
    return shared


def extract(pages: DataFrame, zones: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for every row; ``zones=False`` is differencing alone.

    A null or empty page, and one of markup only, has an empty text. Repeated rows repeat, and rows that share an id or
    a URL keep apart. A null URL is a host of its own, of one page for all rows with equal lines. Pages of any length
    are read whole, in time linear in their length. An empty table gives no rows; other columns of pages take no part.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "html")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.xxhash64("html").alias("body"), "html")
    names = ["page_id", "url", "body"]

    def hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [page_lines(h.as_py() or "") for h in batch.column(3)]
            zones_of = [bytes(z for _, z in p) for p in pages]
            hashes = [b"".join(xxhash.xxh3_64_digest(x) for x, _ in p) for p in pages]
            digests = [xxhash.xxh3_128_digest(h) for h in hashes]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(x, pa.binary()) for x in (digests, zones_of, hashes)]], [*names, "digest", "zones", "hashes"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(sorted(shared_with_nearest(*r.values(), zones)), dtype="<u4").tobytes() for r in batch.select(["path", "zones", "hashes", "before", "after"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.binary())], ["host", "digest", "shared"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            found = [page_lines(h.as_py() or "") for h in batch.column(3)]
            lines = [small.compress("\n".join(f"{z}{x}" for x, z in p).encode()) for p in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lines, pa.binary())], [*names, "lines"])

    def join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = []
            for lines, shared in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                split = wide.decompress(lines).decode().split("\n")
                texts.append(main_text([(x[1:], int(x[0])) for x in split if x], set(np.frombuffer(shared or b"", "<u4").tolist()), zones))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    hashed = own.mapInArrow(hash_lines, "page_id long, url string, body long, digest binary, zones binary, hashes binary")
    host, path = path_order(F.col("url"))
    hashed = scratch.table(hashed.withColumns({"host": host, "path": path}), "hashed")
    shared = scratch.table(nearest_pages(hashed, scratch).mapInArrow(decide, "host string, digest binary, shared binary"), "shared")
    # every copy takes its first page's decisions; only keys meet here, so many copies are narrow rows
    decided = hashed.select(*KEY, "host", "digest").dropDuplicates(KEY).join(shared.hint("merge"), ["host", "digest"]).select(*KEY, "shared")
    decided = scratch.table(decided, "decided", keep=True)
    scratch.drop()
    parsed, decided = own.mapInArrow(parse, "page_id long, url string, body long, lines binary"), decided.hint("merge")
    joined = parsed.join(decided, same_key(parsed, decided), "left").select(parsed["page_id"], parsed["url"], "lines", "shared")
    return joined.mapInArrow(join_lines, "page_id long, url string, text string, n_chars long")
