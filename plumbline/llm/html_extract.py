"""Operator 1, HTML extraction by nearest-URL page differencing.

Pages are read into lines (one a block element), all but those of scripts, styles and the like. Within a host, in order of URL path, each
page is paired with its nearest neighbours; the lines of a pair are aligned by longest common subsequence, and shared lines, which belong to
the site and not to the page, are deleted. What differs from page to page and yet is no part of the article (menus that mark the page
they are on, adverts, notices, reader comments) is told by what the markup itself declares: lines of such parts are left out of what
differencing leaves.

Two rules keep articles whole. A pair that shares half the prose of either page (declared parts apart) is a copy, not a template, and deletes
nothing there. Inside a declared article only lines of two words or more, but under ``PROSE``, that both neighbours share are deleted.

Blocks: text runs over inline tags without a gap; ``<br>`` and table cells part words only; character references are decoded; white space
is turned into single spaces.

Edge cases: null and empty pages give an empty text; null URLs share a host of their own; repeated rows give equal results;
pages without article or main element are read from their whole body; a declared part that is never closed ends where an article or
main element begins; other unclosed elements end with their parent or the page; very long pages are aligned in memory that grows with their
lines, not with the square; an empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words that make a line prose, and the share of a page's prose that makes a pair copies.
PROSE, COPY = 8, 0.5
#: Bits of alignment rows that are kept at once.
MOST_BITS = 1 << 26
TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Element names of the HTML standard, and names that sites give to parts that are not the article.
RAW = set("script style noscript template svg math iframe object textarea title select canvas video audio datalist".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption".split()
)
SPACED = set("br td th wbr".split()) - {"wbr"}
CHROME = set("nav footer aside form button dialog menu".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
PARTS = set(
    "nav navbar navigation menu menubar sidebar sidebars footer masthead banner ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social breadcrumb breadcrumbs pagination pager toolbar widget widgets related recommended recommendations trending skip search copyright disclaimer".split()
)
TALK = set("comment comments disqus reply replies respond discussion".split())
WRAPPERS = set("with has no content contents main article page post entry body wrapper wrap layout container story text".split())


class Part:
    """An open element that is left out: its name, depth of the same name inside, and whether readers talk there."""

    __slots__ = ("name", "depth", "talk")

    def __init__(self, name: str, talk: bool):
        self.name, self.depth, self.talk = name, 1, talk


class Closings:
    """Which elements of a page are closed, by the place after their opening tag; each name is looked through once, when it is asked for."""

    def __init__(self, html: str):
        self.html, self.closed = html, {}

    def has(self, name: str, at: int) -> bool:
        if name not in self.closed:
            found, open_ = set(), []
            for m in re.finditer(rf"<(/?){name}(?![a-z0-9:-])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>", self.html, re.I):
                if not m[1]:
                    open_.append(m.end())
                elif open_:
                    found.add(open_.pop())
            self.closed[name] = found
        return at in self.closed[name]


def _left_out(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is not the article, and whether it holds reader comments."""
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
    if name in CHROME or (name == "header" and not inside):
        chrome = True
    elif found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        chrome = True
    else:
        chrome = "style" in found and "display:none" in found["style"].replace(" ", "").lower()
    talk = False
    if name not in ("html", "body", "main") and ("class" in found or "id" in found):
        for own in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
            words = set(re.split(r"[^a-z0-9]+", own))
            if words & WRAPPERS and not own.startswith(("comment", "ad-", "ads-")):
                continue
            talk |= bool(words & TALK)
            chrome |= bool(words & PARTS)
    return chrome or talk, talk


def lines(html: str | None) -> list[tuple[str, int]]:
    """The page's lines: text, and 2 inside an article element, 1 inside main, -1 inside a part declared not to be the article, else 0."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    part: Part | None = None
    articles = mains = 0

    def close() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((text, -1 if part else 2 if articles else 1 if mains else 0))

    at, html = 0, html or ""
    closings = Closings(html)
    while m := TOKEN.search(html, at):
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ending, attributes = m[1] or m[4], m[3] or m[6] or ""
        if not ending and name in RAW:
            if attributes.rstrip().endswith("/") and name == "svg":
                continue
            if name in ("noscript", "select", "textarea", "title", "script", "style") or not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if part is not None:
            if name == part.name:
                part.depth += -1 if ending else 0 if name in VOID else 1
                if not part.depth:
                    close()
                    part = None
                    continue
            opens = not ending and name in ("article", "main") and part.depth > 0 and not part.talk and not part_closed and not _left_out(name, attributes, False)[0]
            if not opens:
                if name in BLOCK:
                    close()
                elif name in SPACED:
                    held.append(" ")
                continue
            close()
            part = None  # an element that was never closed does not swallow the article
        if name in BLOCK:
            close()
        elif name in SPACED:
            held.append(" ")
        if ending:
            if name == "article":
                articles = max(0, articles - 1)
            elif name == "main":
                mains = max(0, mains - 1)
            continue
        if name not in VOID:
            chrome, talk = _left_out(name, attributes, bool(articles or mains))
            if chrome:
                close()
                part, part_closed = Part(name, talk), closings.has(name, at)
                continue
        if name == "article":
            articles += 1
        elif name == "main":
            mains += 1
    held.append(html[at:])
    close()
    return out


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence: bit-parallel rows, then a walk back. Lines of one side alone are left out first."""
    both = set(a) & set(b)
    x, y = [(i, v) for i, v in enumerate(a) if v in both], [(j, v) for j, v in enumerate(b) if v in both]
    found: list[tuple[int, int]] = []
    tail: list[tuple[int, int]] = []
    start = 0
    while start < min(len(x), len(y)) and x[start][1] == y[start][1]:
        found.append((x[start][0], y[start][0]))
        start += 1
    x, y = x[start:], y[start:]
    while x and y and x[-1][1] == y[-1][1]:
        tail.append((x.pop()[0], y.pop()[0]))
    return found + _middle(x, y) + tail[::-1]


def _rows(x: list[int], y: list[int]) -> Iterator[int]:
    """For each prefix of ``x``, the lengths of its longest common subsequences with all prefixes of ``y``: a bit of zero where they step up."""
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    s = full
    yield s
    for v in x:
        u = s & where.get(v, 0)
        s = ((s + u) | (s - u)) & full
        yield s


def _lengths(x: list[int], y: list[int]) -> np.ndarray:
    for s in _rows(x, y):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(s.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.r_[0, np.cumsum(bits == 0)]


def _middle(x: list[tuple[int, int]], y: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places and values of two sequences aligned; halves of the first are aligned apart where all rows would take over ``MOST_BITS``."""
    if not x or not y:
        return []
    a, b = [v for _, v in x], [v for _, v in y]
    if len(x) * len(y) > MOST_BITS and len(x) > 1:
        half = len(x) // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        return _middle(x[:half], y[:cut]) + _middle(x[half:], y[cut:])
    rows = list(_rows(a, b))
    i, j, out = len(x), len(y), []
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((x[i][0], y[j][0]))
    return out[::-1]


def place(url: str | None) -> tuple[str, str]:
    """Host and path of a URL, both comparable as text."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*)?([^?#]*)(.*)", url or "", re.S)
    return (m[1] or "").lower(), m[2] + m[3]


def parsed(html: str | None) -> tuple[list[str], list[int], bool]:
    """All lines of a page; for each 0 outside the kind of element that its text is taken from, 2 for prose inside it, else 1; and whether that
    element is a declared article."""
    found = lines(html)
    zone = max((z for _, z in found), default=0)
    return [t for t, _ in found], [0 if z != zone or z < 0 else 1 + (t.count(" ") + 1 >= PROSE) for t, z in found], zone == 2


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: host, path, all its lines' hashes and flags, and the lines that its text is taken from."""
    for b in batches:
        rows = []
        for url, html in zip(b.column("url").to_pylist(), b.column("html"), strict=True):
            found, flags, declared = parsed(html.as_py())
            hashes = np.array([xxhash.xxh64_intdigest(t) for t in found], "<u8")
            rows.append((*place(url), hashes.tobytes(), bytes(flags), [t for t, f in zip(found, flags, strict=True) if f], declared))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = (pa.string(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.bool_())
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("page_id", "url", "key")], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["page_id", "url", "key", "host", "path", "lines", "flags", "texts", "declared"])


def _differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per side of a pair: the page's key and the places of its shared lines, of those that its text is taken from; of copies none."""
    for b in batches:
        keys, shared = [], []
        for key_a, key_b, a, b_, flags_a, flags_b in zip(*[b.column(c).to_pylist() for c in ("key_a", "key_b", "lines_a", "lines_b", "flags_a", "flags_b")], strict=True):
            found = aligned(np.frombuffer(a, "<u8").tolist(), np.frombuffer(b_, "<u8").tolist())
            least = min(flags_a.count(2), flags_b.count(2))
            if least and sum(flags_a[i] == flags_b[j] == 2 for i, j in found) >= COPY * least:
                found = []
            for key, side, flags in ((key_a, 0, flags_a), (key_b, 1, flags_b)):
                keys.append(key)
                shared.append(np.array([p[side] for p in found if flags[p[side]]], "<u4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(shared, pa.binary())], names=["key", "shared"])


def left(texts: list[str], flags: bytes, declared: bool, shared: list[bytes]) -> str:
    """The text of a page's flagged lines without those that its neighbours share. shared: places of them, one entry a neighbour."""
    places = [set(np.frombuffer(s, "<u4").tolist()) for s in shared]
    kept = []
    for i, text in zip([i for i, f in enumerate(flags) if f], texts, strict=True):
        votes = sum(i in p for p in places)
        if not (votes == 2 and 1 < text.count(" ") + 1 < PROSE if declared else votes > 0):
            kept.append(text)
    return "\n".join(kept)


def main_text(html: str | None, shared: list[bytes]) -> str:
    """The page's text without the lines that its neighbours share."""
    found, flags, declared = parsed(html)
    return left([t for t, f in zip(found, flags, strict=True) if f], bytes(flags), declared, shared)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [left(t, f, d, s or []) for t, f, d, s in zip(*[b.column(c).to_pylist() for c in ("texts", "flags", "declared", "shared")], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def neighbours(signed: DataFrame) -> DataFrame:
    """``key_a``, ``key_b`` of pages next to each other in order of host and path.

    A range sort spreads a host of any size over all tasks; places are made whole-table ranks by adding the sizes of the partitions
    before (one number a partition reaches the driver), and ranks are joined with their successors.
    """
    spark = signed.sparkSession
    n = common.spread(signed)
    order = ["host", "path", "key"]
    sorted_ = signed.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = common.materialise(sorted_.select("host", "key", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "page-order")
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        before.append((part, total))
        total += sizes.get(part, 0)
    offsets = spark.createDataFrame(before, "part int, before long")
    ranked = placed.join(F.broadcast(offsets), "part").select("host", "key", (F.col("before") + F.col("at")).alias("rank"))
    a = ranked.select(F.col("host").alias("host_a"), F.col("key").alias("key_a"), "rank")
    b = ranked.select(F.col("host").alias("host_b"), F.col("key").alias("key_b"), (F.col("rank") - 1).alias("rank"))
    return a.join(b, "rank").filter("host_a = host_b").select("key_a", "key_b")


def score(pages: DataFrame) -> DataFrame:
    """Contract rows: page_id, url, text, n_chars."""
    kind = pages.schema["page_id"].dataType.simpleString()
    keyed = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("key"))
    own = common.materialise(keyed.mapInArrow(_parsed, f"page_id {kind}, url string, key long, host string, path string, lines binary, flags binary, texts array<string>, declared boolean"), "page-texts")
    signed = common.materialise(own.select("key", "host", "path", "lines", "flags").dropDuplicates(["key"]), "page-lines")
    side = lambda s: signed.select(F.col("key").alias(f"key_{s}"), F.col("lines").alias(f"lines_{s}"), F.col("flags").alias(f"flags_{s}"))
    pairs = neighbours(signed).join(side("a"), "key_a").join(side("b"), "key_b")
    marks = pairs.mapInArrow(_differenced, "key long, shared binary").groupBy("key").agg(F.collect_list("shared").alias("shared"))  # two a page
    marks = common.materialise(marks.filter(F.exists("shared", lambda s: F.length(s) > 0)), "shared-lines").withColumnRenamed("key", "mark")
    both = own.join(marks, F.col("key") == F.col("mark"), "left").select("page_id", "url", "texts", "flags", "declared", "shared")
    return both.mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")
