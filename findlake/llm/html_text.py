"""Main text of web pages: markup rules first, then differencing against the pages with the nearest URLs.

A page becomes text lines, one per block element, each with the markup it stands in. Lines in elements that hold no
article (menus, headers outside the article, footers, sidebars, notices, adverts, forms, comments) go. Of what is left,
lines that the page shares with its neighbours in the order of URL paths within its host go too, found by aligning
both pages' lines by longest common subsequence. This holds for every page; pages of a host with the same lines are one
in that order, so that copies don't empty each other. An exact check follows: lines that the markup names as
the article's come back, and beside a named article nothing else stays (`going`).
"""

from __future__ import annotations

import bisect
import functools
import html
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findlake.llm.common import map_arrow, slices, written

STEP_BYTES = 4 << 20
#: Pages of a host with the same lines are dealt like others up to this number, or their share of all pages where that is more.
MANY_COPIES, SHARE = 64, 4_096
#: Times that a line stands in a page from which its bits are kept.
OFTEN = 64
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
RAW = {name: re.compile(rf"</{name}\s*(?:>|\Z)", re.I) for name in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
SKIP = frozenset("script style textarea title xmp iframe noembed noframes nav aside footer form button select option noscript template svg canvas object audio video head menu dialog fieldset".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that mark what is not the article.
OUTSIDE = re.compile(r"(?<![a-z0-9])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|banner|breadcrumb|breadcrumbs|byline-social|comment|comments|commentlist|complementary|consent|contentinfo|cookie|cookies|copyright|disclaimer|disqus|footer|footnav|gdpr|menu|menubar|modal|nav|navbar|navigation|navigations|newsletter|notice|notices|notification|outbrain|pager|pagination|paywall|popup|promo|promotion|promoted|related|reply|replies|respond|search|share|sharing|sidebar|sidebars|sidenav|signup|skip|social|sponsor|sponsored|subscribe|subscription|taboola|tags|toc|toolbar|topbar|widget|widgets)(?![a-z0-9])")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
PLAIN, INSIDE, HINTED = 0, 1, 2
#: What may follow such a word in a class of an element inside an article; other compounds ("share-price") are the article's own.
PART = re.compile(r"(?:-(?:area|bar|block|box|button|buttons|container|content|form|inner|item|items|link|links|list|panel|section|slot|unit|wrap|wrapper))*")
#: Share of the letters of such an element that links hold before it counts as what is not the article, where its class only hints at it.
HINTS = frozenset("related share sharing social tags search notice notices disclaimer toc reply replies skip promoted promotion respond".split())


def _outside(name: str, attributes: str, in_article: bool) -> bool | None:
    """Is the element what the article is not? None where its class only hints at it, so that its links, then its neighbours, decide."""
    if name in SKIP or name == "header" and not in_article:
        return True
    if "=" not in attributes:
        return bool(re.search(r"(?<![\w-])hidden(?![\w-])", attributes))
    hint: bool | None = False
    for key, *value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(value).lower()
        if key in ("class", "id", "role") and name not in ("html", "body", "article", "main"):
            if not in_article:
                if OUTSIDE.search(re.sub(r"[_\s]+", "-", value)):
                    return True
            else:
                for token in value.replace("_", "-").split():
                    if (m := OUTSIDE.match(token)) and PART.fullmatch(token, m.end()):
                        if m[0] not in HINTS or key == "role":
                            return True
                        hint = None
        if key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    if re.search(r"(?<![\w=\"'-])hidden(?![\w=-])", ATTRIBUTE.sub("", attributes)):
        return True
    return hint


def _mostly_links(page: str, name: str, at: int) -> bool:
    """Do links hold half or more of the letters of the element whose content begins at a place? Its own kind may nest in it."""
    depth, links, inside, other = 1, 0, 0, 0
    while depth and (m := TAG.search(page, at)):
        n = len(page[at : m.start()].split()) and len("".join(page[at : m.start()].split()))
        inside, other = (inside + n, other) if links else (inside, other + n)
        at, tag = m.end(), (m[2] or "").lower()
        step = -1 if m[1] else 1
        if tag == name and not m[3].endswith("/"):
            depth += step
        if tag == "a":
            links = max(0, links + step)
    return inside >= other


def lines(page: str) -> list[tuple[str, int]]:
    """(text, place) of each block in page order, without what markup puts outside; place is INSIDE an article or main element,
    HINTED there in an element whose class hints at what the article is not, or PLAIN."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element, does it begin what is outside, an article, what its class hints at
    outer = inner = hinted = 0
    at = 0

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, (HINTED if hinted else INSIDE) if inner else PLAIN))
            parts = []

    def pop() -> None:
        nonlocal outer, inner, hinted
        _, o, i, hint = stack.pop()
        outer, inner, hinted = outer - o, inner - i, hinted - hint

    while m := TAG.search(page, at):
        if m.start() > at and not outer:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCK:
            flush()
        if m[1]:
            if name == "br" or name == "p" and not any(e[0] == "p" for e in stack):
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in ("article", "main", "body", "html", "nav", "aside", "footer", "header", "table") and name not in BLOCK:
                    break
            continue
        attributes = m[3]
        if name in RAW:
            end = RAW[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or attributes.endswith("/") and name in ("path", "circle", "use"):
            continue
        if name in BLOCK and stack and stack[-1][0] == "p":
            pop()
        elif name in CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
                if stack[k][0] in CLOSES[name]:
                    while len(stack) > k:
                        pop()
                    break
        o, i = _outside(name, attributes, inner > 0), name in ("article", "main") or 'itemprop="articleBody"' in attributes or "role=\"main\"" in attributes
        if hint := o is None:  # which what is outside already needn't be asked about
            o = not outer and _mostly_links(page, name, at)
        stack.append((name, o, i, hint))
        outer, inner, hinted = outer + o, inner + i, hinted + hint
    if at < len(page) and not outer:
        parts.append(page[at:])
    flush()
    return out


def named(found: list[tuple[str, int]]) -> list[str] | None:
    """The article's blocks where the markup names them, else None."""
    inside = [t for t, place in found if place != PLAIN]
    return inside or None


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Marks the lines of a that a longest common subsequence aligns with lines of b.

    Bit-parallel: a row of the table of lengths is one integer with a bit per line of a; where a bit falls, the length
    grows. The table is walked back once; of n rows, the square root of n are kept and the others made again from these.
    Only lines that stand often in a keep their bits, the others the places of these.
    """
    n = len(a)
    marks = np.zeros(n, bool)
    where: dict[int, list[int]] = {}
    for i, x in enumerate(a.tolist()):
        where.setdefault(x, []).append(i)
    bits = lambda places: functools.reduce(lambda m, i: m | 1 << i, places, 0)
    often = {x: bits(places) for x, places in where.items() if len(places) > OFTEN}
    other = [x for x in b.tolist() if x in where]
    full = (1 << n) - 1
    step = math.isqrt(len(other)) + 1

    def below(row: int, x: int) -> int:
        hit = row & (often[x] if x in often else bits(where[x]))
        return (row + hit | row - hit) & full

    row, kept = full, []
    for k, x in enumerate(other):
        if k % step == 0:
            kept.append(row)
        row = below(row, x)
    i = n
    while kept:
        part = other[(len(kept) - 1) * step : len(kept) * step]
        rows = [kept.pop()]
        for x in part[:-1]:
            rows.append(below(rows[-1], x))
        for x, before in zip(reversed(part), reversed(rows), strict=True):
            grown = ~row & before & (1 << i) - 1  # lengths this line of b added, before column i
            if grown:
                length = (~row & (1 << i) - 1).bit_count()
                if length > (~before & (1 << i) - 1).bit_count():
                    # the alignment ending here uses this line of b, with the first equal line of a from there on that keeps the length
                    places = where[x]
                    i = next(c for c in places[bisect.bisect_left(places, grown.bit_length() - 1) :] if (~before & (1 << c) - 1).bit_count() + 1 >= length)
                    marks[i] = True
            row = before
    return marks


def going(places: np.ndarray, own: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Marks the lines that neighbours share, and of all lines those that go after the check by markup.

    A line shared with a neighbour goes, unless markup names it as the article's: articles of one host repeat lines, and
    near copies most of them. Lines in elements whose class hints at a notice or the like are not named so; a neighbour
    that holds half the article or more says nothing of them. Beside a named article, lines outside it go, shared or not.
    """
    inside = places == INSIDE
    found, gone = np.zeros(len(own), bool), np.zeros(len(own), bool)
    for other in others:
        hit = shared(own, other)
        found |= hit
        if 2 * int(hit[inside].sum()) >= int(inside.sum()):
            hit = hit & (places != HINTED)
        gone |= hit
    gone &= ~inside
    if (places != PLAIN).any():
        gone |= places == PLAIN
    return found, gone


def _digests(texts: list[str]) -> list[int]:
    return [xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) >> 1 for t in texts]


def url_path(url: str) -> tuple[str, str]:
    """Host and path with the query, for ordering; the scheme, a www. and the fragment don't count."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^#]*)", url)
    host, path = (m[1].lower(), m[2]) if m else ("", url)
    return host.removeprefix("www."), re.sub(r"/+$", "", path) or "/"


def neighbours(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(at, other), the places of the pages before and after each in the order of host, path and id, within one host;
    and pages with their place as the column at.

    One range-partitioned sort, written once so that places stay. The last row of each partition meets the first row of
    the next by number, so a host of any size spreads over tasks and the result doesn't depend on the partitions.
    """
    order = ["host", "path", "page_id"]
    ranged = pages.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()), "pages-in-order")
    # rows number up without gaps in a partition; the next partition that has rows follows its last row
    ends = ranged.groupBy("part").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    after = Window.orderBy("part")  # one row a partition
    jumps = ends.select("last", F.lead("first").over(after).alias("next")).where("next is not null")
    steps = ranged.select("host", "at").join(F.broadcast(jumps), F.col("at") == F.col("last"), "left").select("host", "at", F.coalesce("next", F.col("at") + 1).alias("next"))
    right = ranged.select(F.col("host").alias("other_host"), F.col("at").alias("next"))
    pairs = steps.join(right, "next").where("host = other_host").select("at", "next")
    return pairs.select("at", F.col("next").alias("other")).union(pairs.select(F.col("next").alias("at"), F.col("at").alias("other"))), ranged


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row.

    Every page is differenced with its neighbours; only digests of lines move for that. Pages are parsed again for the
    text, so the rows must read the same twice; if they don't, it raises. Null html is empty and gives empty text; pages without a
    neighbour in their host keep all lines that the markup rules leave. Rows that repeat an id or a whole page are each
    extracted; pages of one host with the same lines have the neighbours of the first of them. An empty table gives an
    empty result. Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def parse(with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            press = zstandard.ZstdCompressor(level=1)
            for part in slices(batches, "html", STEP_BYTES):
                hosts, paths, places, digests, bodies, keys = [], [], [], [], [], []
                for url, page in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    found = lines(page)
                    host, path = url_path(url or "")
                    place = bytes(p for _, p in found)
                    body = "\n".join(t for t, _ in found).encode("utf-8", "replace")
                    keys.append(xxhash.xxh3_128_digest(b"\n".join((host.encode("utf-8", "replace"), place, body))))
                    if with_text:
                        bodies.append(press.compress(body))
                    else:
                        hosts.append(host if found else host + "/")  # pages without lines stand between no others
                        paths.append(path)
                        places.append(place)
                        digests.append(_digests([t for t, _ in found]))
                pair = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                w = [pa.array(pair[:, 0]), pa.array(pair[:, 1])]
                if with_text:
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *w, pa.array(bodies, pa.binary())], ["page_id", "url", "w1", "w2", "body"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hosts), pa.array(paths), *w, pa.array(places, pa.binary()), pa.array(digests, pa.list_(pa.int64()))], ["page_id", "host", "path", "w1", "w2", "places", "digests"])

        return run

    key = ["w1", "w2"]
    found = map_arrow(rows, parse(False), "page_id long, host string, path string, w1 long, w2 long, places binary, digests array<long>")
    # pages of a host with the same lines are one in the order, where the first of them stands
    same = found.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("host", "path", "page_id")).alias("at"), F.first("places").alias("places"), F.first("digests").alias("digests"))
    pairs, ranged = neighbours(same.select("at.*", *key, "n", "places", "digests"))
    others = pairs.join(ranged.select(F.col("at").alias("other"), F.col("digests").alias("others")), "other").groupBy("at").agg(F.collect_list("others").alias("others"))

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares, gone = [], []
            for places, own, others in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                hit, out = going(np.frombuffer(places, np.uint8), np.array(own, np.int64), [np.array(o, np.int64) for o in others or ()])
                shares.append(int(hit.sum()))
                gone.append(np.flatnonzero(out).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(shares, pa.int32()), pa.array(gone, pa.list_(pa.int32()))], [*key, "n", "shared", "gone"])

    both = ranged.join(others, "at", "left").select(*key, "n", "places", "digests", "others")
    verdicts = written(both.mapInArrow(difference, "w1 long, w2 long, n long, shared int, gone array<int>"), "page-verdicts")
    texts = map_arrow(rows, parse(True), "page_id long, url string, w1 long, w2 long, body binary")
    # the verdict on a page that very many rows hold goes to every task, so that these rows don't meet in one
    most = F.lit(max((verdicts.agg(F.sum("n")).first()[0] or 0) // SHARE, MANY_COPIES))
    hot = F.broadcast(verdicts.where(F.col("n") > most).select(*key, "gone"))
    cold = verdicts.where(F.col("n") <= most).select(*key, "gone").hint("merge")
    if hot.isEmpty():
        judged = texts.join(cold, key, "left")
    else:
        judged = texts.join(hot.select(*key), key, "left_anti").join(cold, key, "left").unionByName(texts.join(hot, key))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for part in slices(batches, "body", STEP_BYTES):
            out = []
            for body, gone in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                if gone is None:
                    raise ValueError("the pages changed between two reads")
                drop = set(gone)
                out.append(" ".join(t for k, t in enumerate(unpress.decompress(body).decode().split("\n")) if k not in drop))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    done = map_arrow(judged.select("page_id", "url", "body", "gone"), keep, "page_id long, url string, text string")
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
