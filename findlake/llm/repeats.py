"""Repeated passages: bytes covered by a string of a given length that also starts anywhere else.

Every string of `length` bytes has one anchor: its least 32-byte hash. Equal strings have equal anchors, so a string's
repeats are found among the windows of its anchor (runs of neighbouring strings of one text with one anchor, cut to a
bounded size). Windows that are equal as a whole are all repeats and fold to one; where an anchor has different windows, or
its least hash stands twice in one, these go to a run-length index:
a Burrows-Wheeler transform of bounded blocks of windows, kept as runs with the text places of the run ends. The match
length with the neighbour in suffix order is compared out at run ends only; along the text it falls by one a byte until
the next sampled place, so one stream over the text gives all matching statistics. Anchors with too many different
windows for a block compare the hashes of all their strings, dealt by hash.

Whole windows are held equal by a hash of 128 bits beside their anchor, strings of those anchors by two of 64 bits; two
different ones agree in both by chance once in 2**128 pairs, which is below the rate at which memory fails. What goes
through the index is compared symbol by symbol.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.llm.common import id_and_text, map_arrow, slices, split_join, written

LENGTH = 400
GRAM = 32
#: Bytes of texts that are cut together.
STEP_BYTES = 1 << 20
#: Strings of a long text that are hashed together.
PIECE = 1 << 20
#: Bytes of windows in one index, and different windows of an anchor from which its strings are dealt by hash.
BLOCK_BYTES = 1 << 20
MANY_WINDOWS = 2_000
#: Symbols of one index stay under this, for three ranks share 63 bits.
SYMBOLS = 1 << 21
#: Windows whose strings are hashed together on that way.
HASHED_WINDOWS = 2_000
_M = np.uint64(0xFF51AFD7ED558CCD)
WINDOWS = "doc_id long, th long, start int, anchor long, n long, bytes binary, m long"
MARKS = "doc_id long, th long, start int, end int"


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes that begin at each place, along the last axis."""
    x = data.astype(np.uint64)
    for k in (1, 2, 4):
        x = x[..., :-k] | x[..., k:] << np.uint64(8 * k)
    return x


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * _M
    return (x ^ x >> np.uint64(29)) * np.uint64(0xC4CEB9FE1A85EC53)


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first string, number of strings, may a string repeat inside) of each window; strings are named by where they start.

    A window's strings follow each other and have one least hash, so nothing but the strings themselves decides where they
    go. Runs longer than a string's hashes are cut: a text of one byte is windows of one content. A string can only repeat
    inside a window if the least hash stands there twice.
    """
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, bool)
    if len(data) > PIECE + length:  # windows may end anywhere, so a long text goes in pieces that share no string
        parts = [(at, anchors(data[at : at + PIECE + length - 1], length)) for at in range(0, len(data) - length + 1, PIECE)]
        return tuple(np.concatenate([x[k] + at if k == 1 else x[k] for at, x in parts]) for k in range(4))
    w = _words(np.frombuffer(data, np.uint8))
    h = _mix(w[: len(w) - GRAM + 8])
    for j in range(8, GRAM, 8):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + len(h)])
    least, span = h, 1
    window = length - GRAM + 1
    while span * 2 <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < window:
        least = np.minimum(least[: len(h) - window + 1], least[window - span :])
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    n = np.diff(np.append(first, len(least)))
    if n.max() > window:
        pieces = -(-n // window)
        turn = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + turn * window
        n = np.minimum(np.repeat(n, pieces) - turn * window, window)
    value = least[first]
    # places that hold a least hash, found by a few of its bits
    bits = min(24, max(16, 4 + len(value).bit_length()))
    low, some = np.uint64((1 << bits) - 1), np.zeros(1 << bits, bool)
    some[value & low] = True
    at = np.flatnonzero(some[h & low])
    order = np.lexsort((at, h[at]))
    at, found = at[order], h[at][order]
    twice = np.sort(found[1:][(found[1:] == found[:-1]) & (np.diff(at) < 2 * length)])
    inside = np.zeros(len(value), bool)
    if len(twice):
        inside = twice[np.minimum(np.searchsorted(twice, value), len(twice) - 1)] == value
    return value.view(np.int64), first, n, inside


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of an integer text with unique separators (all under 65,536), by prefix tripling; under SYMBOLS symbols."""
    n = len(symbols)
    if n >= SYMBOLS:
        raise ValueError(f"{n} symbols in one index, {SYMBOLS - 1} at most")
    s = np.concatenate([symbols.astype(np.uint64), np.zeros(3, np.uint64)])
    key = s[:n] << np.uint64(48) | s[1 : n + 1] << np.uint64(32) | s[2 : n + 2] << np.uint64(16) | s[3 : n + 3]
    order = np.argsort(key)
    new = np.empty(n, bool)
    new[0] = True
    sorted_ = key[order]
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    place = np.arange(n, dtype=np.int64)
    rank = np.zeros(n, np.uint64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0)) + 1
    k = 4
    live = np.flatnonzero(~new | ~np.append(new[1:], True))
    while len(live):
        at = order[live]
        key = rank[at] << np.uint64(42) | _rank_at(rank, at + k) << np.uint64(21) | _rank_at(rank, at + 2 * k)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[live] = at
        head = np.empty(len(live), bool)
        head[0] = True
        np.not_equal(key[1:], key[:-1], out=head[1:])
        rank[at] = live[np.maximum.accumulate(np.where(head, np.arange(len(live)), 0))] + 1
        live = live[~head | ~np.append(head[1:], True)]
        k *= 3
    return order


def _rank_at(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where(at < len(rank), rank[np.minimum(at, len(rank) - 1)], np.uint64(0))


def common_prefix(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, compared out four symbols at a time."""
    n = len(symbols)
    s = np.concatenate([symbols.astype(np.uint64), np.arange(1, 9, dtype=np.uint64)])
    four = s[: n + 4] << np.uint64(48) | s[1 : n + 5] << np.uint64(32) | s[2 : n + 6] << np.uint64(16) | s[3 : n + 7]
    out = np.zeros(len(a), np.int64)
    live, x, y, done = np.arange(len(a)), a.copy(), b.copy(), 0
    while len(live):
        differ = four[x] ^ four[y]
        ended = differ != 0
        if ended.any():
            d = differ[ended]
            out[live[ended]] = done + np.where(d >> np.uint64(48), 0, np.where(d >> np.uint64(32), 1, np.where(d >> np.uint64(16), 2, 3)))
            live, x, y = live[~ended], x[~ended], y[~ended]
        x, y, done = x + 4, y + 4, done + 4
    return out


def matching_statistics(symbols: np.ndarray) -> np.ndarray:
    """For each place of the text, the longest match of what begins there with what begins anywhere else."""
    n = len(symbols)
    order = suffix_order(symbols)
    bwt = symbols[order - 1]  # place 0 takes the last symbol, a separator that no other place has
    ends = np.flatnonzero(bwt[1:] != bwt[:-1])  # a run ends at ends[k], the next begins at ends[k] + 1
    before, after = order[ends], order[ends + 1]
    match = common_prefix(symbols, before, after)
    out = np.zeros(n, np.int64)
    for places, first in ((after, order[0]), (before, order[-1])):
        at, value = np.zeros(n, np.int64), np.zeros(n, np.int64)
        sampled = np.zeros(n, bool)
        sampled[first] = sampled[places] = True  # the least and the greatest suffix have no neighbour on one side
        value[places] = match
        at[sampled] = np.flatnonzero(sampled)
        at = np.maximum.accumulate(at)
        np.maximum(out, value[at] - (np.arange(n) - at), out=out)
    return out


def repeated(windows: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Marks the strings (by start) of each window that also begin elsewhere in these windows."""
    sizes = np.array([len(w) for w in windows])
    starts = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.zeros(int(sizes.sum()) + len(windows), np.int64)
    symbols[np.delete(np.arange(len(symbols)), starts + sizes)] = np.frombuffer(b"".join(windows), np.uint8)
    symbols += len(windows) + 1
    symbols[starts + sizes] = np.arange(1, len(windows) + 1)
    long_ = matching_statistics(symbols) >= length
    return [long_[a : a + n - length + 1] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def blocks(rows: Iterable[tuple], length: int = LENGTH) -> Iterator[list[tuple]]:
    """The rows of WINDOWS, sorted by anchor, as lists of whole anchors that stay under SYMBOLS in one index.

    An anchor has at most m windows, each under two lengths, so whether it fits is known before it begins.
    """
    open_: list[tuple] = []
    size = 0
    for row in rows:
        if open_ and row[3] != open_[-1][3] and (size + len(row[5]) > BLOCK_BYTES or size + row[6] * (2 * length - GRAM + 1) >= SYMBOLS):
            yield open_
            open_, size = [], 0
        open_.append(row)
        size += len(row[5]) + 1
    if open_:
        yield open_


def _spans(marks: np.ndarray, start: int, length: int) -> list[tuple[int, int]]:
    """Covered bytes of a text from marked strings, the first of which starts at `start`."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return [(start + a, start + b - 1 + length) for a, b in edges.reshape(-1, 2).tolist()]


def joined(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that overlapping or touching spans cover, in order."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    head = np.append(True, start[1:] > end[:-1])
    return start[head], end[np.append(head[1:], True)]


def _marks(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "th", "start", "end"])


def _string_hashes(windows: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, first hash, second hash) of every string of the windows."""
    widest = max(map(len, windows))
    data = np.zeros((len(windows), widest + 8), np.uint8)
    for i, w in enumerate(windows):
        data[i, : len(w)] = np.frombuffer(w, np.uint8)
    words = _words(data)
    whole, rest = divmod(length, 8)
    sizes = np.array([len(w) for w in windows])
    count = widest - length + 1
    valid = np.arange(count)[None, :] <= (sizes - length)[:, None]
    out = []
    for base, seed in ((0x9FB21C651E98DF25, 1), (0xA0761D6478BD642F, 2)):
        mixed = _mix(words + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        h = np.zeros((len(windows), count), np.uint64)
        for j in [*range(0, whole * 8, 8), *([length - 8] if rest else [])]:
            h = h * np.uint64(base) + mixed[:, j : j + count]
        out.append(_mix(h)[valid])
    return np.repeat(np.arange(len(windows)), valid.sum(axis=1)), *out


def repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", many: int = MANY_WINDOWS) -> DataFrame:
    """doc_id, n_bytes, spans (array of start and end bytes that are covered), kept (the bytes outside them, joined).

    Texts are UTF-8 bytes and null is empty; texts shorter than `length` keep everything. Strings never cross texts. Overlapping
    repeats in one text count, so a long run of one byte is covered. Rows that repeat an id are texts like any others, rows
    that repeat a text repeat all its strings.
    An empty table gives an empty result. Other columns are ignored.
    """
    if length < GRAM + 8:
        raise ValueError(f"strings of {GRAM + 8} bytes at least")
    texts = id_and_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "th", "anchor", "w1", "w2", "start", "strings", "inside"]
        for part in slices(batches, "text", STEP_BYTES):
            doc, th, found, whole = [], [], [], []
            for one, text, own in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                data = text.encode("utf-8", "replace")
                h, first, n, inside = anchors(data, length)
                whole += [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(first.tolist(), (first + n - 1 + length).tolist(), strict=True)]
                found.append((h, first, n, inside))
                doc.append(pa.repeat(pa.scalar(one, pa.int64()), len(h)))
                th.append(pa.repeat(pa.scalar(own, pa.int64()), len(h)))
            h, first, n, inside = (np.concatenate(x) for x in zip(*found, strict=True))
            pair = np.frombuffer(b"".join(whole), "<i8").reshape(-1, 2)
            every = [pa.concat_arrays(doc), pa.concat_arrays(th), pa.array(h), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(inside)]
            for at in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([c.slice(at, 100_000) for c in every], names)

    key = ["anchor", "w1", "w2"]
    found = written(map_arrow(texts, find, "doc_id long, th long, anchor long, w1 long, w2 long, start int, strings int, inside boolean"), "anchors")
    classes = found.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "start", "strings")).alias("rep"), F.max("inside").alias("inside"))
    shared = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all"), F.max("inside").alias("any")).where(F.col("any") | (F.col("all") > 1)).select("anchor", "m")
    live = written(classes.join(shared, "anchor").select(*key, "n", "m", "inside", "rep.*"), "anchor-windows")
    # whole windows that occur again; a passage that very many texts hold is joined without a shuffle
    again = live.where("n > 1").select(*key, "n")
    whole = split_join(found.select(*key, "doc_id", "th", "start", "strings"), again, key, "n").select("doc_id", "th", "start", (F.col("start") + F.col("strings") - 1 + length).cast("int").alias("end"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "th", "start", "anchor", "n", "bytes", "m"])

        rows, size = [], 0
        for part in slices(batches, "text", STEP_BYTES):
            for doc, th, text, places in zip(*(part.column(i) for i in range(4)), strict=True):
                doc, th, data = doc.as_py(), th.as_py(), text.as_buffer()
                columns = (places.values.field(c).to_numpy() for c in ("start", "strings", "anchor", "n", "m"))
                for start, strings, anchor, n, m in zip(*columns, strict=True):
                    rows.append((doc, th, start, anchor, n, data[start : start + strings - 1 + length].to_pybytes(), m))
                    size += len(rows[-1][5])
                    if size > STEP_BYTES:
                        yield close()
                        rows, size = [], 0
        if rows:
            yield close()

    distinct_texts = texts.select("doc_id", "th", "text")

    # the windows of anchors that have different ones, cut once for both ways
    places = live.where("m > 1 or inside and n = 1").groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "strings", "anchor", "n", "m")).alias("places"))
    holding = distinct_texts.withColumn("key", F.struct("doc_id", "th")).join(places.select(F.struct("doc_id", "th").alias("key"), "places"), "key")
    windows = written(map_arrow(holding.select("key.doc_id", "key.th", "text", "places"), cut, WINDOWS), "windows")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True))
        for block in blocks(rows, length):
            marks = repeated([r[5] for r in block], length)
            yield _marks([(doc, th, a, b) for (doc, th, start, _, n, _, _), m in zip(block, marks, strict=True) if n == 1 for a, b in _spans(m, start, length)])

    few = map_arrow(windows.where(F.col("m") <= many).repartition("anchor").sortWithinPartitions("anchor"), index, MARKS)
    marks = whole.unionByName(few)
    hot = windows.where(F.col("m") > many).drop("m")
    if n_hot := hot.count():
        marks = marks.unionByName(_by_hash(hot, n_hot, length))
    spans = marks.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "end")).alias("marks")).select(F.struct("doc_id", "th").alias("key"), "marks")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for part in slices(batches, "text", STEP_BYTES):
            sizes, covered, kept = [], [], []
            for text, places in zip(part.column(1), part.column(2), strict=True):
                data = text.as_buffer().to_pybytes()
                a, b = joined(*(places.values.field(c).to_numpy() for c in ("start", "end"))) if places.is_valid else (np.zeros(0, np.int32),) * 2
                sizes.append(len(data))
                covered.append(pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["start", "end"]))
                kept.append(b"".join([data[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True)]))
            ends = np.append(0, np.cumsum([len(c) for c in covered])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(covered), type=span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    rows = distinct_texts.withColumn("key", F.struct("doc_id", "th")).join(spans, "key", "left").select("key.doc_id", "text", "marks")
    return map_arrow(rows, keep, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def _by_hash(windows: DataFrame, n: int, length: int) -> DataFrame:
    """Marks of windows whose anchors have very many: strings meet by hash, in as many groups as there are groups of windows."""
    groups = -(-n // HASHED_WINDOWS)
    bits = max(0, (groups - 1).bit_length())
    dealt = windows.withColumn("t", F.pmod(F.xxhash64("doc_id", "th", "start", "anchor"), F.lit(groups)).cast("int"))

    def hashes(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(window, order of its strings' hash pair, pairs in order, first of each pair), windows in one fixed order."""
        window, h1, h2 = _string_hashes(group["bytes"].to_pylist(), length)
        order = np.lexsort((h2, h1))
        pairs = np.stack([h1[order], h2[order]])
        first = np.flatnonzero(np.append(True, (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)))
        return window, order, pairs, first

    def sort_key(group: pa.Table) -> pa.Table:
        return group.sort_by([(c, "ascending") for c in ("doc_id", "th", "start", "anchor")])

    def part_of(h1: np.ndarray) -> np.ndarray:
        return (h1 >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h1), np.int64)

    def emit(group: pa.Table) -> pa.Table:
        group = sort_key(group)
        window, order, pairs, first = hashes(group)
        size = np.diff(np.append(first, pairs.shape[1]))
        often = np.array(group["n"].to_pylist(), np.int64)[window[order[first]]] > 1
        many = (size > 1) | often
        pairs = pairs[:, first]
        cuts = np.searchsorted(part_of(pairs[0]), np.arange((1 << bits) + 1))
        some = [r for r in range(1 << bits) if cuts[r] < cuts[r + 1]]
        cut = lambda x: [x[..., cuts[r] : cuts[r + 1]].tobytes() for r in some]
        return pa.table({"part": pa.array(some, pa.int32()), "t": pa.array([group["t"][0].as_py()] * len(some), pa.int32()), "pairs": pa.array(cut(pairs), pa.binary()), "many": pa.array(cut(many), pa.binary())})

    def meet(group: pa.Table) -> pa.Table:
        pairs = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in group["pairs"].to_pylist()]
        many = np.concatenate([np.frombuffer(x, bool) for x in group["many"].to_pylist()])
        both = np.concatenate(pairs, axis=1)
        order = np.lexsort((both[1], both[0]))
        in_order = both[:, order]
        first = np.append(True, (in_order[:, 1:] != in_order[:, :-1]).any(axis=0))
        number = np.cumsum(first) - 1
        again = (np.bincount(number) > 1) | (np.bincount(number, many[order]) > 0)
        out = np.empty(len(order), bool)
        out[order] = again[number]
        ends = np.cumsum([p.shape[1] for p in pairs])[:-1]
        return pa.table({"part": group["part"], "t": group["t"], "again": pa.array([x.tobytes() for x in np.split(out, ends)], pa.binary())})

    def mark(group: pa.Table, answers: pa.Table) -> pa.Table:
        group = sort_key(group)
        window, order, pairs, first = hashes(group)
        again = np.concatenate([np.frombuffer(x, bool) for x in answers.sort_by("part")["again"].to_pylist()])
        size = np.diff(np.append(first, pairs.shape[1]))
        flags = np.empty(len(order), bool)
        flags[order] = np.repeat(again, size)
        cuts = np.searchsorted(window, np.arange(group.num_rows + 1))
        rows = []
        for i, (doc, th, start, n) in enumerate(zip(*(group[c].to_pylist() for c in ("doc_id", "th", "start", "n")), strict=True)):
            if n == 1:
                rows += [(doc, th, a, b) for a, b in _spans(flags[cuts[i] : cuts[i + 1]], start, length)]
        return pa.Table.from_batches([_marks(rows)])

    sent = dealt.groupBy("t").applyInArrow(emit, "part int, t int, pairs binary, many binary")
    answers = sent.groupBy("part").applyInArrow(meet, "part int, t int, again binary")
    return dealt.groupBy("t").cogroup(answers.groupBy("t")).applyInArrow(mark, MARKS)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Texts as hexadecimal digits; every string of 400 bytes by its hash, cut from pieces of 512 starts.
REPEATS_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT r, k, substr(h, 1024 * k + 1, 1822) AS piece FROM (SELECT r, h, unnest(range(0, (length(h) // 2 - 400) // 512 + 1)) AS k FROM d WHERE length(h) >= 800)),
s AS (SELECT r, 512 * k + j AS i, md5_number(substr(piece, 2 * j + 1, 800)) AS g FROM (SELECT r, k, piece, unnest(range(0, least(512, length(piece) // 2 - 399))) AS j FROM pieces)),
again AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
marks AS (SELECT r, i FROM s JOIN again USING (g)),
heads AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS head FROM marks),
runs AS (SELECT r, i, sum(head) OVER (PARTITION BY r ORDER BY i) AS run FROM heads),
spans AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY r, run),
cuts AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM cuts JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
