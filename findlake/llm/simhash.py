"""SimHash near-duplicates: fingerprints, links by bit-sliced comparison, components.

Two fingerprints within radius r agree on at least two of r + 2 blocks of their bits, so pairs of blocks name candidate
buckets. A bucket with too many fingerprints is split by pairs of blocks of the bits that it leaves open, at most twice:
then eight bits are open, which 256 fingerprints fill. Inside a bucket the fingerprints are stored vertically, one word row per bit position: one query updates the
distance counters of 64 fingerprints per machine word by carry-save addition, and a word of 64 whose distances all
exceed the radius is abandoned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.llm.common import drop_written, id_and_text, keep_rows, slices, written

#: Fingerprints in a bucket that are compared with each other; larger buckets are split by further blocks.
BUCKET = 4_096
#: Bytes of texts in a batch, and of one text whose shingles are hashed at once.
STEP_BYTES = 1 << 20
_GAP = re.compile(rb"[ \t-\r]")


def _word_lists(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a step at a time; a step ends at white space."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + STEP_BYTES) if at + STEP_BYTES < len(data) else None
        end = gap.start() if gap else len(data)
        yield data[at:end].split()
        at = end


def _hashes(norm: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of some words joined by single spaces."""
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(norm)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(norm[a:b], seed) for a, b in zip(starts, ends[words - 1 :], strict=False)], "<u8")


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all shingles; zero without words."""
    counts, n, tail = np.zeros(64, np.int64), 0, []
    for some in _word_lists(text.encode("utf-8", "replace").lower()):
        tail += some
        if len(tail) >= words:
            h = _hashes(b" ".join(tail), words, seed)
            tail = tail[len(tail) - words + 1 :]
            for at in range(0, len(h), 65_536):
                counts += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(h)
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(tail), seed) if tail else 0
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text) and fp (the fingerprint as a signed long) of each row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", STEP_BYTES):
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], ["doc_id", "th", "fp"])

    return id_and_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text")).mapInArrow(run, "doc_id long, th long, fp long")


def _planes(values: np.ndarray) -> np.ndarray:
    """[bit, word]: bit b of 64 values, the last word filled up with zeros."""
    bits = np.zeros((-(-len(values) // 64) * 64, 64), np.uint8)
    bits[: len(values)] = np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def _within(differ: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(words not abandoned, their lanes with at most `radius` set bits over all planes) of planes of differing bits."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    live = np.arange(differ.shape[1])
    count = [np.zeros(len(live), np.uint64) for _ in range(radius.bit_length() + 1)]
    over = np.zeros(len(live), np.uint64)
    for step in range(0, 64, 8):  # after each eight planes the words with nothing left are abandoned
        for b in range(step, step + 8):
            carry = differ[b, live]
            for c in range(len(count)):
                count[c], carry = count[c] ^ carry, count[c] & carry
            over |= carry
        over |= _exceeds(count, radius)
        if not (keep := over != full).all():
            live, over, count = live[keep], over[keep], [c[keep] for c in count]
        if not len(live):
            break
    return live, ~over


def close_pairs(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes i < j of values (uint64) within the radius, by bit-sliced comparison of each with those after it."""
    n = len(values)
    sliced = _planes(values)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    query = np.where(np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), full, np.uint64(0))
    left, right = [], []
    for i in range(n - 1):
        first = (i + 1) // 64
        live, near = _within(sliced[:, first:] ^ query[i][:, None], radius)
        if len(live):
            w, lane = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            j = (live[w] + first) * 64 + lane
            j = j[(j > i) & (j < n)]
            left.append(np.full(len(j), i))
            right.append(j)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Which x and y of one place are within the radius: 64 pairs a word."""
    out = np.zeros(-(-len(x) // 64) * 64, bool)
    live, lanes = _within(_planes(x ^ y), radius)
    out.reshape(-1, 64)[live] = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return out[: len(x)]


def stars(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most n - 1 pairs that join the same components as the pairs i < j of 0 to n - 1."""
    if len(i) < n:
        return i, j
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if (root == before).all():
            own = np.flatnonzero(root != np.arange(n))
            return root[own], own


def _exceeds(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter is more than the radius."""
    more, equal = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for c in range(len(count) - 1, -1, -1):
        if radius >> c & 1:
            equal &= count[c]
        else:
            more |= equal & count[c]
            equal &= ~count[c]
    return more


def bucket_masks(radius: int, open_: int = (1 << 64) - 1) -> list[int]:
    """Masks of pairs of blocks of the open bits, one of which agrees for any two values within the radius; the bits that aren't open are in each."""
    places = [b for b in range(64) if open_ >> b & 1]
    n = radius + 2
    cuts = [round(len(places) * k / n) for k in range(n + 1)]
    blocks = [sum(1 << b for b in places[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
    return [((1 << 64) - 1 ^ open_) | blocks[i] | blocks[j] for i, j in combinations(range(n), 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that join all fingerprints within the radius into the same components.

    fps has one row per distinct fp. Buckets of more than `bucket` fingerprints are split by further blocks while more than
    eight bits are open; those that are left have 2**8 (radius 2) fingerprints at most.
    """
    if radius < 0 or radius > 4:
        raise ValueError("radius from 0 to 4")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, flat = batch.column(0).offsets.to_numpy(), batch.column(0).values.to_numpy().view(np.uint64)
            lengths = np.diff(ends)
            two = ends[:-1][lengths == 2]  # the pairs of all buckets of two side by side
            x, y = flat[two], flat[two + 1]
            ok = near(x, y, radius) if len(two) else np.zeros(0, bool)
            out = [(x[ok], y[ok])]
            for a, b in zip(ends[:-1][lengths > 2].tolist(), ends[1:][lengths > 2].tolist(), strict=True):
                values = flat[a:b]
                i, j = stars(len(values), *close_pairs(values, radius))
                out.append((values[i], values[j]))
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    masks = bucket_masks(radius)
    keyed = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    pairs = None
    while True:
        keyed = keyed.withColumn("v", F.col("fp").bitwiseAND(F.col("mask")))
        last = min(m.bit_count() for m in masks) >= 56
        sizes = written(keyed.groupBy("mask", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-buckets")
        fit = sizes if last else sizes.where(F.col("n") <= bucket)
        found = keyed.join(fit, ["mask", "v"]).groupBy("mask", "v").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(compare, "a long, b long")
        pairs = found if pairs is None else pairs.union(found)
        if last or (rest := sizes.where(F.col("n") > bucket)).isEmpty():
            return pairs.distinct()
        further = {m: bucket_masks(radius, (1 << 64) - 1 ^ m) for m in masks}
        choice = F.create_map(*[x for m, ms in further.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(k)) for k in ms]))])
        hot = written(keyed.join(rest.select("mask", "v"), ["mask", "v"], "left_semi"), "simhash-hot")
        keyed = hot.select("fp", F.explode(F.element_at(choice, F.col("mask"))).alias("mask")).distinct()
        masks = sorted({k for ms in further.values() for k in ms})


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) reaches, by alternating stars.

    Each round ties every node's greater neighbours, then its lesser ones, to its least neighbour; only minima and
    joins on node are needed, and no list of neighbours is ever built; the joins are plain equi joins, whose hot nodes
    adaptive execution deals to several tasks. Rounds are written to the shared folder.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "stars")
    mark = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        then = written(small, "stars")
        seen = then.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        drop_written(now)
        now = then
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen


def simhash_components(docs: DataFrame, radius: int = 2, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, fp, component_id (least doc_id reachable over links, itself included) and root (least fp reachable), a row per row.

    Texts lower-case A-Z and split at ASCII white space; texts of fewer words than a shingle are one shingle, texts
    without words (null ones too) have fingerprint zero and link like any other. Equal fingerprints link at once.
    A null id forms no component_id unless others of its component have ids. Empty tables give an empty result.
    """
    rows = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    heads = rows.groupBy("fp").agg(F.min("doc_id").alias("head"))
    roots = components(links(rows.select("fp").distinct(), radius))
    placed = heads.join(roots, heads.fp == roots.node, "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("head").alias("component_id"))
    of = placed.join(least, "root").select("fp", "component_id", "root")
    return rows.join(of, "fp").select("doc_id", "th", "fp", "component_id", "root")


def drop_near_copies(docs: DataFrame, radius: int = 2, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the least id of their component, with all their columns; a component without ids keeps one row."""
    found = simhash_components(docs, radius, words, id_col, text_col)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("first"))
    return keep_rows(docs, first.select("first.doc_id", "first.th"), id_col, text_col)
