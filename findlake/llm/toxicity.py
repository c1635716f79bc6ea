"""Toxicity: a linear classifier over hashed character n-grams whose features are scaled by naive Bayes log-count ratios.

A feature is an n-gram of the lower-cased text that occurs in it, with runs of white space as one space. Training
takes a bounded sample of labelled rows, written once: one distributed pass counts in how many toxic and other texts each
bucket occurs and gives the log-count ratios; the buckets that tell the classes apart best stay; a second pass over the
sample gives each text's buckets, to which logistic regression is fitted. Scoring streams whole texts through one weight
per bucket. Texts longer than a step are cut with an overlap, so that memory doesn't grow with a text's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.llm.common import drop_written, id_and_text, map_arrow, release, slices, written

ORDERS = (3, 4, 5, 6)
BITS = 20
#: Labelled rows that the classifier is fitted on, the least by hash of their id.
SAMPLE_ROWS = 20_000
#: Buckets with a weight, numbered in 16 bits.
FEATURES = 1 << 15
#: Characters that are turned into features at once, and texts; a text's number and a bucket share 32 bits.
STEP_BYTES = 1 << 17
STEP_TEXTS = 1 << 12
_SPACE = re.compile(r"\s+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % 5 == 0


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _buckets(codes: np.ndarray, orders: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """(n, bucket of the n-gram that begins at each place) for each order, one at a time."""
    rolled = np.zeros(len(codes), np.uint32)
    for n in range(1, min(max(orders), len(codes)) + 1):
        rolled = rolled[: len(codes) - n + 1] * np.uint32(0x9E3779B1) + codes[n - 1 :]
        if n in orders:
            yield n, ((rolled ^ rolled >> np.uint32(15)) * np.uint32(0x85EBCA6B) + np.uint32(n * 0x2545F491 & 0xFFFFFFFF)) >> np.uint32(32 - BITS)


def _clean(text: str) -> str:
    return f" {_SPACE.sub(' ', text.lower()).strip(' ')} "


def _of_long(text: str, orders: tuple[int, ...]) -> np.ndarray:
    """The distinct buckets of one text, a step at a time; steps overlap by what an n-gram can reach over."""
    seen = np.zeros(1 << BITS, bool)
    for at in range(0, len(text), STEP_BYTES):
        for _, bucket in _buckets(_codes(text[at : at + STEP_BYTES + max(orders) - 1]), orders):
            seen[bucket] = True
    return np.flatnonzero(seen)


def _of_short(texts: list[str], orders: tuple[int, ...], wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    row = np.repeat(np.arange(len(texts), dtype=np.uint32) << np.uint32(BITS), [len(t) for t in texts])
    out = []
    for n, bucket in _buckets(_codes("".join(texts)), orders):
        ok = row[: len(bucket)] == row[n - 1 :]
        if wanted is not None:
            ok &= wanted[bucket]
        out.append(row[: len(bucket)][ok] | bucket[ok])
    both = np.sort(np.concatenate(out)) if out else np.zeros(0, np.uint32)
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return (both >> np.uint32(BITS)).astype(np.int64), (both & np.uint32((1 << BITS) - 1)).astype(np.int64)


def grams(texts: list[str], orders: tuple[int, ...] = ORDERS, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct n-grams of each text, only wanted buckets if a mask is given; sorted by row and bucket."""
    rows, buckets, open_, size, first = [], [], [], 0, 0

    def close() -> None:
        if open_:
            row, bucket = _of_short(open_, orders, wanted)
            rows.append(row + first)
            buckets.append(bucket)

    for i, text in enumerate(texts):
        text = _clean(text)
        if open_ and (size + len(text) > STEP_BYTES or len(open_) == STEP_TEXTS):
            close()
            open_, size = [], 0
        if len(text) > STEP_BYTES:
            bucket = _of_long(text, orders)
            bucket = bucket if wanted is None else bucket[wanted[bucket]]
            rows.append(np.full(len(bucket), i))
            buckets.append(bucket)
            continue
        if not open_:
            first = i
        open_.append(text)
        size += len(text)
    close()
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(buckets)) if rows else (none, none)


@dataclass
class Model:
    """weight of each bucket (already times its log-count ratio) and bias; without both classes, nothing is toxic."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str], table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        wanted, dense = table
        total = np.full(len(texts), self.bias)
        if len(self.buckets):
            row, bucket = grams(texts, wanted=wanted)
            total += np.bincount(row, dense[bucket], len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        wanted, dense = np.zeros(1 << BITS, bool), np.zeros(1 << BITS)
        wanted[self.buckets], dense[self.buckets] = True, self.weights
        return wanted, dense


def _labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """key, text and toxic of the sample: at most `rows` ids, so that side of the join is bounded, and one text for each id."""
    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    some = one.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "toxic")).alias("row"))
    return found.select(F.xxhash64("doc_id").alias("key"), "row.text", "row.toxic")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many texts of either class each bucket occurs, in 256 rows of 4096 buckets."""
    seen, rows = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        for part in slices([batch], "text", STEP_BYTES):
            texts, toxic = part.column(1).to_pylist(), part.column(2).to_numpy(zero_copy_only=False)
            row, bucket = grams(texts)
            rows += np.bincount(toxic, minlength=2)[:2]
            for y in (0, 1):
                seen[y] += np.bincount(bucket[toxic[row] == y], minlength=1 << BITS)
    if rows.any():
        pieces = seen.reshape(2, 256, -1).astype(np.int32)
        some = [k for k in range(256) if pieces[:, k].any()]
        columns = [pa.array(some, pa.int32()), *(pa.array([pieces[y, k].tobytes() for k in some], pa.binary()) for y in (0, 1))]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array([int(rows[y])] * len(some), pa.int64()) for y in (0, 1))], ["piece", "clean", "toxic", "n_clean", "n_toxic"])


def _sum(group: pa.Table) -> pa.Table:
    totals = [sum(np.frombuffer(x, np.int32).astype(np.int64) for x in group[c].to_pylist()) for c in ("clean", "toxic")]
    return pa.table({"piece": group["piece"][:1], "clean": pa.array([totals[0].astype(np.int32).tobytes()], pa.binary()), "toxic": pa.array([totals[1].astype(np.int32).tobytes()], pa.binary())})


def logistic(ends: np.ndarray, feature: np.ndarray, scale: np.ndarray, y: np.ndarray, l2: float = 0.3, rounds: int = 60) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by L-BFGS with backtracking; the features of row i are feature[ends[i] : ends[i + 1]].

    A feature that is there has the value of its scale. The rarer class weighs more, by the square root of how much
    rarer it is. Rows are visited in blocks, so that memory stays near that of the features themselves.
    """
    n, size = len(y), len(scale)
    weight = np.where(y > 0, np.sqrt(max(1.0, n / max(1.0, y.sum()) - 1)), 1.0)
    step = np.searchsorted(ends, np.arange(0, ends[-1] + 1, 500_000)).tolist()
    blocks = [(a, b) for a, b in zip([0, *step[1:]], [*step[1:], n], strict=True) if a < b]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        own, grad, total = w[:-1] * scale, np.zeros(size), l2 / 2 * float((w[:-1] ** 2).sum())
        bias = 0.0
        for a, b in blocks:
            f = feature[ends[a] : ends[b]]
            row = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
            z = np.bincount(row, own[f], b - a) + w[-1]
            g = weight[a:b] * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[a:b])
            grad += np.bincount(f, g[row], size)
            bias += g.sum()
            total += float((weight[a:b] * (np.logaddexp(0, z) - y[a:b] * z)).sum())
        return total, np.append(grad * scale + l2 * w[:-1], bias)

    w = np.zeros(size + 1)
    f, g = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, back = g.copy(), []
        for s, v, r in reversed(steps):
            a = r * (s @ d)
            back.append(a)
            d -= a * v
        if steps:
            s, v, r = steps[-1]
            d *= (s @ v) / (v @ v)
        for (s, v, r), a in zip(steps, reversed(back), strict=True):
            d += s * (a - r * (v @ d))
        t = 1.0 if steps else 1 / max(1.0, np.abs(g).sum())
        while t > 1e-12:
            f2, g2 = loss(w - t * d)
            if f2 <= f - 1e-4 * t * (g @ d):
                break
            t /= 2
        else:
            break
        s, v = -t * d, g2 - g
        if s @ v > 1e-12:
            steps = [*steps[-9:], (s, v, 1 / (s @ v))]
        w, done, f, g = w + s, f - f2 < 1e-6 * max(1.0, abs(f)), f2, g2
        if done:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> Model:
    """Fits on at most sample_rows labelled rows that are not held out.

    An id labelled more than once takes the majority, ties toxic; of rows that repeat an id the text with the least hash
    counts. Null ids and null labels take no part, null texts are empty. The fit takes its rows in the order of their
    hashes, so it doesn't depend on partitions. Empty tables, or labels of one class, give a model that calls nothing
    toxic. Other columns are ignored.
    """
    # written once: both passes read few rows; few tasks, because each sends counts of all buckets
    stored = written(_labelled(id_and_text(docs), labels, sample_rows), "toxicity-sample")
    sample = stored.repartition(8)
    counted = map_arrow(sample, _counts, "piece int, clean binary, toxic binary, n_clean long, n_toxic long")
    sums = counted.groupBy("piece").applyInArrow(_sum, "piece int, clean binary, toxic binary").toArrow()
    seen = np.zeros((2, 256, (1 << BITS) // 256), np.int64)
    for k, a, b in zip(*(sums[c].to_pylist() for c in ("piece", "clean", "toxic")), strict=True):
        seen[:, k] = np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)
    del sums
    seen = seen.reshape(2, -1)
    n = np.array([r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).orderBy("toxic").collect()])
    if len(n) < 2 or not seen.any():
        return Model(np.zeros(0, np.int64), np.zeros(0), -50.0)
    # chi-square of occurrence against class, for buckets in at least three texts
    total = seen.sum(axis=0)
    expected = total * (n[1] / n.sum())
    gain = np.where(total >= 3, (seen[1] - expected) ** 2 / np.maximum(expected * (1 - total / n.sum()), 1e-9), 0)
    kept = np.sort(np.argsort(-gain, kind="stable")[:features])
    kept = kept[gain[kept] > 3.84]  # five per cent
    ratio = np.log((seen[1, kept] + 0.5) / (n[1] + 1)) - np.log((seen[0, kept] + 0.5) / (n[0] + 1))
    number = np.full(1 << BITS, -1, np.int64)
    number[kept] = np.arange(len(kept))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = number >= 0
        for batch in batches:
            for part in slices([batch], "text", STEP_BYTES):
                row, bucket = grams(part.column(1).to_pylist(), wanted=wanted)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).tolist()
                feature = number[bucket].astype("<u2")
                yield pa.RecordBatch.from_arrays([pa.array([feature[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary()), part.column(2), part.column(0)], ["features", "toxic", "key"])

    # written, then read a part at a time: neither half of the driver holds the sample twice
    coded = written(map_arrow(sample, chosen, "features binary, toxic int, key long"), "toxicity-features")
    data = sorted((r.key, bytes(r.features), r.toxic) for r in coded.toLocalIterator())
    drop_written(coded)
    drop_written(stored)
    y = np.array([t for *_, t in data], float)
    ends = np.concatenate([[0], np.cumsum([len(x) // 2 for _, x, _ in data])])
    feature = np.frombuffer(b"".join(x for _, x, _ in data), "<u2")
    del data, seen, total, expected, gain
    release()
    w, bias = logistic(ends, feature, ratio, y)
    del feature, ends
    release()
    return Model(kept, w * ratio, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row.

    Null and empty texts score what the bias alone gives. Rows that repeat are scored each, equal texts alike; a score of
    exactly 0.5 is toxic. An empty table gives an empty result. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for part in slices(batches, "text", STEP_BYTES):
            s = model.scores(part.column(1).to_pylist(), table)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_arrow(id_and_text(docs, id_col, text_col), run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier does not call toxic, with all their columns, repeated rows as often as they come.

    Null texts count as empty; an empty table gives an empty result; no column is added, so names can't clash.
    """
    model = train(docs, labels)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            for part in slices([batch], text_col, STEP_BYTES):
                s = model.scores([t or "" for t in part.column(at).to_pylist()], table)
                yield part.filter(pa.array(s < 0.5))

    return map_arrow(docs, run, docs.schema)
