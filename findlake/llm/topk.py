"""Exact top-k inner products by a pivot-distance index.

Every vector gets one more coordinate that brings all to one length, so that a greater inner product is a lesser distance.
Vectors are keyed by nearest pivot and distance to it and lie sorted in chunks of bounded size: each chunk is a
piece of an annulus. A first pass scans the chunk around each query in its own cell and gives a k-th score that the
answer can't fall below. By the triangle inequality a vector at distance d from pivot p is at least |d(q, p) - d| from
the query, so the second pass visits only the part of each annulus that can still hold a better score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findlake.llm.common import written

#: Pivots, chosen from a bounded sample (farthest first); the index holds every vector whatever the sample.
#: At least this many, the square root of the number of vectors up to the greatest number.
PIVOTS = 32
MOST_PIVOTS = 512
PIVOT_SAMPLE = 4_096
#: Vectors in a chunk, queries in a block.
CHUNK = 2_048
BLOCK = 512
CHUNKS = "cell int, near double, far double, ids binary, dist binary, vectors binary"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and v (floor of scale times each component, as longs).

    Vectors that are null or hold a null, NaN or infinite component drop out; a finite component that no long holds is an error.
    """
    v = F.col(vector_col).cast("array<double>")
    fit = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.when(F.abs(x * F.lit(float(scale))) < 2.0**63, F.floor(x * F.lit(float(scale)))).otherwise(F.raise_error(F.lit("a component beyond 64 bits")))
    return vectors.where(fit).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, whole).alias("v"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of longs, shorter ones padded with zeros."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    lengths = np.diff(ends)
    if len(lengths) and (lengths == width).all():
        return flat[ends[0] : ends[-1]].reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    for i, (a, n) in enumerate(zip(ends.tolist(), lengths.tolist(), strict=False)):
        out[i, :n] = flat[a : a + n]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products, by floating point where no sum can leave its exact range; one that no long holds is an error."""
    top = np.abs(a.astype(np.float64)).max(initial=0) * np.abs(b.astype(np.float64)).max(initial=0) * a.shape[1]
    if top < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < 2**63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    if max(map(abs, exact.flat), default=0) >= 2**63:
        raise OverflowError("inner products beyond 64 bits")
    return exact.astype(np.int64)


def _distances(v: np.ndarray, pivots: np.ndarray, square: float) -> np.ndarray:
    """From each row of v, brought to the common length, to each pivot (already with its last coordinate)."""
    x = v.astype(np.float64)
    last = np.sqrt(np.maximum(square - (x * x).sum(axis=1), 0))
    near = square + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots[:, :-1].T + last[:, None] * pivots[None, :, -1])
    return np.sqrt(np.maximum(near, 0))


def choose_pivots(rows: np.ndarray, square: float, n: int) -> np.ndarray:
    """Farthest-first pivots among the sample's rows, at least one."""
    x = rows.astype(np.float64)
    full = np.concatenate([x, np.sqrt(np.maximum(square - (x * x).sum(axis=1), 0))[:, None]], axis=1)
    chosen = [0]
    far = ((full - full[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(full)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((full - full[chosen[-1]]) ** 2).sum(axis=1))
    return full[chosen]


def build_index(vectors: DataFrame, width: int, square: float, pivots: np.ndarray, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk: cell, least and greatest distance to its pivot, and the ids, distances and vectors, packed.

    Range partitions by (cell, distance, id) hold any cell, however full, in many tasks.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_matrix(batch.column(1), width), pivots, square)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]), batch.column(0), batch.column(1)], ["cell", "dist", "vec_id", "v"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple[np.ndarray, ...]] = []

        def close() -> pa.RecordBatch:
            cell, dist, ids, v = (np.concatenate(x) for x in zip(*open_, strict=True))
            row = [pa.array([int(cell[0])], pa.int32()), pa.array([dist[0]]), pa.array([dist[-1]]), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, dist, v))]
            return pa.RecordBatch.from_arrays(row, ["cell", "near", "far", "ids", "dist", "vectors"])

        for batch in batches:
            cell, dist, ids = (batch.column(i).to_numpy() for i in range(3))
            v = _matrix(batch.column(3), width)
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                while a < b:
                    if open_ and open_[0][0][0] != cell[a]:
                        yield close()
                        open_ = []
                    take = min(b - a, chunk - sum(len(x[0]) for x in open_))
                    open_.append((cell[a : a + take], dist[a : a + take], ids[a : a + take], v[a : a + take]))
                    a += take
                    if sum(len(x[0]) for x in open_) == chunk:
                        yield close()
                        open_ = []
        if open_:
            yield close()

    rows = vectors.mapInArrow(keyed, "cell int, dist double, vec_id long, v array<long>")
    return rows.repartitionByRange("cell", "dist", "vec_id").sortWithinPartitions("cell", "dist", "vec_id").mapInArrow(packed, CHUNKS)


def _best(q_ids: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> pa.RecordBatch:
    """The k best of a chunk for each query, ties to the smaller id, none below the query's floor; never the query itself."""
    out_q, out_i, out_s = [], [], []
    for i, q in enumerate(q_ids.tolist()):
        ok = np.flatnonzero((scores[i] >= floor[i]) & (ids != q))
        if len(ok) > k:
            part = scores[i, ok]
            ok = ok[part >= np.partition(part, len(part) - k)[len(part) - k]]
        if len(ok) > k:
            ok = ok[np.lexsort((ids[ok], -scores[i, ok]))[:k]]
        out_q.append(np.full(len(ok), q))
        out_i.append(ids[ok])
        out_s.append(scores[i, ok])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (out_q, out_i, out_s)], ["query_id", "vec_id", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, n_pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k greatest integer inner products of each query with all other rows.

    Components become floor(scale * x). Queries are the rows for which is_query (over vec_id) holds. Vectors that are
    null or hold null or non-finite components take no part; shorter vectors count as padded with zeros, so an empty
    one scores 0 with all; a score that no long holds is an error. Ties go to the smaller vec_id. A row is not its own candidate: rows that share the query's
    id are left out. Null ids take no part. Empty tables give an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = written(quantised(vectors, id_col, vector_col, scale).where("vec_id is not null"), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    width, square, n = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0)), F.count(F.lit(1))).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], result)
    width = max(width, 1)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("v").toArrow()
    pivots = choose_pivots(_matrix(sample["v"].combine_chunks(), width), square, max(n_pivots, min(MOST_PIVOTS, math.isqrt(n))))
    # numbered before they are written, so that every later scan sees the same numbers
    chunks = written(build_index(rows, width, square, pivots).withColumn("chunk", F.monotonically_increasing_id()), "pivot-chunks")
    # queries travel in packed blocks of one cell's neighbours, so that a block's distances to every pivot lie close together
    queries = rows.where(is_query)
    blocks = written(build_index(queries, width, square, pivots, BLOCK).select("cell", "near", "far", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")).withColumn("block", F.monotonically_increasing_id()), "query-blocks")
    unpack = lambda b, kind: np.frombuffer(b, kind)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("q_ids", "q_vectors", "ids", "dist", "vectors", "cell", "floor")
        for batch in batches:
            for q_ids, q_v, ids, dist, v, cell, floor in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True):
                q_ids, ids, dist = unpack(q_ids, np.int64), unpack(ids, np.int64), unpack(dist, np.float64)
                q_v, v = unpack(q_v, np.int64).reshape(-1, width), unpack(v, np.int64).reshape(-1, width)
                least = np.full(len(q_ids), -(1 << 63)) if floor is None else unpack(floor, np.int64)
                a, b = np.zeros(len(q_ids), np.int64), np.full(len(q_ids), len(ids))
                if floor is not None:
                    reach, at = _reach(q_v, least, square), _distances_from(q_v, pivots[cell], square)
                    a, b = np.searchsorted(dist, at - reach, "left"), np.searchsorted(dist, at + reach, "right")
                live = np.flatnonzero(a < b)
                if len(live):
                    lo, hi = int(a[live].min()), int(b[live].max())
                    yield _best(q_ids[live], products(q_v[live], v[lo:hi]), ids[lo:hi], k, least[live])

    found = "query_id long, vec_id long, score long"
    # the two chunks of its cell that lie nearest to a block's own annulus
    close = Window.partitionBy("block").orderBy("gap", "chunk")
    pairs = blocks.select("block", "cell", "near", "far").join(chunks.select("cell", "chunk", F.col("near").alias("c_near"), F.col("far").alias("c_far")), "cell")
    pairs = pairs.withColumn("gap", F.greatest(F.col("c_near") - F.col("far"), F.col("near") - F.col("c_far"), F.lit(0.0))).withColumn("turn", F.row_number().over(close)).where("turn <= 2").select("block", "chunk")
    first = blocks.join(pairs, "block").drop("cell", "near", "far").join(chunks.drop("near", "far"), "chunk").withColumn("floor", F.lit(None).cast("binary")).mapInArrow(scan, found)
    floors = _ranked(first, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).select("query_id", "floor")
    floors = written(floors, "query-floors")

    # each block with its queries' floors and, per pivot, the distances that its queries can still need
    def reaches(group: pa.Table) -> pa.Table:
        head = group.slice(0, 1)
        ids = unpack(head["q_ids"][0].as_py(), np.int64)
        known = {q: f for q, f in zip(group["query_id"].to_pylist(), group["floor"].to_pylist(), strict=True) if q is not None and f is not None}
        floor = np.array([known.get(q, -(1 << 63)) for q in ids.tolist()], np.int64)
        q_v = unpack(head["q_vectors"][0].as_py(), np.int64).reshape(-1, width)
        reach = _reach(q_v, floor, square)
        at = np.stack([_distances_from(q_v, p, square) for p in pivots], axis=1)
        low, high = (at - reach[:, None]).min(axis=0), (at + reach[:, None]).max(axis=0)
        n = len(pivots)
        return pa.table({"block": pa.array([head["block"][0].as_py()] * n, pa.int64()), "cell": pa.array(np.arange(n, dtype=np.int32)), "low": pa.array(low), "high": pa.array(high), "floor": pa.array([floor.tobytes()] * n, pa.binary())})

    of_query = blocks.select("block", "q_ids", "q_vectors")
    members = blocks.select("block", F.col("q_ids").alias("packed")).mapInArrow(_members, "block long, query_id long")
    with_floor = members.join(floors, "query_id", "left").join(of_query, "block")
    needed = with_floor.groupBy("block").applyInArrow(reaches, "block long, cell int, low double, high double, floor binary")
    visits = needed.join(chunks.select("cell", "chunk", "near", "far"), "cell").where("near <= high and far >= low").select("block", "chunk", "floor")
    second = visits.join(blocks.select("block", "q_ids", "q_vectors"), "block").join(chunks.drop("near", "far"), "chunk").mapInArrow(scan, found)
    return _ranked(second, k).select("query_id", "rank", "vec_id", "score")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(ids)], ["block", "query_id"])


def _distances_from(q: np.ndarray, pivot: np.ndarray, square: float) -> np.ndarray:
    """From queries, whose own last coordinate is zero, to one pivot."""
    x = q.astype(np.float64)
    return np.sqrt(np.maximum((x * x).sum(axis=1) + (pivot * pivot).sum() - 2 * (x @ pivot[:-1]), 0))


def _reach(q: np.ndarray, floor: np.ndarray, square: float) -> np.ndarray:
    """How far from a query a vector that scores its floor can be; a little more for rounding, which grows with the lengths."""
    x = q.astype(np.float64)
    longest = (x * x).sum(axis=1) + square
    return np.sqrt(np.maximum(longest - 2 * floor.astype(np.float64), 0)) + 2e-6 * np.sqrt(longest) + 1e-3


TOP_K_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 10
"""
