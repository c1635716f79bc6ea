"""Mixing sources to target weights: min-cost flow over membership patterns, then seeded documents.

Documents fold to one row per membership pattern (the set of sources a document belongs to), so the flow network
has one node per pattern and per source and never a document. A pattern can send each of its words up to
`max_repeats` times; the k-th copy costs k, so flow repeats documents as evenly and as little as the quotas allow.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns and sources that may reach the driver, as one row each. More is an error, not a cut.
MOST_PATTERNS = 50_000
#: Documents of a pattern among which the last copies are settled one by one.
LEAF = 2_000
#: Draws run from 0 up to this.
DRAWS = 1 << 62
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> dict[str | None, float]:
    """Quota of each source: its weight's share of all words, at most `most` times its size, the excess shared again by weight."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, out = dict(order), {}
    left, open_ = float(sum(size.values())), list(weight)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * size[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(most * size[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def route(capacity: list[int], member: list[list[int]], quota: list[int], repeats: int = 3) -> list[list[int]]:
    """Min-cost flow: flow[p][k] words of pattern p go to its k-th source; successive shortest paths with potentials.

    Each word of p can be sent `repeats` times, the j-th copy at cost j. Quotas that the patterns cannot fill stay open.
    """
    n_p, n_s = len(capacity), len(quota)
    start, end, n = 0, n_p + n_s + 1, n_p + n_s + 2
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(n)]

    def edge(a: int, b: int, c: int, w: int) -> int:
        for x, y, cap, price in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            room.append(cap)
            cost.append(price)
        return len(to) - 2

    at = []
    for p in range(n_p):
        for j in range(1, repeats + 1):
            edge(start, 1 + p, capacity[p], j)
        at.append([edge(1 + p, 1 + n_p + s, repeats * capacity[p], 0) for s in member[p]])
    for s in range(n_s):
        edge(1 + n_p + s, end, quota[s], 0)
    high = [0] * n
    while True:
        far, via = [float("inf")] * n, [-1] * n
        far[start], heap = 0, [(0, start)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in out[x]:
                if room[e] and (nd := d + cost[e] + high[x] - high[to[e]]) < far[to[e]]:
                    far[to[e]], via[to[e]] = nd, e
                    heapq.heappush(heap, (nd, to[e]))
        if via[end] < 0:
            return [[room[e ^ 1] for e in es] for es in at]
        top = max(f for f in far if f < float("inf"))
        high = [h + min(f, top) for h, f in zip(high, far, strict=True)]
        path, x = [], end
        while x != start:
            path.append(via[x])
            x = to[via[x] ^ 1]
        flow = min(room[e] for e in path)
        for e in path:
            room[e] -= flow
            room[e ^ 1] += flow


def _settle(need: dict[str, int]):
    """Chooses in seeded order the documents of one pattern that get one more copy, skipping what would overshoot."""

    def leaf(group: pa.Table) -> pa.Table:
        draws, ids, sizes = (group[c].to_pylist() for c in ("draw", "doc_id", "size"))
        left, extra, over = need[group["pattern"][0].as_py()], [0] * len(sizes), None
        for i in sorted(range(len(sizes)), key=lambda i: (draws[i], ids[i] is None, ids[i] or 0, sizes[i])):
            if sizes[i] <= left:
                extra[i], left = 1, left - sizes[i]
            elif over is None or sizes[i] < sizes[over]:
                over = i
        if over is not None and sizes[over] - left < left:  # the least overshoot comes nearer than the gap
            extra[over] = 1
        return group.set_column(group.column_names.index("extra"), "extra", pa.array(extra, pa.int32()))

    return leaf


def _ends(rows: DataFrame, need: dict[str, int], count: dict[str, int]) -> dict[str, tuple[int, int, int]]:
    """Per pattern (low, high, rest): draws below low are taken, those from low up to high settle the rest of the need.

    Sizes add up over buckets of the draw; the bucket in which the need ends is cut again until it holds few documents.
    """
    spark = rows.sparkSession
    ends = {p: (0, DRAWS if n else 0, n) for p, n in need.items()}
    while wide := {p: -(-(ends[p][1] - ends[p][0]) // min(4096, -(-count[p] // (LEAF // 2)))) for p in ends if ends[p][2] and count[p] > LEAF and ends[p][1] - ends[p][0] > 1}:
        cuts = spark.createDataFrame([(p, *ends[p][:2], step) for p, step in wide.items()], "pattern string, low long, high long, step long")
        inside = rows.select("pattern", "draw", "size").join(F.broadcast(cuts), "pattern").where("draw >= low and draw < high")
        sums = inside.groupBy("pattern", F.expr("(draw - low) div step").alias("bucket")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        for p, part in groupby(sums.orderBy("pattern", "bucket").toLocalIterator(), key=lambda r: r["pattern"]):
            low, high, rest = ends[p]
            for r in part:
                a, b = low + r["bucket"] * wide[p], min(low + (r["bucket"] + 1) * wide[p], high)
                if r["size"] > rest:
                    ends[p], count[p] = (a, b, rest), r["n"]
                    break
                rest -= r["size"]
                ends[p], count[p] = (b, b, 0), 0
            for _ in part:  # the next pattern's rows come after these
                pass
    return ends


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 17, overlapping: bool = False) -> DataFrame:
    """Columns row (the input row), doc_id, size (words), copies (0 to `most`), source_size, target.

    With `overlapping`, `source_col` holds an array of sources and a document belongs to each of them; source_size and
    target are then those of its first source in order, and targets share what the sources hold together. A null source
    is a source like any other and sorts last; a null text has size 0 and documents without words are taken once.
    Draws hash seed, id and text, so reruns agree; rows that repeat both are interchangeable. An empty table gives an
    empty result. Other columns only travel inside row, so their names never clash.
    """
    source = F.col(source_col)
    names = F.array_sort(F.array_distinct(F.coalesce(source, F.array(F.lit(None).cast("string"))))) if overlapping else F.array(source.cast("string"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), names.alias("sources"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col, text_col), 2).alias("draw"))
    rows = rows.withColumn("pattern", F.to_json("sources", {"ignoreNullFields": "false"}))
    stats = rows.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(stats) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    stats.sort(key=lambda s: s["pattern"])
    sizes: dict[str | None, int] = {}
    for s in stats:
        for name in s["sources"] or [None]:
            sizes[name] = sizes.get(name, 0) + s["size"]
    quota = targets(list(sizes.items()), weights, most)
    if overlapping and sum(sizes.values()):  # a word is there once, whatever the number of its sources
        quota = {k: v * sum(s["size"] for s in stats) / sum(sizes.values()) for k, v in quota.items()}
    order = {name: i for i, name in enumerate(sizes)}
    flow = route([s["size"] for s in stats], [[order[x] for x in s["sources"] or [None]] for s in stats], [round(quota[x]) for x in order], most)
    whole, need = {}, {}
    for s, f in zip(stats, flow, strict=True):
        whole[s["pattern"]], need[s["pattern"]] = divmod(sum(f), s["size"]) if s["size"] else (1, 0)
    ends = _ends(rows, need, {s["pattern"]: s["n"] for s in stats})
    facts = docs.sparkSession.createDataFrame([(s["pattern"], whole[s["pattern"]], *ends[s["pattern"]][:2], sizes[(s["sources"] or [None])[0]], float(quota[(s["sources"] or [None])[0]])) for s in stats], "pattern string, whole long, low long, high long, source_size long, target double")
    full = rows.join(F.broadcast(facts), "pattern").withColumn("extra", (F.col("draw") < F.col("low")).cast("int"))
    columns = ["row", "doc_id", "size", "draw", "pattern", "whole", "extra", "source_size", "target"]
    open_ = full.where("draw >= low and draw < high").select(columns)
    settled = open_.groupBy("pattern").applyInArrow(_settle({p: e[2] for p, e in ends.items()}), open_.schema)
    both = full.where("draw < low or draw >= high").select(columns).unionByName(settled)
    return both.select("row", "doc_id", "size", (F.col("whole") + F.col("extra")).cast("int").alias("copies"), "source_size", "target")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it, with the columns of docs."""
    taken = mix(docs, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
