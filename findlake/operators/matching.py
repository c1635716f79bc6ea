"""Joins that match findings with places, labels, declarations and each other."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findlake.functions.text import STOP_WORDS, ancestors


def in_scope(findings: DataFrame, paths: DataFrame) -> DataFrame:
    """Findings without a path or with a known one."""
    known = paths.select(F.col("path").alias("__path")).distinct()
    return findings.where("path = ''").unionByName(findings.where("path <> ''").join(known, F.col("path") == F.col("__path"), "left_semi"))


def longest_prefix(rows: DataFrame, key: str, prefixes: DataFrame, value: str, default: float) -> DataFrame:
    """value of the exact key, else of the longest prefix, else the default. prefixes: prefix, value; the keys are folded first.

    Every prefix of a key is one row of an equi join, so the prefix table may be of any size.
    """
    keys = rows.select(F.col(key).alias("__key")).distinct()
    cut = keys.select("__key", F.explode(F.sequence(F.lit(0), F.length("__key"))).alias("__n")).select("__key", F.expr("substring(__key, 1, __n)").alias("prefix"))
    best = cut.join(prefixes, "prefix").groupBy("__key").agg(F.max_by(value, F.length("prefix")).alias(value))
    return rows.join(best, F.col(key) == F.col("__key"), "left").drop("__key").withColumn(value, F.coalesce(value, F.lit(default)))


def nearest_ancestor(rows: DataFrame, path: str, folders: DataFrame, folder: str) -> DataFrame:
    """The deepest of some folders that lies above each path, null where none does; by equi join on every ancestor."""
    up = rows.select(path).distinct().select(path, F.posexplode(ancestors(F.col(path))).alias("__up", folder))
    best = up.join(folders.select(folder).distinct(), folder).groupBy(path).agg(F.min_by(folder, "__up").alias(folder))
    return rows.join(best, path, "left")


def cluster_sites(findings: DataFrame, keys: list[str], line: str = "line", detector: str = "detector", tolerance: int = 3) -> DataFrame:
    """Sites: keys, anchor, detectors (sorted). A site takes what lies within the tolerance of its anchor, not of its neighbour.

    The fold over the sorted distinct lines of one key carries the open anchor; findings then join their anchor's list.
    """
    lines = findings.groupBy(*keys).agg(F.sort_array(F.collect_set(F.col(line).cast("long"))).alias("__lines"))
    grown = F.aggregate("__lines", F.array().cast("array<bigint>"), lambda a, x: F.when((F.size(a) > 0) & (x - F.element_at(a, -1) <= tolerance), a).otherwise(F.concat(a, F.array(x))))
    anchors = lines.select(*keys, grown.alias("__anchors"))
    placed = findings.join(anchors, keys).withColumn("anchor", F.array_max(F.filter("__anchors", lambda a: a <= F.col(line))))
    return placed.groupBy(*keys, "anchor").agg(F.sort_array(F.collect_set(detector)).alias("detectors"), F.count(F.lit(1)).alias("members"))


def inside(points: DataFrame, spans: DataFrame, keys: list[str], tolerance: int = 0, how: str = "inner") -> DataFrame:
    """points (keys, line) joined with spans (keys, start_line, end_line) whose lines hold them, give or take the tolerance.

    With how "right", spans without a point stay. One equi join on the keys; the lines are a condition on its rows.
    """
    s = spans.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(c) for c in spans.columns if c not in keys])
    on = (F.col("line") >= F.col("start_line") - tolerance) & (F.col("line") <= F.col("end_line") + tolerance)
    for k in keys:
        on &= F.col(k) == F.col(f"__{k}")
    return points.join(s, on, how)


def innermost(points: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Each point's shortest enclosing span: keys, line, name (null without one)."""
    at = [*keys, "line"]
    size = F.struct(F.col("end_line") - F.col("start_line"), F.col("start_line"), F.col("name"))
    return inside(points, spans, keys, how="left").groupBy(*at).agg(F.min_by("name", F.when(F.col("name").isNotNull(), size)).alias("name"))


def merge_plan_over_source(resources: DataFrame) -> DataFrame:
    """Planned resources in place of the source's of the same repository and base address, with the source's origin."""
    base = F.regexp_replace("address", r"\[[^\]]*\]", "")
    rows = resources.withColumn("base", base)
    plan, source = rows.where("planned"), rows.where("not planned")
    origin = source.select("repo_id", "base", F.col("source").alias("__origin")).groupBy("repo_id", "base").agg(F.min("__origin").alias("__origin"))
    better = plan.join(origin, ["repo_id", "base"], "left").withColumn("source", F.coalesce("__origin", "source")).drop("__origin")
    rest = source.join(plan.select("repo_id", "base").distinct(), ["repo_id", "base"], "left_anti")
    return better.unionByName(rest).drop("base")


def fold_siblings(resources: DataFrame) -> DataFrame:
    """Parents with the properties that sibling resources (which refer to them) carry. resources: address, native, properties (map), refers."""
    children = resources.where("refers is not null").select(F.col("refers").alias("__parent"), F.col("native").alias("__native"), F.struct("address", "properties").alias("__own"))
    given = children.groupBy("__parent").agg(F.array_sort(F.collect_list("__own"), lambda x, y: F.when(x["address"] < y["address"], -1).otherwise(1)).alias("__own"))
    merged = F.aggregate("__own", F.col("properties"), lambda a, c: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(c["properties"], k)), c["properties"]))
    joined = resources.join(given, F.col("address") == F.col("__parent"), "left")
    return joined.withColumn("properties", F.when(F.col("__own").isNull(), F.col("properties")).otherwise(merged)).drop("__own", "__parent")


def conflicting(constants: DataFrame, keys: list[str], owner: str, value: str) -> DataFrame:
    """Names whose value differs between owners: the values and how many owners."""
    out = constants.groupBy(*keys).agg(F.countDistinct(value).alias("values"), F.countDistinct(owner).alias("owners"))
    return out.where("values > 1 and owners > 1")


def fall_back(references: DataFrame, tiers: Iterable[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """The first tier that resolves each reference. A tier: name, table (target and its key columns), keys.

    A tier counts only where exactly one target answers; references: ref and every key column. All tiers are joined
    and ranked at once.
    """
    found = None
    for i, (name, table, keys) in enumerate(tiers):
        one = table.groupBy(*keys).agg(F.min("target").alias("target"), F.countDistinct("target").alias("__n")).where("__n = 1").drop("__n")
        part = references.join(one, keys).select("ref", "target", F.lit(name).alias("how"), F.lit(i).alias("__rank"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("ref").agg(F.min_by(F.struct("target", "how"), "__rank").alias("hit"))
    return references.select("ref").distinct().join(best, "ref", "left").select("ref", "hit.target", F.coalesce("hit.how", F.lit("unresolved")).alias("how"))


def _words(text: str) -> set[str]:
    import re

    return {w for w in re.split("[^a-z0-9]+", text.lower()) if len(w) > 2 and w not in STOP_WORDS}


def _batched(rows: DataFrame, keys: list[str], settle: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """settle(*keys, sorted rows) of every group of keys; many groups share an Arrow batch, and one group is in memory at a time.

    More tasks than the session's partitions if need be, since the groups cost more than their bytes show.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64() if c.split()[1] == "long" else pa.string() for c in schema.split(", ")]
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*[c for c in rows.columns if c not in keys]))).alias("rows"))
    n = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                *at, listed = (c[i].as_py() for c in batch.columns)
                out += settle(*at, [tuple(r.values()) for r in listed])
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return grouped.repartition(n, *keys).mapInArrow(run, schema)


def _file_pairs(tolerance: int, threshold: float):
    def pairs(_: str, path: str, rows: list[tuple]) -> list[tuple]:
        """rows: side (0 for a), seq, start_line, title, rule_id. Lines and sets of words are looked up, so no finding is held against all."""
        a, b = [r[1:] for r in rows if r[0] == 0], [r[1:] for r in rows if r[0] == 1]
        lines, used, out, left = defaultdict(deque), set(), [], []
        for k, g in enumerate(b):
            if g[1]:
                lines[g[1]].append(k)
        for f in a:
            near = [lines[at][0] for at in range(f[1] - tolerance, f[1] + tolerance + 1) if lines.get(at)] if path and f[1] else []
            if near:
                k = min(near)
                lines[b[k][1]].popleft()
                used.add(k)
                out.append((f[0], b[k][0], "location"))
            else:
                left.append(f)
        said = cache(lambda title, rule: frozenset(_words(f"{title} {rule.split('/')[-1]}")))
        same, holding = defaultdict(deque), defaultdict(set)
        for k, g in enumerate(b if left else []):
            if k not in used and (theirs := said(*g[2:])):
                same[theirs].append(k)
                for word in theirs:
                    holding[word].add(theirs)
        for f in left:
            mine = said(*f[2:])
            top, k, theirs = max(((len(mine & o) / len(mine | o), -same[o][0], o) for o in {o for w in mine for o in holding.get(w, ()) if same[o]}), key=lambda x: x[:2], default=(0.0, 0, None))
            if theirs is not None and top >= threshold:
                same[theirs].popleft()
                used.add(-k)
                out.append((f[0], b[-k][0], "wording"))
            else:
                out.append((f[0], None, "only_a"))
        return out + [(None, g[0], "only_b") for k, g in enumerate(b) if k not in used]

    return pairs


def compare(a: DataFrame, b: DataFrame, tolerance: int = 2, threshold: float = 0.5) -> DataFrame:
    """a, b (seq of either side, null for none), how: each finding used once, by fingerprint, then place, then wording.

    Fingerprints pair by their number among equals, as one equi join. What is left pairs inside one file, greedily in
    order of seq, so a group is never more than one file's findings.
    """
    nth = Window.partitionBy("id").orderBy("seq")
    columns = ["seq", "repo_id", "path", "start_line", "title", "rule_id"]
    x = a.select("id", *columns).withColumn("k", F.row_number().over(nth))
    y = b.select("id", *columns).withColumn("k", F.row_number().over(nth))
    y = y.select(*[F.col(c).alias(f"b_{c}") for c in y.columns])
    both = x.join(y, (F.col("id") == F.col("b_id")) & (F.col("k") == F.col("b_k")), "full_outer")
    same = both.where("id is not null and b_id is not null").select(F.col("seq").alias("a"), F.col("b_seq").alias("b"), F.lit("fingerprint").alias("how"))
    rest_a = both.where("b_id is null").select(*[F.col(c).alias(c) for c in columns])
    rest_b = both.where("id is null").select(*[F.col(f"b_{c}").alias(c) for c in columns])
    side = lambda df, k: df.select("repo_id", "path", F.lit(k).alias("side"), "seq", "start_line", "title", "rule_id")
    rest = _batched(side(rest_a, 0).union(side(rest_b, 1)), ["repo_id", "path"], _file_pairs(tolerance, threshold), "a long, b long, how string")
    return same.unionByName(rest)


def _consume(_: str, rows: list[tuple]) -> list[tuple]:
    """rows: side (0 for an item), ord or seq, item, match, rule_id, title, dimension. Items that ask the same share one list and go on where the last one stopped."""
    items = sorted((r for r in rows if r[0] == 0), key=lambda r: r[1] is None)  # without a number last
    found, used, asked, out = [r for r in rows if r[0] == 1], set(), {}, []
    text = [f"{r[4]} {r[5]}".lower() for r in found] if items else []
    for _, _, item, match, _, _, dimension in items:
        if (match, dimension) not in asked:
            needles = [n.strip() for n in (match or "").lower().split("&")]
            asked[match, dimension] = deque(k for k, t in enumerate(text) if all(n in t for n in needles) and (not dimension or found[k][6] == dimension))
        free = asked[match, dimension]
        while free and free[0] in used:
            free.popleft()
        if free:
            used.add(free[0])
        out.append((item, found[free.popleft()][1] if free else None))
    return out


def ground_truth(expected: DataFrame, findings: DataFrame) -> DataFrame:
    """item and the seq of the finding that it consumes (null: missed); an item names a path, so groups are single files. Items of equal ord go by name."""
    none = F.lit(None).cast("string")
    items = expected.select("path", F.lit(0).alias("side"), F.col("ord").cast("long").alias("at"), "item", "match", none.alias("rule_id"), none.alias("title"), "dimension")
    rows = findings.select("path", F.lit(1), "seq", none, none, "rule_id", "title", "dimension")
    return _batched(items.union(rows), ["path"], _consume, "item string, seq long")
