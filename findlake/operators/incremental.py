"""Keeping results up to date: caches by content, merges of runs, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cache_key(content: Column, rules: Column, *context: Column) -> Column:
    """Content, rules and context, length first, so that no two mixes of parts agree."""
    parts = [content, rules, *context]
    return F.sha2(F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)


def misses(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows whose key (column key) the cache has not."""
    return keyed.join(cache.select("key").distinct(), "key", "left_anti")


def replay(keyed: DataFrame, cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache's rows for the keys at hand and the fresh rows for the others; both have key and the same columns."""
    hits = cache.join(keyed.select("key").distinct(), "key", "left_semi")
    return hits.unionByName(fresh)


def diverged(cached: DataFrame, again: DataFrame) -> DataFrame:
    """Rows on one side only, when a sample is computed again: none if the cache is true."""
    return cached.exceptAll(again).withColumn("side", F.lit("cached")).unionByName(again.exceptAll(cached).withColumn("side", F.lit("fresh")))


def merge_reports(rows: DataFrame) -> DataFrame:
    """One row per id: status and line of the newest report, lists united over all. rows: id, report, status, line, tags (array)."""
    last = F.max_by(F.struct("status", "line"), "report")
    return rows.groupBy("id").agg(last.alias("l"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"), F.count(F.lit(1)).alias("reports")).select("id", "l.status", "l.line", "tags", "reports")


def stale(inputs: DataFrame, built: DataFrame) -> DataFrame:
    """path and why of inputs (path, stamp) that differ from those something was built from."""
    now, then = inputs.select("path", F.col("stamp").alias("now")), built.select("path", F.col("stamp").alias("then"))
    why = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("then"), "changed")
    return now.join(then, "path", "full_outer").withColumn("why", why).where("why is not null").select("path", "why")


def upsert_once(known: DataFrame, verdicts: DataFrame) -> DataFrame:
    """known and those verdicts whose id it has not: a verdict is given once; of several new ones the first by seq."""
    fresh = verdicts.join(known.select("id"), "id", "left_anti").groupBy("id").agg(F.min_by("verdict", "seq").alias("verdict"))
    return known.select("id", "verdict").unionByName(fresh)
