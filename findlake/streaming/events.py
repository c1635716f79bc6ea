"""Structured Streaming over append-only tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from findlake.plans.checkpoint import cut


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/{name}.parque[t]")
    local = [f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"]  # event time is an instant
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in local}) if local else rows


def _folder(spark: SparkSession) -> str:
    if not spark.sparkContext.getCheckpointDir():
        cut(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def run(rows: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, exactly once into a Parquet table, and reads that back."""
    spark, out = rows.sparkSession, _folder(rows.sparkSession)
    query = rows.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


def window_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", by: str = "event_type", at: str = "ts") -> DataFrame:
    """Counts and sums per window and kind; a window is given once, when the watermark has passed it."""
    g = events.withWatermark(at, late).groupBy(F.window(at, size), by)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n", "total")


def sliding_counts(events: DataFrame, size: str, slide: str, late: str, key: str, at: str = "ts") -> DataFrame:
    g = events.withWatermark(at, late).groupBy(F.window(at, size, slide), key)
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, gap: str, late: str, key: str, at: str = "ts") -> DataFrame:
    g = events.withWatermark(at, late).groupBy(F.session_window(at, gap), key)
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def once(events: DataFrame, keys: list[str], late: str, at: str = "ts") -> DataFrame:
    """Drops repeats of the keys within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def limit_rate(events: DataFrame, key: str, most: int, seconds: int, at: str = "ts") -> DataFrame:
    """event_id, key and allowed: at most `most` allowed events of a key in any rolling span; refused ones don't count.

    State is the times of the last allowed events of a key, never more than `most`. It stays for each key as long as the
    stream runs: a watermark that let it go would refuse late events, which are limited here like any others of their batch.
    """
    kind = dict(events.dtypes)[key]

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values([at, "event_id"])
        allowed = []
        for t in rows[at].astype("int64").to_numpy() // 1000 if rows[at].dtype == "datetime64[ns]" else rows[at].astype("datetime64[us]").astype("int64").to_numpy():
            kept = [k for k in kept if t - k < seconds * 1_000_000]
            if ok := len(kept) < most:
                kept.append(int(t))
            allowed.append(ok)
        state.update((kept,))
        yield pd.DataFrame({"event_id": rows["event_id"], key: name[0], "allowed": allowed})

    return events.groupBy(key).applyInPandasWithState(step, f"event_id long, {key} {kind}, allowed boolean", "kept array<long>", "append", GroupStateTimeout.NoTimeout)
