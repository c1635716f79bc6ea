"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, so that other columns never clash; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of its own only where the session names none and all runs on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="findlake-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/findlake-{what}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder and reads them back, so a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._findlake_path = path  # lets an iterative operator drop what it has replaced
    return out


def drop_written(df: DataFrame) -> None:
    if path := getattr(df, "_findlake_path", None):
        drop_path(df.sparkSession, path)


def slices(batches: Iterator[pa.RecordBatch], size_of: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that the named column holds about `most` bytes (of lists, values) in each, or one row."""
    for batch in batches:
        col = batch.column(size_of)
        length = pc.list_value_length if pa.types.is_list(col.type) else pc.binary_length
        lengths = length(col).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(lengths.tolist()):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def split_join(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, groups: int = 4_096) -> DataFrame:
    """rows joined to facts (one written row a key; its column `count` is the number of rows of that key), hot keys without a shuffle.

    Keys that hold more than one part in `groups` of all rows are fewer than `groups`, whatever the data, so their facts
    can go to every task; the other keys meet in a shuffle in which none is larger than that part.
    """
    total = facts.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    most = max(total // groups, 1_000)
    hot = facts.where(F.col(count) > most)
    cold = rows.join(facts.where(F.col(count) <= most), keys)
    if hot.isEmpty():
        return cold
    return cold.unionByName(rows.join(F.broadcast(hot), keys))


def release() -> None:
    """Gives freed memory back to the system, so that workers that wait hold little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow for functions that take much memory a batch: it is released after each batch and at the end."""

    def spent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            release()

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(spent(batches))
        release()

    return df.mapInArrow(released, schema)


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list:
    """Columns doc_id and th (hash of the text) that name a row up to rows that repeat both."""
    return [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th")]


def free_name(name: str, columns: list[str]) -> str:
    """The name, lengthened until no column has it in any spelling."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, whole, that the (doc_id, th) rows of kept name; of rows that repeat both id and text one."""
    doc_id, th = row_key(docs, id_col, text_col)
    own = free_name("kept", docs.columns)
    names = kept.select(F.struct(F.col("doc_id"), F.col("th")).alias(own))
    out = docs.join(names, F.struct(doc_id, th) == F.col(own), "left_semi")
    again = docs.select(doc_id, th).groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return out if again.isEmpty() else out.dropDuplicates([id_col, text_col])
