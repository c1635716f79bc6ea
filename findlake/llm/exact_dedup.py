"""Exact de-duplication with DataFrame functions only.

Rows group by a 128-bit content hash; inside a hash group the texts themselves are compared, so two texts
with one hash stay apart. Partial aggregation folds a hot text to one row per map task before anything moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.llm.common import LOWER, id_and_text, keep_rows, row_key


def normalised(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, *LOWER)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z. `keep` names which id of a group stays
    ("smallest" or "largest"). Null text counts as empty, so null and empty texts form one group. A null id never
    wins against an id and is only kept where its whole group has none. Rows that repeat both id and text are
    interchangeable and are marked alike. An empty table gives an empty result; other columns are ignored.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    rows = id_and_text(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("text"))
    # the texts are grouping columns beside the hash: that compares bytes inside a hash group
    classes = rows.groupBy(F.unhex(F.md5("text")).alias("hash"), "text").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    classes = classes.select("hash", F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size")
    keys = rows.select("doc_id", F.unhex(F.md5("text")).alias("hash"), F.unhex(F.sha2("text", 256)).alias("sha"))
    out = keys.join(classes, ["hash", "sha"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts the row with the largest id."""
    rows = docs.select(*row_key(docs, id_col, text_col), normalised(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    kept = rows.groupBy(F.md5("text"), "text").agg(F.max(F.struct("doc_id", "th")).alias("kept")).select("kept.*")
    return keep_rows(docs, kept, id_col, text_col)


EXACT_DEDUP_SQL = """
WITH rows AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
), classes AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM rows JOIN classes USING (norm)
"""
