"""A corpus from raw documents to token ids: toxicity, exact copies, near copies, source weights, tokens.

In every stage a null text counts as empty, a null id or source is a value like any other, an empty table gives an empty
table, and further columns travel along whatever their names. Rows that repeat id and text are exact copies, of which one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from findlake.llm import byte_bpe, exact_dedup, mixing, simhash, toxicity
from findlake.llm.common import drop_written, table, written
from findlake.llm.queries import RANKS


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that a classifier, fitted on labelled rows of docs that aren't held out, scores under 0.5."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row with the largest id."""
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints, the row with the smallest id."""
    return simhash.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, up to three times."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of each row that the mix took."""
    coded = byte_bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return byte_bpe.digest(coded, "ids")


STAGES = [("toxicity", without_toxic), ("exact dedup", without_copies), ("simhash near-dedup", without_near_copies), ("mixing", mixed), ("byte-level bpe", tokens)]

#: The stages train, compare and encode in ways that SQL can't express; the tests hold what each stage keeps, and the ids at
#: the end, against plain loops over what the classifier and the mix decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_written(before)  # of the stages' tables only the last stays while it is read
    return STAGES[-1][1](spark, docs, sf_dir)
