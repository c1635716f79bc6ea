"""Registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.llm import byte_bpe, exact_dedup, html_text, mixing, repeats, secret_scan, simhash, token_files, topk, toxicity
from findlake.llm.common import id_and_text, table

RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
WORDS = "word_bpe_49k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.repeats(table(spark, sf_dir, "documents")))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = public_tokenizers.path(WORDS)
    forest = secret_scan.train(secret_scan.made_table(spark, words), words)
    return secret_scan.scan(table(spark, sf_dir, "documents"), forest, words)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_and_text(table(spark, sf_dir, "documents"))
    return byte_bpe.digest(byte_bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_to_files(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_repeats, op3_secret_scan, op4_exact_dedup, op5_topk, op6_simhash, op7_byte_bpe, op8_html_text, op9_mixing, op10_token_files)}


def oracle_sql() -> dict[str, str]:
    return {"op2_repeats": repeats.REPEATS_SQL, "op4_exact_dedup": exact_dedup.EXACT_DEDUP_SQL, "op5_topk": topk.TOP_K_SQL}
