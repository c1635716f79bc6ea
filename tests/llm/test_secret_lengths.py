"""Secrets of any length are found whole."""

from __future__ import annotations

import hashlib
import random
import time

import public_tokenizers
import pytest

from findlake.llm import secret_scan

rnd = random.Random(5)
RUN = lambda k: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
JWT = "eyJ" + RUN(40) + "." + RUN(900) + "." + RUN(86)


@pytest.mark.parametrize(
    ("before", "value", "kind"),
    [
        ("token = ", RUN(600), "assigned"), ("token: ", JWT, "assigned"), ("", JWT, "jwt"), ("", RUN(5_000), "long"), ("", RUN(5_000) + "==", "long"),
        ("", "ghp_" + RUN(300), "github"), ("", "xox" + "b-" + RUN(400), "slack"), ("", "sk_" + "live_" + RUN(120), "stripe"),
        ("", "ghp_" + RUN(36) + "-" + RUN(40), "github"), ("", "k" * 70 + RUN(40) + "7", "long"),
    ],
)
def test_a_candidate_ends_where_its_value_ends(before, value, kind):
    text = f"see {before}{value} there"
    start = text.index(value)
    assert secret_scan.candidates(text) == [(start, start + len(value), kind)]


def test_the_hash_is_of_the_whole_value(spark):
    words = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, f"api_key = {JWT}\n", "src/a.py")], "doc_id long, text string, source string")
    (row,) = secret_scan.scan(docs, secret_scan.Forest([]), words).collect()
    assert row.end - row.start == len(JWT) and row.value_sha256 == hashlib.sha256(JWT.encode()).hexdigest()


@pytest.mark.parametrize("text", ["a" * 400_000, "-" * 400_000, "a=" * 200_000, "a1/" * 100_000 + "===", "token = " + "x" * 400_000, "xox" + "b-" * 200_000])
def test_long_texts_take_little_time(text):
    start = time.perf_counter()
    secret_scan.candidates(text)
    assert time.perf_counter() - start < 5
