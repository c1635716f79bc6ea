"""Texts that hold one long match of the pre-tokenizer's pattern."""

from __future__ import annotations

import public_tokenizers
import pytest

from findlake.llm import byte_bpe

LONG = ["-" * 70, "=" * 65, "1" * 70, "中" * 70, "ж" * 70, "ж" * 70 + ".", " " + "中" * 70]


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.ByteBPE(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.mark.parametrize("text", LONG)
def test_a_long_match_is_encoded(codec, text):
    want = [i for m in codec.findall(text) for i in codec.piece(m.encode())]
    for whole in (text, f"a {text} b", f"{text}\n{text}"):
        expected = [i for m in codec.findall(whole) for i in codec.piece(m.encode())]
        assert codec.encode(whole).tolist() == expected and codec.decode(expected).decode() == whole
    assert codec.encode_batch([text, "x", text])[2].tolist() == want
    assert not any(len(c) > byte_bpe.KEPT_LENGTH for c in codec.kept)


def test_round_trip_of_long_matches(spark):
    docs = spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string")
    found = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in found} == dict(enumerate(LONG))
