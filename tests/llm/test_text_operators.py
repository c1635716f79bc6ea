"""Exact and near copies, repeats, tokens: small fixtures against plain loops."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from findlake.llm import byte_bpe, exact_dedup, repeats, simhash, token_files

SCHEMA = "doc_id long, text string, score string, keep_id string, fp string"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 200))) for _ in range(60)]
    passage = " ".join(rnd.choice(words) for _ in range(90))
    texts += [f"{t[:200]} {passage} {t[200:]}" for t in texts[:20]]
    texts += [t.upper() for t in texts[:10]] + [t + " x" for t in texts[10:20]] + ["", None, "", "one", "two words", "a" * 3000, "ab" * 900, " \n\t ", "Ünï çödé 中文 😀 " * 60, "x\n\n  y z's 12,345.67"]
    out = [(i, t, "s", "k", "f") for i, t in enumerate(texts)]
    return [*out, out[3], (None, "no id", "s", "k", "f"), (None, texts[4], "s", "k", "f")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def lower(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_dedup(docs, rows):
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[lower(t)].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    expected = [(i, best[lower(t)], len(groups[lower(t)]), i == best[lower(t)], hashlib.sha256(lower(t).encode()).hexdigest()) for i, t, *_ in rows]
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs).collect()), key=str) == sorted(expected, key=str)


def test_exact_dedup_keeps_one_whole_row(docs, rows):
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert len(found) == len({lower(t) for _, t, *_ in rows}) == len({lower(r.text) for r in found})


def test_hash_collisions_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "md5", lambda c: F.lit("00" * 16))
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()) == [(1, 2, 2), (2, 2, 2), (3, 3, 1)]


def fingerprint(text: str | None) -> int:
    words = re.findall(rb"[^\x20\x09-\x0d]+", lower(text).encode())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(values: list[int], radius: int) -> dict[int, int]:
    parent = {v: v for v in values}

    def top(v: int) -> int:
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= radius:
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {v: top(v) for v in values}


@pytest.mark.parametrize("bucket", [4096, 2])
def test_simhash(docs, rows, bucket, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (2, bucket))
    fps = [fingerprint(t) for _, t, *_ in rows]
    root = roots(sorted(set(fps)), 2)
    least = {}
    for (i, *_), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    expected = [(i, f if f < 1 << 63 else f - (1 << 64), least.get(root[f])) for (i, *_), f in zip(rows, fps, strict=True)]
    found = simhash.simhash_components(docs).select("doc_id", "fp", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def test_near_dedup_keeps_one_of_each_group(docs):
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    groups = simhash.simhash_components(docs).select("root").distinct().count()
    assert kept.count() == groups


@pytest.mark.parametrize("radius", range(5))
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    v = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    v = np.concatenate([v, v[:80] ^ np.uint64(1), v[:80] ^ np.uint64(0b1011), v[:3]])
    i, j = simhash.close_pairs(v, radius)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if int(v[a] ^ v[b]).bit_count() <= radius}


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(200)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(1, 61)} == {0} and {found[1001 + i] for i in range(200)} == {1000}


def covered(rows, length):
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = collections.Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    for i, b in data:
        marks = np.zeros(len(b) + 1, np.int8)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                marks[k : k + length] = 1
        kept = bytes(c for c, m in zip(b, marks, strict=False) if not m)
        yield i, len(b), int(marks.sum()), int((np.diff(np.concatenate([[0], marks])) == 1).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize(("length", "many"), [(400, 2000), (400, 3), (60, 2000)])
def test_repeats(docs, rows, length, many):
    found = repeats.digest(repeats.repeats(docs, length, many=many)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(covered(rows, length), key=str)


def test_matching_statistics():
    rnd = random.Random(2)
    for _ in range(100):
        text = [rnd.choice([5, 6, 7]) for _ in range(rnd.randint(2, 60))] + [1]
        found = repeats.matching_statistics(np.array(text))
        for i in range(len(text)):
            best = max((next((k for k in range(len(text)) if max(i, j) + k >= len(text) or text[i + k] != text[j + k]), 0) for j in range(len(text)) if j != i), default=0)
            assert found[i] == best


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.ByteBPE(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_bpe_encodes_as_the_library_does(codec, rows):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rnd = random.Random(1)
    alphabet = " \t\n\r\x0b\x1c\x85\xa0 'sdaÉß１2!.,é中😀\x00"
    texts = [t or "" for _, t, *_ in rows] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + ["abcdefghij" * 5000, "<|endoftext|>"]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        for text, ids in zip(part, codec.encode_batch(part), strict=True):
            assert own.encode_ordinary(text) == ids.tolist() and codec.decode(ids.tolist()) == text.encode()


def test_full_caches_change_nothing(codec, rows, monkeypatch):
    texts = [t or "" for _, t, *_ in rows]
    expected = [x.tolist() for x in codec.encode_batch(texts)]
    monkeypatch.setattr(byte_bpe, "KEPT_PIECES", 50)
    assert [codec.encode(t).tolist() for t in texts] == expected
    monkeypatch.setattr(token_files, "KEPT_PIECES", 50)
    library = token_files.LibraryTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert [library.encode([t])[0].tolist() for t in texts] == [library.inner.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_operator(docs, codec, rows):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    one = byte_bpe.round_trip(docs, path, pattern)
    two = byte_bpe.decode(byte_bpe.encode(docs, path, pattern), path, pattern).select(*one.columns)
    expected = sorted(((i, codec.encode(t or "").tolist(), (t or "").encode()) for i, t, *_ in rows), key=str)
    for frame in (one, two):
        assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in frame.collect()), key=str) == expected


@pytest.mark.parametrize("bits", [8, 1])
def test_shards_round_trip(bits):
    rng = np.random.default_rng(bits)
    lengths = [0, 1, 500, 70_000, 3, 0, 65_536]
    ids = rng.integers(0, 1 << 32 if bits == 1 else 50_000, sum(lengths), dtype=np.uint32)
    shard = token_files.Shard(token_files.pack(ids, list(range(7)), lengths, bits))
    at = 0
    for n, (doc, start, found) in zip(lengths, shard.documents(), strict=True):
        assert start == at and (found == ids[at : at + n]).all() and len(found) == n
        at += n
    assert (shard.ids(65_000, 66_000) == ids[65_000:66_000]).all()
    with pytest.raises(ValueError, match="shard"):
        token_files.Shard(b"xxxx" * 9)


def test_token_files(docs, rows, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 500)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = token_files.LibraryTokenizer(path).inner
    known = [(i, t) for i, t, *_ in rows if i is not None]
    found = token_files.encode_to_files(docs.where("doc_id is not null"), path).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted(i for i, _ in known)
    by = collections.defaultdict(list)
    for i, t in known:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        by[i].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at = 0
    for r in found:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in by[r.doc_id]
        at += r.n_tokens


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    assert exact_dedup.exact_dedup(none).isEmpty() and simhash.simhash_components(none).isEmpty() and repeats.repeats(none).isEmpty()
    assert byte_bpe.round_trip(none, path, pattern).isEmpty() and token_files.encode_to_files(none, public_tokenizers.path("byte_bpe_50k.json")).isEmpty()
    assert exact_dedup.drop_exact_copies(none).isEmpty() and simhash.drop_near_copies(none).isEmpty()
