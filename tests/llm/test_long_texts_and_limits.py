"""Texts of tens of MB, hot buckets, and values that earlier versions cut off or lost."""

from __future__ import annotations

import random
import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from findlake.llm import html_text, repeats, simhash, token_files, topk, toxicity
from findlake.llm.common import keep_rows, split_join


def grew(call) -> float:
    """MB by which the greatest memory of this process grew."""
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    call()
    return (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024


@pytest.fixture(scope="module")
def long_text():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 9))) for _ in range(5000)]
    return " ".join(rnd.choices(words, k=3_500_000))[:20_000_000]


def test_grams_of_20_mb_take_bounded_memory(long_text):
    assert grew(lambda: toxicity.grams([long_text])) < 250


def test_fingerprint_of_20_mb_takes_bounded_memory(long_text):
    assert grew(lambda: simhash.fingerprint(long_text)) < 250


def test_grams_do_not_depend_on_the_step(monkeypatch):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab \n\tÉ中😀") for _ in range(rnd.randint(0, 80))) for _ in range(200)] + ["", " "]
    one = toxicity.grams(texts)
    monkeypatch.setattr(toxicity, "STEP_BYTES", 31)
    for x, y in zip(one, toxicity.grams(texts), strict=True):
        assert (x == y).all()
    for i, text in enumerate(texts):
        clean = " " + " ".join(text.lower().split()) + " "
        n = len({clean[k : k + n] for n in toxicity.ORDERS for k in range(len(clean) - n + 1)})
        assert n - 2 <= (one[0] == i).sum() <= n  # two n-grams may share a bucket


def test_fingerprint_does_not_depend_on_the_step(monkeypatch):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab \n\té") for _ in range(rnd.randint(0, 300))) for _ in range(200)]
    one = [simhash.fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "STEP_BYTES", 5)
    assert one == [simhash.fingerprint(t) for t in texts]


def test_windows_do_not_depend_on_the_piece(monkeypatch):
    rnd = random.Random(3)
    data = bytes(rnd.choice(b"ab") for _ in range(9000)) + b"x" * 5000
    h, first, n, _ = repeats.anchors(data)
    monkeypatch.setattr(repeats, "PIECE", 1000)
    h2, first2, n2, _ = repeats.anchors(data)
    assert (np.repeat(h, n) == np.repeat(h2, n2)).all() and n.sum() == n2.sum() == len(data) - 399 and max(n.max(), n2.max()) <= 369
    assert len(repeats.anchors(b"a" * 2_000_000)[0]) < 6000


@pytest.mark.parametrize("bucket", [1, 7])
def test_hot_buckets_lose_no_component(spark, bucket):
    rng = np.random.default_rng(bucket)
    core = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    values = {int(c) for c in core}
    for c in core.tolist():
        values |= {c ^ (1 << a) ^ (1 << b) for a, b in rng.integers(0, 64, (60, 2)).tolist()}
    values |= {int(x) for x in rng.integers(0, 1 << 63, 40, dtype=np.uint64)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in values)
    found = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), 2, bucket).collect()

    def groups(pairs):
        root = {x: x for x in fps}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[max(top(a), top(b))] = min(top(a), top(b))
        return {x: top(x) for x in fps}

    near = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    assert groups((r.a, r.b) for r in found) == groups(near)


def test_pairs_side_by_side():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ np.where(rng.random(300) < 0.5, np.uint64(0b1100), np.uint64(0))
    for radius in range(4):
        assert simhash.near(x, y, radius).tolist() == [int(a ^ b).bit_count() <= radius for a, b in zip(x, y, strict=True)]


def test_large_finite_components_take_part(spark):
    rows = [(0, [1e12, 0.5]), (1, [2.0, 1.0]), (2, [-3.0, 4.0]), (3, [float("inf"), 1.0])]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 1)
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [(1, 1, 0, 2048 * 1024 * 10**12 + 1024 * 512), (1, 2, 2, -2048 * 3072 + 1024 * 4096)]
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e200])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()


def test_documents_without_an_id_stay_without_one(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(None, "one"), (-1, "two"), (-5, "three"), (None, None)], "doc_id long, text string")
    found = token_files.encode_to_files(docs, public_tokenizers.path("byte_bpe_50k.json")).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, None, -5, -1] and found[0].start == 0


def test_names_never_clash(spark):
    docs = spark.createDataFrame([(1, "a", 0, 0), (2, "b", 0, 0)], "doc_id long, text string, __kept int, kept int")
    from findlake.llm.exact_dedup import drop_exact_copies
    from findlake.llm.simhash import drop_near_copies

    assert drop_exact_copies(docs).columns == drop_near_copies(docs).columns == docs.columns
    assert keep_rows(docs, docs.selectExpr("doc_id", "xxhash64(text) as th").where("doc_id = 1")).collect()[0].doc_id == 1


def test_hot_keys_join_like_others(spark):
    rows = spark.range(5000).selectExpr("if(id < 3000, 7, id) as k", "id")
    facts = rows.groupBy("k").count()
    assert split_join(rows, facts, ["k"], "count").count() == 5000


ARTICLE = "<article><h1>T</h1><div class='share-price'>Price 5</div><p class='related'>A related finding of ours.</p><math><mi>x</mi></math><div class='share-buttons'><a>Mail</a></div><div class='related'><a>Next one</a></div><div class='comments'>c</div></article>"


def test_blocks_of_the_article_stay():
    assert html_text.named(html_text.lines(ARTICLE)) == ["T", "Price 5", "A related finding of ours.", "x"]
