"""Toxicity, secrets, search, pages, mixing and the pipeline."""

from __future__ import annotations

import random
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from conftest import DATA, comparable
from pyspark.sql import functions as F

import corpus_pipeline
from findlake.llm import exact_dedup, html_text, mixing, queries, secret_scan, simhash, topk, toxicity

SCHEMA = "doc_id long, text string, source string, score double"


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 8))) for _ in range(200)]
    docs, labels = [], []
    for i in range(1500):
        toxic = i % 6 == 0
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        if toxic:
            text.insert(rnd.randrange(len(text)), "vilest" + rnd.choice(["", "ly", "ness"]))
        docs.append((i, " ".join(text), "s", 0.0))
        labels.append((i, int(toxic)))
    docs += [(9000, None, None, None), (9001, "", "s", 0.0), (None, "vilest " * 3, "s", 0.0), (5, docs[5][1], "s", 0.0)]
    labels += [(None, 1), (9001, None), (77777, 1), (6, 1)]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_holds_out_and_finds(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    found = toxicity.score(docs, model).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in found if r.doc_id is not None and r.doc_id in truth and truth[r.doc_id] is not None]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in found)


def test_held_out_labels_are_not_learnt(spark, labelled):
    docs, labels = labelled
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.score(docs, toxicity.train(docs, x)) for x in (labels, turned))
    assert comparable(one.toPandas()) == comparable(two.toPandas())


def test_toxicity_without_labels_calls_nothing_toxic(spark, labelled):
    docs, labels = labelled
    assert not toxicity.score(docs, toxicity.train(docs, labels.limit(0))).where("predicted = 1").count()
    assert not toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 1"))).where("predicted = 1").count()
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).isEmpty()


def test_toxicity_accuracy_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    found = queries.op1_toxicity(spark, DATA).where("held_out").join(labels, "doc_id").toPandas()
    assert (found.predicted == found.toxic).mean() > 0.9
    assert queries.op1_toxicity(spark, DATA).count() == docs.count()


def test_secret_scan_tells_secrets_from_others(spark):
    words = public_tokenizers.path(queries.WORDS)
    forest = secret_scan.train(secret_scan.made_table(spark, words, 2000), words)
    made = [(i, text, path, float(label)) for i, (path, text, label) in enumerate(secret_scan.made_findings(600, seed=99, vocabulary=words))]
    docs = spark.createDataFrame([*made, (9000, None, None, None), (9001, "", "s", 0.0), (9002, "x" * 200_000, "s", 0.0)], SCHEMA)
    found = secret_scan.scan(docs, forest, words).collect()
    truth = {i: label for i, _, _, label in made}
    assert np.mean([r.predicted == truth[r.doc_id] for r in found if r.doc_id in truth]) > 0.95
    texts = {i: t for i, t, *_ in made}
    for r in found[:200]:
        if r.doc_id in texts:
            value = texts[r.doc_id][r.start : r.end]
            assert value and value not in r.masked and __import__("hashlib").sha256(value.encode()).hexdigest() == r.value_sha256
    assert secret_scan.scan(docs.limit(0), forest, words).isEmpty()


def test_forest_splits_what_one_feature_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    forest = secret_scan.Forest.fit(x[:1500], y[:1500])
    assert ((forest.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.9


def brute_top_k(rows, k=10):
    import math

    good = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q)
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("chunk", "block"), [(2048, 512), (16, 4)])
def test_top_k(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(topk.build_index, "__defaults__", (chunk,))
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) / 3]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)] + [(400, None), (450, [1.0, None]), (451, [float("nan")] * 8), (452, [float("inf")] * 8), (453, [0.5, 0.25]), (454, []), (500, [2.0] * 8), (None, [1.0] * 8)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rank int, cell int").repartition(3)
    found = topk.top_k(frame, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, found.collect())) == brute_top_k(rows)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).isEmpty()


def test_top_k_with_fewer_candidates(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [0.5]), (2, [-0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(frame, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 512 * 1024), (0, 2, 2, -512 * 1024)]


def test_large_products_stay_exact():
    a = np.array([[2**40, 3]])
    assert topk.products(a, np.array([[2**20, 5]]))[0, 0] == 2**60 + 15
    with pytest.raises(OverflowError):
        topk.products(np.array([[2**60]]), np.array([[2**60]]))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body><nav><a>Home</a></nav><!-- c --><div class="ad">Buy</div>
<header>Site</header><article><header><h1>A &amp;  B</h1></header><p>One<br>two <b>three</b> &#x41;<p>f&ouml;r<aside>side</aside><form>f<input></form><ul><li>x<li>y</ul><div class="comments">c</div></article><footer>F</footer>"""


def test_markup_names_the_article(spark):
    rows = [(1, "http://h/a", PAGE, "t"), (2, None, None, "t"), (3, "http://h/b", "", "t"), (4, "x", "plain text", "t"), (5, "http://h/c", PAGE, "t"), (5, "http://h/c", PAGE, "t"), (6, "http://z/", "<p>a<div hidden>no</div><div style='display:none'>no</div><p>b<noscript>n</noscript>", "t"), (7, "u", "<article>" + "<div>" * 3000 + "deep", "t")]
    found = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    texts = {r.page_id: r.text for r in found}
    assert len(found) == len(rows) and texts[1] == texts[5] == "A & B One two three A för x y" and texts[2] == texts[3] == ""
    assert texts[4] == "plain text" and texts[6] == "a b" and texts[7] == "deep" and all(r.n_chars == len(r.text) for r in found)


@pytest.mark.parametrize("partitions", [1, 7])
def test_neighbours_share_their_frame(spark, partitions):
    rnd = random.Random(6)
    pages = [(i, f"https://h{i % 3}.com/p/{i:03}?q=1#f", f"<div>Welcome to host {i % 3}</div><p>Story {i}</p><p>{rnd.random()}</p><div>Imprint {i % 3}</div>") for i in range(60)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(partitions)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for r in html_text.main_text(frame).collect():
            assert r.text.startswith(f"Story {r.page_id} ") and "Welcome" not in r.text and "Imprint" not in r.text
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_longest_common_subsequence():
    def length(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in product(range(len(a)), range(len(b))):
            t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    rnd = random.Random(8)
    for _ in range(300):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randrange(12))] for _ in range(2))
        marked = [x for x, m in zip(a, html_text.shared(np.array(a, np.int64), np.array(b, np.int64)), strict=True) if m]
        rest = iter(b)
        assert len(marked) == length(a, b) and all(x in rest for x in marked)


def cheapest(capacity, member, quota, repeats):
    """Greatest flow and its least cost, by trying every split."""
    best = (-1, 0)
    for flow in product(*[range(repeats * c + 1) for c, m in zip(capacity, member, strict=True) for _ in m]):
        at, sent, into, cost = 0, [], [0] * len(quota), 0
        for m in member:
            part = flow[at : at + len(m)]
            at += len(m)
            sent.append(sum(part))
            for s, f in zip(m, part, strict=True):
                into[s] += f
        if any(x > repeats * c for x, c in zip(sent, capacity, strict=True)) or any(x > q for x, q in zip(into, quota, strict=True)):
            continue
        for x, c in zip(sent, capacity, strict=True):
            cost += sum(j * min(c, max(0, x - (j - 1) * c)) for j in range(1, repeats + 1))
        best = max(best, (sum(sent), -cost))
    return best


def test_route_is_a_min_cost_flow():
    rnd = random.Random(9)
    for _ in range(25):
        capacity = [rnd.randint(0, 3) for _ in range(2)]
        member, quota = [[0], [0, 1]], [rnd.randint(0, 6), rnd.randint(0, 6)]
        flow = mixing.route(capacity, member, quota, 2)
        sent = [sum(f) for f in flow]
        cost = sum(j * min(c, max(0, x - (j - 1) * c)) for x, c in zip(sent, capacity, strict=True) for j in (1, 2))
        assert (sum(sent), -cost) == cheapest(capacity, member, quota, 2)


def test_targets_stop_at_three_times_the_size():
    found = mixing.targets([("b", 100), ("a", 10), (None, 1000), ("c", 0)])
    assert found["a"] == 30 and found["c"] == 0 and sum(found.values()) == pytest.approx(1110) and found["b"] <= 300


@pytest.mark.parametrize("leaf", [2000, 10])
def test_mix(spark, monkeypatch, leaf):
    monkeypatch.setattr(mixing, "LEAF", leaf)
    rnd = random.Random(10)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 30)), rnd.choice(["a", "a", "a", "b", "c", None]), 0.5) for i in range(600)] + [(9000, None, "a", None), (9001, "\x0b\t x", "é", 1.0), (3, "w w w", "a", 1.0), (3, "w w w", "a", 1.0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    one = mixing.mix(docs).select("doc_id", "row.source", "size", "copies", "source_size", "target").collect()
    assert sorted(map(str, one)) == sorted(map(str, mixing.mix(docs.repartition(7)).select("doc_id", "row.source", "size", "copies", "source_size", "target").collect()))
    assert len(one) == len(rows) and all(0 <= r.copies <= 3 for r in one)
    for source in {r.source for r in one}:
        mine = [r for r in one if r.source == source]
        taken = sum(r.size * r.copies for r in mine)
        assert mine[0].source_size == sum(r.size for r in mine) and abs(taken - mine[0].target) <= 4
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in one)
    assert mixing.mix(docs.limit(0)).isEmpty()


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else ["b"]) for i in range(90)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"), overlapping=True).collect()
    assert len(found) == 90 and abs(sum(r.size * r.copies for r in found) - 900) <= 20


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_give_the_rows_of_their_sql(spark, duck, name):
    assert comparable(queries.queries()[name](spark, DATA).toPandas()) == comparable(duck.sql(queries.oracle_sql()[name]).df())


def test_pipeline_stages_do_what_they_decide(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], DATA).cache())
    clean, exact, near, mixed, tokens = steps[1:]
    assert all(s.columns == columns for s in steps[1:-1])
    scored = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet")))
    assert clean.count() == scored.where("predicted = 0").count()
    assert exact.count() == clean.select(exact_dedup.normalised(F.col("text"))).distinct().count()
    assert near.count() == simhash.simhash_components(exact).select("root").distinct().count()
    wanted = mixing.mix(near).agg(F.sum("copies")).first()[0]
    assert mixed.count() == wanted == tokens.count() == corpus_pipeline.run(spark, DATA).count()
    texts = {r.doc_id: r.text for r in mixed.select("doc_id", "text").collect()}
    digest = {r.doc_id: r.decoded_sha256 for r in tokens.collect()}
    assert all(digest[i] == __import__("hashlib").sha256((t or "").encode()).hexdigest() for i, t in texts.items())
