"""Wording that few toxic texts share has weights beside wording that many share."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from findlake.llm import toxicity


def test_rarer_toxic_wording_keeps_its_weight(spark):
    rnd = random.Random(3)
    letters = lambda k, of: "".join(rnd.choice(of) for _ in range(k))
    common = letters(5_500, "abcdefghijklm")  # some 19,000 n-grams, all in three quarters of the toxic texts
    rare = letters(120, "nopqrs")
    texts = [(common, 1)] * 60 + [(rare, 1)] * 20 + [(letters(300, "tuvwxyz "), 0) for _ in range(160)]
    ids = iter(range(10_000))
    held = {r.id for r in spark.range(10_000).where(toxicity.held_out(F.col("id"))).collect()}
    rows = [(next(i for i in ids if i not in held), text, toxic) for text, toxic in texts]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert len(model.buckets) > 1 << 14
    wanted = toxicity.grams([rare])[1]
    assert set(wanted.tolist()) <= set(model.buckets.tolist())
    assert model.scores([rare], model.table())[0] > 0.5
