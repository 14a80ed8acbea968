"""Operator 4: held-out accuracy and odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from mnemograph.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = quality.op4_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "quality").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    out = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in out]) >= 0.95


def test_held_out_labels_are_not_used(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    wrong = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, wrong)
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "a b", "z"), (2, "a b", "z"), (3, "퟿ \x00 " * 50000, "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == 5 and all(abs(r.score - quality.CUT) < 1e-12 for r in got)
    assert quality.keep_good(docs, quality.fit(docs, labels)).columns == docs.columns


def test_weights_order_a_planted_feature():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    y = (x[:, 2] + 0.1 * rng.normal(size=400) > 0).astype(int)
    r = quality.fit_ranker(x, y, 20000)
    assert np.mean((r.score(x) >= quality.CUT) == (y == 1)) > 0.93
