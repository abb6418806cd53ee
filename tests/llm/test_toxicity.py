"""The toxicity classifier: features against plain counting, held-out accuracy, odd rows."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomvec.llm import toxicity

SF = "/root/testdata/sf0.1"


def plain(text):
    """Distinct n-grams of the normal form, as strings."""
    chars = [c if ord(c) >= 128 or c.isalnum() else " " for c in (text or "").lower()]
    kept = "".join(c for i, c in enumerate(chars) if c != " " or i == 0 or chars[i - 1] != " ").strip(" ")
    padded = f" {kept} " if kept else " "
    return {padded[i : i + n] for n in toxicity.ORDERS for i in range(len(padded) - n + 1)}


def test_features_are_the_distinct_n_grams():
    texts = ["An Idiot!! of—Ünïcode 漢字", None, "", " .,", "a", "ab ab ab", "x" * 50, "an idiot   of"]
    row, name = toxicity.buckets(pa.array(texts))
    bucket_of = {}
    for i, t in enumerate(texts):
        grams = plain(t)
        assert (row == i).sum() == len(grams)
        mine = set(name[row == i].tolist())
        for other, seen in bucket_of.items():  # equal n-grams of two texts, equal buckets
            assert len(mine & seen) == len(grams & other)
        bucket_of[frozenset(grams)] = mine


def test_ratios_and_fit_against_plain_formulas():
    ratio, far = toxicity.ratios(np.array([9, 0, 4]), np.array([0, 9, 4]), 10, 10)
    assert np.allclose(ratio, [np.log(10 / 12) - np.log(1 / 12), np.log(1 / 12) - np.log(10 / 12), 0])
    assert far[0] == far[1] > far[2] == 0
    rng = np.random.default_rng(3)
    x = rng.random((200, 5)) < 0.4
    y = (x[:, 0] | (rng.random(200) < 0.1)).astype(float)
    scale = np.array([2.0, -1.0, 0.5, 1.0, 0.1])
    row, name = np.nonzero(x)
    weight, bias = toxicity.fit_logistic(row, name, scale, y)
    p = 1 / (1 + np.exp(-(x @ weight + bias)))
    slope = scale * (x.T @ (p - y)) + weight / scale  # of the penalised loss: zero at its least
    assert np.abs(slope).max() < 1e-2 and abs((p - y).sum()) < 1e-2


def test_odd_rows(spark, docs, odd_rows):
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(60)] + [(5, 1, None), (None, 1, 1), (6, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    rows = odd_rows + [(i, ("you idiot fool " if i % 2 else "a kind word ") + str(i)) for i in range(10, 60)] + [(60, "such an idiot"), (61, "such a kind one")]
    got = toxicity.classify(docs(rows), labels).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((i is not None, i or 0) for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.doc_id: r.predicted for r in got}[60] == 1 and {r.doc_id: r.predicted for r in got}[61] == 0
    blank = {r.score for r in got if r.doc_id in (1, 2, 3)}
    assert len(blank) == 1  # null, empty and blank texts: the bias alone
    model = toxicity.train(docs(rows), labels)
    extra = toxicity.score(docs(rows), model, score_col="toxic_score")
    assert extra.columns == [*docs([]).columns, "toxic_score"] and extra.count() == len(rows)
    assert toxicity.classify(docs([]), labels).count() == 0
    none = toxicity.classify(docs(rows), labels.limit(0))
    assert {r.score for r in none.collect()} == {0.5}
    one = toxicity.classify(docs(rows), labels.filter("toxic = 1"))
    assert {r.score for r in one.collect()} == {1.0}


def test_sample_is_bounded_and_repeats_count_once(spark, docs):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    table = docs([(i, f"text {i}") for i in range(400)] * 2)
    assert toxicity.labelled(table, labels, 10_000, "doc_id", "text", "toxic").count() == sum(not held for held, in spark.range(400).select(toxicity.held_out("id")).collect())
    assert 0 < toxicity.labelled(table, labels, 50, "doc_id", "text", "toxic").count() <= 50


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify(docs, labels).filter("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("share")).collect()
    share = {r.toxic: r.share for r in got}
    assert share[0] < 0.01 and share[1] > 0.7  # a quarter of the toxic labels here are of texts without any toxic word


def test_held_out_labels_are_not_used(spark, docs):
    rows = [(i, f"{'idiot' if i % 2 else 'friend'} {i}") for i in range(100)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(100)], "doc_id long, quality int, toxic int")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = (sorted(map(tuple, toxicity.classify(docs(rows), t).collect())) for t in (labels, turned))
    assert first == second
