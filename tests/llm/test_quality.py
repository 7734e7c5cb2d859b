from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearsay.llm import quality
from hearsay.llm.queries import LLM_QUERIES

from .helpers import documents

CLASSES = quality._classes()


@pytest.mark.parametrize(
    "text", ["", " \n", "a", "A!! B!!", "é😀\x00", "one two one two", "|", "x" * 100_000, " "]
)
def test_features_are_finite(text):
    values = quality.describe(text.encode(), CLASSES)
    assert len(values) == len(quality.FEATURES) and np.isfinite(values).all()


def test_prior_and_risk():
    """Negatives among the unlabelled are found without any negative label."""
    rng = np.random.default_rng(0)
    pos = lambda n: rng.normal(1.5, 1, (n, 4))
    neg = lambda n: rng.normal(-1.5, 1, (n, 4))
    p, u = pos(2000), np.concatenate((pos(1200), neg(800)))
    model = quality.fit(p, u)
    assert model.prior == pytest.approx(0.6, abs=0.08)
    held = np.concatenate((pos(500), neg(500)))
    score = model.probability(held)
    assert ((score >= 0.5) == (np.arange(1000) < 500)).mean() > 0.97


def test_too_few_rows(spark):
    docs = documents(spark, ["a", None, "", "b"]).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(0, 1), (0, None), (9, 1)], "doc_id bigint, quality int")
    got = quality.score_quality(docs, labels, F.lit(True)).collect()
    assert {(r["doc_id"], r["score"], r["predicted"]) for r in got} == {
        (i, 0.5, 0) for i in range(4)
    }
    assert quality.score_quality(docs.limit(0), labels, F.lit(True)).count() == 0


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = LLM_QUERIES["op4_quality"](spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    right = (F.col("quality") == F.col("predicted")).cast("int")
    held = got.where("held_out").join(labels, "doc_id")
    rates = {r["quality"]: r["r"] for r in held.groupBy("quality").agg(F.avg(right).alias("r")).collect()}
    assert rates[1] > 0.98 and rates[0] > 0.95
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
