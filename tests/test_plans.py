"""Properties of the physical plans that matter on large tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hearsay.functions import patterns as P
from hearsay.operators import dedup, filters, sentiment, summary
from hearsay.operators import vectorize as vec
from hearsay.operators.topn import first_per_group
from hearsay.plans import flows
from workload import views as V

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumnRenamed("doc_id", "post_id")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaning_runs_once_and_without_shuffle(docs):
    text = plan(flows.preprocess(docs.select("post_id", "text")))
    assert text.count("https?://") == 1
    assert "Exchange" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_scoring_is_not_repeated_by_filters(docs):
    scored = sentiment.score_sentiment(docs.select("post_id", "text"), V.LEXICON, "text")
    text = plan(filters.high_confidence_positive(scored).select("post_id"))
    assert text.count("regexp_extract_all(lower(") == 1
    assert "Exchange" not in text and "Join" not in text


def test_unused_columns_are_not_read(docs):
    text = plan(summary.value_counts(docs, "lang"))
    assert "ReadSchema: struct<lang:string>" in text
    assert "IsNotNull(lang)" in text


def test_quota_is_trimmed_before_the_shuffle(docs):
    text = plan(first_per_group(docs, "source", [F.col("post_id")], 10, ["post_id"]))
    lines = [line.strip() for line in text.splitlines()]
    exchange = next(i for i, line in enumerate(lines) if "Exchange" in line)
    assert any("WindowGroupLimit" in line for line in lines[exchange:])


def test_dedup_combines_before_a_digest_shuffle(docs):
    """Each task sends one row a text, without the text."""
    text = plan(dedup.dedup_posts(docs, ["source"]))
    lines = [line.strip() for line in text.splitlines()]
    exchanges = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(_digest" in line]
    assert exchanges
    for i in exchanges:
        assert any("WindowGroupLimit" in line for line in lines[i:])
    sent = lines[exchanges[-1] + 1 :]
    projected = next(line for line in sent if "Project" in line)
    assert "text#" not in projected.split("sha2")[0]


def test_transform_needs_no_shuffle(docs):
    model = vec.fit_tfidf(docs, "text", ngram_range=(1, 1))
    text = plan(model.long_form(docs, ["post_id"], "text"))
    assert "Exchange" not in text.replace("BroadcastExchange", "")


def test_totals_reuse_the_counts(docs):
    shares = summary.label_distribution(docs, "source")
    shares.collect()
    assert "ReusedExchange" in plan(shares)


def test_no_cross_joins(spark):
    from __spark_entry__ import queries

    for name in ("sentiment_statistics", "confidence_boxstats", "scale_robust", "sample_posts", "full_flow"):
        text = plan(queries()[name](spark, SF_DIR))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_patterns_have_no_unbounded_alternation():
    for name, pattern in vars(P).items():
        if name.isupper() and isinstance(pattern, str):
            assert ")+" not in pattern and ")*" not in pattern.replace(")*+", ""), name
