"""Label rules, word-list scorers, plug-in models and the trained scorer."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearsay.functions import scores as S
from hearsay.operators import hashed, joins, topics
from hearsay.operators import sentiment as sent
from hearsay.plans import flows

DEFAULT = ("NEUTRAL", 0.0, 0.33, 0.33, 0.34)
COLUMNS = list(S.SENTIMENT_COLUMNS.values())


def normalized(spark, cases, adapt=lambda c: c):
    schema = "id int, items array<struct<label: string, score: double>>"
    df = spark.createDataFrame(list(enumerate(cases)), schema)
    rows = df.select("id", S.normalize_scores(adapt(F.col("items"))).alias("s")).collect()
    return [tuple(r["s"]) for r in sorted(rows)]


def test_label_rules(spark):
    cases = {
        (("pos", 0.7), ("neg", 0.3)): ("POSITIVE", 0.7, 0.7, 0.3, 0.0),
        (("POSITIVE", 0.5), ("NEGATIVE", 0.5)): ("NEGATIVE", 0.5, 0.5, 0.5, 0.0),
        (("1", 0.1), ("0", 0.2), ("2", 0.9)): ("NEGATIVE", 0.2, 0.1, 0.2, 0.9),
        (("neutral", 0.9), ("pos", 0.1)): ("NEUTRAL", 0.9, 0.1, 0.0, 0.9),
        (("LABEL_1", 0.8), ("LABEL_0", 0.2)): ("LABEL_1", 0.8, 0.0, 0.0, 0.0),
        (("5 stars", 0.6), ("1 star", 0.4)): ("5 STARS", 0.6, 0.0, 0.0, 0.0),
        (("pos", 0.1), ("neg", 0.5), ("pos", 0.9)): ("POSITIVE", 0.9, 0.9, 0.5, 0.0),
        (): DEFAULT,
    }
    assert normalized(spark, [list(c) for c in cases]) == list(cases.values())
    assert normalized(spark, [None]) == [DEFAULT]


def test_star_labels_on_request(spark):
    stars = [("1 star", 0.1), ("2 stars", 0.1), ("3 stars", 0.2), ("4 stars", 0.25), ("5 stars", 0.35)]
    label, score, pos, neg, neu = normalized(spark, [stars], S.star_scores)[0]
    assert (label, pos, neg, neu) == ("POSITIVE", pytest.approx(0.6), pytest.approx(0.2), 0.2)
    assert score == pos


LEXICON = [("Good", 1), ("fine", 2), ("bad", -1), ("odd", 1), ("odd", -1)]
TEXTS = ["good good bad", "Bad\nday", "nothing here", "  ", None, "", "odd", "GOOD fine"]
EXPECTED = [
    ("POSITIVE", 2 / 3, 2 / 3, 1 / 3, 0.0),
    ("NEGATIVE", 1.0, 0.0, 1.0, 0.0),
    DEFAULT,
    DEFAULT,
    DEFAULT,
    DEFAULT,
    ("NEGATIVE", 0.5, 0.5, 0.5, 0.0),
    ("POSITIVE", 1.0, 1.0, 0.0, 0.0),
]


@pytest.fixture
def posts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "post_id bigint, text_cleaned string")


def scores_of(df):
    return [tuple(r) for r in df.orderBy("post_id").select(*COLUMNS).collect()]


def assert_scores(df, expected):
    for got, want in zip(scores_of(df), expected, strict=True):
        assert got[0] == want[0]
        assert got[1:] == pytest.approx(want[1:])


@pytest.mark.parametrize("match", ["inline", "join"])
@pytest.mark.parametrize("as_frame", [True, False])
def test_word_list_inline_and_joined_agree(spark, posts, match, as_frame):
    words = [*LEXICON, (None, 1)]
    lexicon = spark.createDataFrame(words, "word string, polarity int") if as_frame else words
    scored = sent.score_sentiment(posts, lexicon, match=match)
    assert scored.columns == [*posts.columns, *COLUMNS]
    assert_scores(scored, EXPECTED)


@pytest.mark.parametrize("match", ["inline", "join"])
def test_emotions_inline_and_joined_agree(posts, match):
    lexicon = [("good", "JOY"), ("bad", "FEAR"), ("odd", "JOY"), ("odd", "FEAR"), ("day", "FEAR")]
    got = sent.score_emotion(posts, lexicon, match=match).orderBy("post_id").collect()
    assert [r["emotion"] for r in got] == [
        "JOY", "FEAR", "NEUTRAL", "NEUTRAL", "NEUTRAL", "NEUTRAL", "FEAR", "JOY"
    ]


def test_both_matches_agree_for_repeated_null_and_absent_keys(spark):
    rows = [(1, "good day"), (1, "bad, bad good!"), (None, "good"), (None, "(bad)")]
    keyed = spark.createDataFrame(rows, "post_id bigint, text_cleaned string")
    for df in (keyed, keyed.drop("post_id")):
        inline, joined = (
            sorted(map(str, sent.score_sentiment(df, LEXICON, match=m).collect()))
            for m in ("inline", "join")
        )
        assert inline == joined and len(inline) == 4
        moods = [("good", "JOY"), ("bad", "FEAR")]
        inline, joined = (
            sorted(map(str, sent.score_emotion(df, moods, match=m).collect()))
            for m in ("inline", "join")
        )
        assert inline == joined and sum("FEAR" in r for r in inline) == 2


def test_long_word_lists_are_no_silent_switch(posts, monkeypatch):
    monkeypatch.setattr(joins, "MAX_INLINE_WORDS", 2)
    with pytest.raises(ValueError, match="join"):
        sent.score_sentiment(posts, LEXICON)
    with pytest.raises(ValueError):
        sent.score_sentiment(posts, LEXICON, match="other")


def test_empty_word_lists_give_defaults(posts):
    assert_scores(sent.score_sentiment(posts, []), [DEFAULT] * len(TEXTS))
    assert {r["emotion"] for r in sent.score_emotion(posts, []).collect()} == {"NEUTRAL"}


def test_whole_text_unless_limited(spark):
    df = spark.createDataFrame([(1, "x " * 400 + "good")], "post_id bigint, text_cleaned string")
    assert sent.score_sentiment(df, LEXICON).first()["sentiment_label"] == "POSITIVE"
    assert sent.score_sentiment(df, LEXICON, max_chars=512).first()["sentiment_label"] == "NEUTRAL"


def test_model_gets_batches_and_failures_are_neutral(posts):
    def factory():
        def model(texts):
            assert len(texts) <= 2
            if any("day" in t for t in texts):
                raise RuntimeError("cannot score")
            return [
                [{"label": "pos", "score": 0.9}, {"label": "neg", "score": 0.1}] if "g" in t.lower() else []
                for t in texts
            ]

        return model

    scored = sent.score_with_model(posts.coalesce(1), factory, batch_size=2)
    good = ("POSITIVE", 0.9, 0.9, 0.1, 0.0)
    # "nothing here" has a g as well.
    assert_scores(scored, [good, DEFAULT, good, DEFAULT, DEFAULT, DEFAULT, DEFAULT, good])


def test_model_sees_whole_texts_unless_limited(spark):
    df = spark.createDataFrame([(1, "a" * 600)], "post_id bigint, text_cleaned string")

    def factory():
        return lambda texts: [[{"label": str(len(t)), "score": 1.0}] for t in texts]

    assert sent.score_with_model(df, factory).first()["sentiment_label"] == "600"
    assert sent.score_with_model(df, factory, max_chars=512).first()["sentiment_label"] == "512"


def test_model_with_too_few_results_is_an_error(posts):
    def factory():
        return lambda texts: [[{"label": "pos", "score": 1.0}]]

    with pytest.raises(Exception, match="results for"):
        sent.score_with_model(posts.coalesce(1), factory).collect()


def test_failures_are_counted(spark, posts):
    def factory():
        def model(texts):
            raise RuntimeError

        return model

    failures = spark.sparkContext.accumulator(0)
    scored = sent.score_with_model(posts, factory, failures=failures).collect()
    filled = sum(bool(r["text_cleaned"] and r["text_cleaned"].strip()) for r in scored)
    assert failures.value == filled > 0


def test_missing_column_returns_input(posts):
    assert sent.score_sentiment(posts, LEXICON, "absent") is posts
    assert sent.score_with_model(posts, lambda: None, "absent") is posts


def labelled(spark):
    rows = [(i, "good fine day" if i % 2 else "bad sad day", i % 2) for i in range(40)]
    return spark.createDataFrame([*rows, (99, "good", None)], "post_id bigint, text_cleaned string, y int")


def test_trained_scorer_learns_labels(spark):
    df = labelled(spark)
    scorer = sent.train_scorer(df, "y", stopwords=[], ngram_range=(1, 1), max_df=1.0)
    got = scorer.transform(df.where("post_id < 2")).orderBy("post_id").collect()
    assert [r["sentiment_label"] for r in got] == ["NEGATIVE", "POSITIVE"]
    assert got[1]["sentiment_positive"] + got[1]["sentiment_negative"] == pytest.approx(1)


def test_topics_cover_every_post(spark):
    df = labelled(spark).drop("y")
    model = topics.fit_topics(df, k=2, max_iter=5, max_df=1.0)
    assigned = model.transform(df)
    counts = topics.topic_distribution(assigned).collect()
    assert sum(r["count"] for r in counts) == 41
    assert {r["topic"] for r in counts} <= {0, 1}
    words = model.top_words(3).collect()
    assert {(r["topic"], r["rank"]) for r in words} == {(t, k) for t in (0, 1) for k in (1, 2, 3)}
    clustered = topics.topic_clusters(assigned, k=2).collect()
    assert len(clustered) == 41 and {r["cluster"] for r in clustered} <= {0, 1}


def test_analysis_cleans_only_when_needed(spark):
    df = spark.createDataFrame([(1, "GOOD @day")], "post_id bigint, text string")
    scored = flows.analyze(df, lambda d: sent.score_sentiment(d, LEXICON)).first()
    assert (scored["text_cleaned"], scored["sentiment_label"]) == ("good", "POSITIVE")
    kept = df.withColumn("text_cleaned", F.lit("bad"))
    again = flows.analyze(kept, lambda d: sent.score_sentiment(d, LEXICON)).first()
    assert again["sentiment_label"] == "NEGATIVE"


def plain_auc(pairs):
    good = [s for s, y in pairs if y == 1]
    bad = [s for s, y in pairs if y != 1]
    won = sum((a > b) + (a == b) / 2 for a in good for b in bad)
    return won / (len(good) * len(bad)) if good and bad else None


@pytest.mark.parametrize("values", [3, 1000])
def test_auc_by_pairs(spark, values):
    rng = random.Random(values)
    rows = [(rng.randrange(values) / 7, rng.choice([0, 1, 1])) for _ in range(300)]
    rows += [(rows[0][0] + 50, 1), (-1.0, 0)]
    df = spark.createDataFrame([*rows, (None, 1), (math.nan, 0), (0.5, None)], "s double, y int")
    got = hashed.auc(df.repartition(5), "s", "y").first()
    assert got["auc"] == pytest.approx(plain_auc(rows))
    assert (got["positives"], got["negatives"]) == (sum(y for _, y in rows), sum(1 - y for _, y in rows))
    alone = hashed.auc(df.where("y = 1"), "s", "y").first()
    assert alone["auc"] is None and alone["negatives"] == 0
    assert hashed.auc(df.limit(0), "s", "y").first()["positives"] == 0


def test_hashed_scorer_on_held_out_posts(spark):
    """Separates and is calibrated on posts that neither the weights nor the line have seen."""
    rng = random.Random(9)
    good = [f"good{i}" for i in range(40)]
    bad = [f"bad{i}" for i in range(40)]
    rows = []
    for i in range(1500):
        y = int(rng.random() < 0.6)
        share = 0.65 if y else 0.35
        text = " ".join(rng.choice(good if rng.random() < share else bad) for _ in range(12))
        rows.append((i, text, y))
    df = spark.createDataFrame(rows, "post_id int, text string, y int").repartition(4)
    scorer = hashed.train_hashed_scorer(df.where("post_id < 1000"), "y", "text", bits=14, ngram_range=(1, 1), reg_param=0.01)
    held = scorer.transform(df.where("post_id >= 1000").withColumn("_margin_", F.lit(1)), "text")
    best = plain_auc([(sum(w.startswith("good") for w in t.split()), y) for i, t, y in rows if i >= 1000])
    got = hashed.auc(held, "sentiment_positive", "y").first()["auc"]
    assert got > 0.85 and got > best - 0.06
    # Of posts called p likely to be good, about p are.
    found = [(r["sentiment_positive"], r["y"]) for r in held.collect()]
    for low, high in ((0.0, 0.35), (0.35, 0.65), (0.65, 1.0)):
        part = [(p, y) for p, y in found if low <= p < high]
        if len(part) > 60:
            assert abs(sum(p for p, _ in part) - sum(y for _, y in part)) / len(part) < 0.12
    blank = scorer.transform(spark.createDataFrame([(None,), (" ",), ("good1",)], "text string"), "text").collect()
    assert [r["sentiment_label"] for r in blank][:2] == ["NEUTRAL"] * 2
    assert blank[2]["sentiment_label"] == "POSITIVE"


def test_hashed_entries_do_not_depend_on_the_batch(spark):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("term", pa.string()), ("n", pa.int32())]))
    lists = [[{"term": "a", "n": 3}, {"term": "b", "n": 1}], [], [{"term": "b", "n": 2}]]
    row, position, value = hashed.hashed_entries(pa.array(lists, kind), 10)
    assert (row == [0, 0, 2]).all() and position.max() < 1024
    first = np.array([1 + math.log(3), 1.0])
    assert sorted(value[:2]) == pytest.approx(sorted(first / np.sqrt((first**2).sum()))) and value[2] == 1
    again = hashed.hashed_entries(pa.array(lists[2:], kind), 10)
    assert again[1][0] == position[2]
    assert [len(x) for x in hashed.hashed_entries(pa.array([[], []], kind), 10)] == [0, 0, 0]


@pytest.mark.parametrize("score, lexicon", [(sent.score_sentiment, [("good", 1), ("bad", -1)])])
def test_joined_scores_shuffle_no_text(spark, score, lexicon):
    """Texts are read for their words alone; the sums meet rows without them."""
    rows = [(1, "good good bad"), (1, "good good bad"), (None, " "), (2, None), (3, "none")]
    df = spark.createDataFrame(rows, "id int, text_cleaned string")
    scored = score(df, lexicon, match="join").select("id", "sentiment_label", "sentiment_score")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    schemas = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert sum("text_cleaned" in line for line in schemas) == 1
    inline = score(df, lexicon).select("id", "sentiment_label", "sentiment_score")
    key = lambda r: str(tuple(r))
    assert sorted(scored.collect(), key=key) == sorted(inline.collect(), key=key)
