"""Time features, codes, scaling, quantiles and vectors against brute force."""

from __future__ import annotations

import datetime as dt
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hearsay.functions.text import BASIC_STOPWORDS
from hearsay.operators import features, keywords, termcounts
from hearsay.operators import vectorize as vec
from hearsay.operators.keywords import keyword_scores, top_keywords
from hearsay.operators.quantiles import exact_quantiles


def test_time_features(spark):
    hours = [0, 6, 7, 12, 13, 18, 19, 23]
    rows = [(f"2024-01-06 {h:02d}:59:59",) for h in hours] + [("garbage",), (None,), ("2024-12-30",)]
    got = features.add_time_features(spark.createDataFrame(rows, "date string")).collect()
    periods = [r["time_period"] for r in got[:8]]
    assert periods == ["Night"] * 2 + ["Morning"] * 2 + ["Afternoon"] * 2 + ["Evening"] * 2
    saturday = got[0].asDict()
    assert (saturday["date"], saturday["day_of_week"], saturday["is_weekend"]) == (
        dt.datetime(2024, 1, 6, 0, 59, 59), 5, 1,
    )
    for unknown in got[8:10]:
        assert unknown["is_weekend"] == 0
        assert [v for k, v in unknown.asDict().items() if k != "is_weekend"] == [None] * 8
    assert (got[10]["quarter"], got[10]["day_of_week"], got[10]["is_weekend"]) == (4, 0, 0)


@pytest.mark.parametrize("partitions", [1, 6])
def test_label_codes_are_sorted_positions(spark, partitions):
    values = [f"v{i * 7919 % 1000}" for i in range(3000)] + [None, "", "Z", "é", "nan"]
    df = spark.createDataFrame(list(enumerate(values)), "post_id bigint, v string")
    got, tables = features.encode_labels(df.repartition(partitions), ["v", "absent"])
    labels = sorted({"nan" if v is None else v for v in values}, key=lambda s: s.encode())
    want = {i: labels.index("nan" if v is None else v) for i, v in enumerate(values)}
    assert {r["post_id"]: r["v_encoded"] for r in got.collect()} == want
    assert list(tables) == ["v"]
    assert tables["v"].count() == len(labels)


def hard_values():
    rng = np.random.default_rng(5)
    return np.concatenate(
        [
            rng.normal(size=700) * 10.0 ** rng.integers(-9, 9, size=700),
            np.full(500, 0.25),
            np.zeros(51),
            [1e300, -1e300, 5e-324],
        ]
    )


@pytest.mark.parametrize("count", [1, 2, 3, 10, 1254])
def test_quantiles_match_numpy(spark, count):
    values = hard_values()[-count:]
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    rows = [(float(v), float(-v)) for v in values]
    df = spark.createDataFrame([*rows, (None, math.nan)], "a double, b double").repartition(5)
    got = exact_quantiles(df, {"a": "a", "b": "b"}, probs).collect()
    assert len(got) == 2 * len(probs)
    for r in got:
        data = values if r["metric"] == "a" else -values
        assert r["value"] == pytest.approx(np.quantile(data, r["prob"]), rel=1e-12, abs=1e-300)


def test_quantiles_by_group_with_a_hot_group(spark):
    rng = np.random.default_rng(6)
    groups = ["hot"] * 600 + ["b"] * 300 + [None] * 5 + ["one"]
    values = rng.random(len(groups))
    values[:200] = 0.5
    df = spark.createDataFrame(
        [(g, float(v)) for g, v in zip(groups, values)], "g string, v double"
    ).repartition(4)
    got = exact_quantiles(df, {"v": "v"}, (0.25, 0.5, 0.75), by=["g"]).collect()
    want = pd.DataFrame({"g": groups, "v": values}).groupby("g", dropna=False)["v"]
    expected = {(None if pd.isna(g) else g, p): s.quantile(p) for g, s in want for p in (0.25, 0.5, 0.75)}
    assert {(r["g"], r["prob"]): r["value"] for r in got} == pytest.approx(expected)


def test_scalers(spark):
    values = np.array([1.0, 2.0, 2.0, 5.0, 40.0])
    df = spark.createDataFrame([(float(v), 3.0) for v in values], "x double, same double")
    q1, q2, q3 = np.quantile(values, (0.25, 0.5, 0.75))
    wanted = {
        "standard": (values - values.mean()) / values.std(),
        "minmax": (values - values.min()) / np.ptp(values),
        "robust": (values - q2) / (q3 - q1),
    }
    for method, want in wanted.items():
        scaler = features.fit_scaler(df, ["x", "same"], method)
        got = scaler.transform(df).orderBy("x").collect()
        assert [r["x_scaled"] for r in got] == pytest.approx(list(want))
        assert {r["same_scaled"] for r in got} == {0.0}
    with pytest.raises(ValueError):
        features.fit_scaler(df, ["x"], "other")


def test_crowded_values_are_not_sorted_in_one_task(spark):
    """Distinct values packed into one logarithmic bin: still exact, and by several rounds."""
    rng = np.random.default_rng(8)
    values = 1 - rng.random(20_000) * 1e-6
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    probs = (0.01, 0.5, 0.75)
    got = exact_quantiles(df, {"v": "v"}, probs).collect()
    assert {r["prob"]: r["value"] for r in got} == pytest.approx(
        {p: float(np.quantile(values, p)) for p in probs}, rel=1e-15
    )


def test_infinite_and_weighted_values(spark):
    rows = [(math.inf, 1), (-math.inf, 1), (1.0, 3), (2.0, 0), (5.0, 2), (math.nan, 9), (None, 9)]
    df = spark.createDataFrame(rows, "v double, times bigint")
    got = exact_quantiles(df, {"v": "v"}, (0.0, 0.5, 1.0), weight="times").collect()
    assert {r["prob"]: r["value"] for r in got} == {0.0: -math.inf, 0.5: 1.0, 1.0: math.inf}
    assert {r["count"] for r in got} == {7}


def test_scalers_leave_nan_out(spark):
    values = [1.0, 2.0, 4.0, math.nan]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    known = np.array(values[:3])
    wanted = {
        "standard": (known - known.mean()) / known.std(),
        "minmax": (known - 1) / 3,
        "robust": (known - 2) / 1.5,
    }
    for method, want in wanted.items():
        got = features.fit_scaler(df, ["x"], method).transform(df).where("NOT isnan(x)")
        assert [r["x_scaled"] for r in got.orderBy("x").collect()] == pytest.approx(list(want))


@pytest.mark.parametrize("method", ["standard", "minmax", "robust"])
def test_matrix_scaling(spark, method):
    rows = [(1, "good dog. bad DOG!"), (2, "good dog"), (3, "old cat, good cat"), (4, "x y z")]
    df = spark.createDataFrame(rows, "post_id bigint, text_cleaned string")
    matrix = vec.sentiment_features(df, min_df=1, max_df=1.0, stopwords=())
    dense = {
        r["post_id"]: r["v"]
        for r in matrix.frame.select("post_id", vector_to_array("features").alias("v")).collect()
    }
    x = np.array([dense[i] for i in sorted(dense)])
    q1, q2, q3 = np.quantile(x, (0.25, 0.5, 0.75), axis=0)
    center, width = {
        "standard": (x.mean(0), x.std(0)),
        "minmax": (x.min(0), np.ptp(x, axis=0)),
        "robust": (q2, q3 - q1),
    }[method]
    want = (x - center) / np.where(width < 1e-12, 1, width)
    scaler = vec.fit_matrix_scaler(matrix, method)
    got = np.tile(scaler.zeros, (len(x), 1))
    place = {n: i for i, n in enumerate(matrix.names)}
    for r in scaler.long_form(matrix, ["post_id"]).collect():
        got[r["post_id"] - 1, place[r["feature"]]] = r["value"]
    assert got == pytest.approx(want, abs=1e-9)


def test_scaled_matrix_has_every_position(spark):
    from pyspark.ml.feature import PCA

    rows = [(1, "good dog. bad DOG!"), (2, "good dog"), (3, "old cat, good cat"), (4, None)]
    df = spark.createDataFrame(rows, "post_id bigint, text_cleaned string").repartition(2)
    matrix = vec.sentiment_features(df, min_df=1, max_df=1.0, stopwords=())
    scaler = vec.fit_matrix_scaler(matrix, "standard")
    scaled = scaler.transform(matrix)
    dense = {r["post_id"]: r["v"] for r in scaled.dense().select("post_id", vector_to_array("dense").alias("v")).collect()}
    raw = {r["post_id"]: r["v"] for r in matrix.frame.select("post_id", vector_to_array("features").alias("v")).collect()}
    for i, row in raw.items():
        # The statistics of a null text are null, which the matrix holds as NaN.
        want = [(v - c) / w for v, c, w in zip(row, scaler.centers, scaler.widths)]
        assert dense[i] == pytest.approx(want, abs=1e-12, nan_ok=True)
    sizes = scaled.frame.select(F.size(F.unwrap_udt("scaled")["indices"]).alias("n"), "post_id").collect()
    assert {r["post_id"]: r["n"] for r in sizes} == {i: sum(v != 0 for v in row) for i, row in raw.items()}
    long = scaled.long_form(["post_id"]).collect()
    assert len(long) == 4 * len(matrix.names)
    assert {(r["post_id"], r["feature"]) for r in long} == {(i, n) for i in raw for n in matrix.names}
    known = scaled.dense().where("post_id < 4")
    assert PCA(k=2, inputCol="dense", outputCol="p").fit(known).transform(known).count() == 3


def test_ngrams_are_counted_in_slices_of_any_size(spark, monkeypatch):
    from hearsay.operators import termcounts

    texts = ["a1 b1 a1 b1 a1", None, "", "c1", "b1 a1 b1", "x " * 40, "a1 " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string").coalesce(1)
    want = {}
    for i, text in enumerate(texts):
        toks = [t for t in (text or "").split() if len(t) > 1]
        want[i] = Counter(" ".join(toks[j : j + n]) for n in (1, 2, 3) for j in range(len(toks) - n + 1))
    for size in (1, 4, 1 << 18):
        monkeypatch.setattr(termcounts, "SLICE_TOKENS", size)
        counted = termcounts.count_terms(df, "t", (1, 3), keep=["id"])
        got = {r["id"]: {e["term"]: e["n"] for e in r["_terms"]} for r in counted.collect()}
        assert got == want
    totals = {r["term"]: (r["total"], r["docs"]) for r in termcounts.term_totals(counted).collect()}
    assert totals["b1 a1"] == (3, 2) and totals["a1"] == (34, 3)


def test_transform_is_one_python_stage(spark, monkeypatch):
    """Texts become vectors in one worker, the same ones as from their stored counts."""
    texts = ["red red blue", None, "", "green red blue red blue", "sea", "blue sea " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text_cleaned string").coalesce(1)
    model = vec.fit_terms(df, stopwords=[], min_df=1, max_df=1.0, ngram_range=(1, 2))
    counted = termcounts.count_terms(df, "text_cleaned", (1, 2))
    want = sorted(model.vectors(counted).collect(), key=lambda r: r["id"])
    for size in (1, 4, 1 << 18):
        monkeypatch.setattr(vec, "SLICE_TOKENS", size)
        found = model.transform(df)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1
        assert sorted(found.collect(), key=lambda r: r["id"]) == want
    assert model.transform(df, keep=["id"]).columns == ["id", "features"]


def test_texts_are_cut_once(spark, tmp_path):
    """One pass over the texts for vocabulary, frequencies and vectors."""
    spark.createDataFrame([(i, "a cat sat on a mat") for i in range(9)], "post_id bigint, text_cleaned string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for frame in (
        vec.fit_transform(df, max_df=1.0)[1],
        vec.sentiment_features(df, max_df=1.0).frame,
    ):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "regexp_extract_all" not in plan and str(tmp_path) not in plan


DOCS = [
    "the cat sat on the mat",
    "The CAT ate; the dog sat!",
    "a dog a cat été été",
    "",
    None,
    "x y z",
    "cat cat cat x_1 x_1",
]


def brute_force(docs, ngrams, max_features, min_df, max_df, stop, tfidf):
    """Weights by the published formulas: smoothed idf plus one, rows of unit length."""

    def grams(text):
        toks = [t for t in re.findall(r"\b\w\w+\b", (text or "").lower()) if t not in stop]
        return Counter(
            " ".join(toks[i : i + n])
            for n in range(ngrams[0], ngrams[1] + 1)
            for i in range(len(toks) - n + 1)
        )

    counts = [grams(d) for d in docs]
    df = Counter(t for c in counts for t in c)
    total = sum(counts, Counter())
    low = min_df * len(docs) if isinstance(min_df, float) else min_df
    high = max_df * len(docs) if isinstance(max_df, float) else max_df
    kept = sorted((t for t in df if low <= df[t] <= high), key=lambda t: (-total[t], t))
    vocabulary = set(kept[:max_features])
    rows = {}
    for i, c in enumerate(counts):
        weights = {t: float(n) for t, n in c.items() if t in vocabulary}
        if tfidf:
            weights = {
                t: w * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, w in weights.items()
            }
            length = math.sqrt(sum(w * w for w in weights.values()))
            weights = {t: w / length for t, w in weights.items()}
        rows.update({(i, t): w for t, w in weights.items()})
    return rows


@pytest.mark.parametrize("tfidf", [True, False])
@pytest.mark.parametrize(
    "ngrams, max_features, min_df, max_df",
    [((1, 1), 3, 1, 1.0), ((1, 2), 100, 2, 0.8), ((2, 3), 100, 1, 6), ((1, 1), 10, 0.2, 0.5)],
)
def test_terms_match_brute_force(spark, ngrams, max_features, min_df, max_df, tfidf):
    df = spark.createDataFrame(list(enumerate(DOCS)), "id bigint, text_cleaned string").repartition(3)
    model = vec.fit_terms(
        df,
        max_features=max_features,
        min_df=min_df,
        max_df=max_df,
        ngram_range=ngrams,
        stopwords=BASIC_STOPWORDS,
        tfidf=tfidf,
    )
    got = {(r["id"], r["term"]): r["value"] for r in model.long_form(df, ["id"]).collect()}
    want = brute_force(DOCS, ngrams, max_features, min_df, max_df, BASIC_STOPWORDS, tfidf)
    assert got == pytest.approx(want)


def test_default_stopwords_and_empty_vocabulary(spark):
    df = spark.createDataFrame([(1, "the the and"), (2, "the and")], "id bigint, text_cleaned string")
    with pytest.raises(ValueError):
        vec.fit_tfidf(df)
    assert "the" in vec.english_stopwords()


def test_feature_matrix_positions(spark):
    rows = [(1, "good dog. bad DOG!", "2024-03-02 08:00:00"), (2, "good dog", "no date")]
    df = spark.createDataFrame(rows, "post_id bigint, text_cleaned string, date string")
    matrix = vec.feature_matrix(df, max_df=1.0)
    assert matrix.metadata == {
        "n_samples": 2, "n_features": 19, "text_feature_count": 3, "other_feature_count": 16
    }
    dense = matrix.frame.orderBy("post_id").select(vector_to_array("features").alias("v")).collect()
    first = dict(zip(matrix.names, dense[0]["v"]))
    assert (first["text_char_count"], first["month"], first["text_exclamation_count"]) == (18, 3, 1)
    second = dict(zip(matrix.names, dense[1]["v"]))
    assert math.isnan(second["year"]) and second["is_weekend"] == 0
    long = matrix.long_form(["post_id"]).where("post_id = 1").collect()
    assert {r["feature"]: r["value"] for r in long} == {n: v for n, v in first.items() if v}
    topic = vec.topic_features(df, max_df=1.0)
    assert topic.names == ("bad", "dog", "good")[-len(topic.names):]


def test_keywords(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "id bigint, text_cleaned string")
    options = {"min_df": 1, "max_df": 1.0, "stopwords": BASIC_STOPWORDS}
    want = Counter()
    for (_, term), w in brute_force(DOCS, (1, 1), 1000, 1, 1.0, BASIC_STOPWORDS, True).items():
        want[term] += w
    assert {r["term"]: r["score"] for r in keyword_scores(df, **options).collect()} == pytest.approx(want)
    top = [r["term"] for r in top_keywords(df, 3, **options).collect()]
    assert top == sorted(want, key=lambda t: (-want[t], t))[:3]


def test_sparse_vectors_stay_sparse(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "id bigint, text_cleaned string")
    model = vec.fit_tfidf(df, min_df=1, max_df=1.0)
    stored = model.transform(df).select(F.unwrap_udt("features")["indices"].alias("i")).collect()
    assert all(r["i"] is not None and len(r["i"]) < len(model.vocabulary) for r in stored)


def test_label_codes_on_new_rows(spark):
    rows = [(1, "b", 3), (2, "a", 10), (3, None, 3), (4, "b", None)]
    df = spark.createDataFrame(rows, "post_id int, tag string, size int")
    _, tables = features.encode_labels(df, ["tag", "size"])
    new = spark.createDataFrame([(7, "c", 3), (8, "b", 99), (9, None, None), (9, "b", 10)], df.schema)
    coded = features.apply_label_codes(new, tables)
    got = {(r["post_id"], r["tag"]): (r["tag_encoded"], r["size_encoded"]) for r in coded.collect()}
    # As text "10" sorts before "3", and missing values are "nan".
    assert got == {(7, "c"): (None, 1), (8, "b"): (1, None), (9, None): (2, 2), (9, "b"): (1, 0)}
    filled = features.apply_label_codes(new, tables, unseen=-1).where("post_id < 9").collect()
    assert sorted((r["tag_encoded"], r["size_encoded"]) for r in filled) == [(-1, 1), (1, -1)]
    back = features.decode_labels(coded.drop("tag", "size"), tables).where("post_id = 9").collect()
    assert sorted((r["tag_decoded"], r["size_decoded"]) for r in back) == [("b", "10"), ("nan", "nan")]
    assert features.apply_label_codes(new.drop("size"), tables).columns == ["post_id", "tag", "tag_encoded"]


def test_batches_are_cut_by_entries():
    """A task works on a bounded number of entries, whatever a batch holds."""
    sizes = [3, 0, 5, 9, 1, 1, 0]
    lists = pa.array([[{"term": f"t{i}", "n": i} for i in range(n)] for n in sizes])
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), lists], names=["id", "_terms"])
    parts = list(termcounts.small_parts(iter([batch, batch.slice(0, 0)]), 6))
    assert [p.num_rows for p in parts] == [2, 1, 1, 3]
    assert [r for p in parts for r in p.to_pylist()] == batch.to_pylist()
    assert max(p.num_rows for p in termcounts.small_parts(iter([batch.slice(3, 1)]), 6)) == 1


@pytest.mark.parametrize("buckets", [1, 7, 1 << 18])
@pytest.mark.parametrize("wanted", [1, 5, 40, 1000])
def test_frequent_totals_are_the_most_frequent(spark, buckets, wanted):
    """As from the totals of all terms, ties too, whatever shares a bucket."""
    texts = [" ".join(f"w{(i * i + j * (i % 5 + 1)) % (j % 11 + 3)}" for j in range(i % 17)) for i in range(60)]
    df = spark.createDataFrame(list(enumerate([*texts, None, ""])), "id int, t string").repartition(3)
    counted = termcounts.count_terms(df, "t", (1, 3), keep=["id"]).persist()
    in_range = F.col("docs").between(2, 40)
    top = lambda totals: [
        tuple(r) for r in totals.orderBy(F.desc("total"), "term").limit(wanted).collect()
    ]
    want = top(termcounts.term_totals(counted).where(in_range))
    got = termcounts.frequent_totals(counted, wanted, in_range, buckets)
    assert top(got) == want and want
    counted.unpersist()


def test_rare_ngrams_are_not_shuffled(spark):
    """Most n-grams occur once; only those that may be chosen have exact totals."""
    texts = [f"so it goes x{i} y{i} z{i} and so it goes" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    counted = termcounts.count_terms(df, "t", (1, 3), keep=["id"])
    some = termcounts.frequent_totals(counted, 4, F.col("docs") >= 1)
    assert some.count() < 20 < 2000 < termcounts.term_totals(counted).count()


def test_keyword_counts_stay_with_their_post(spark):
    """Only a number a post is gathered for its length, not its terms."""
    df = spark.createDataFrame([(i, "a cat sat on a mat") for i in range(9)], "id int, t string")
    plan = keyword_scores(df, "t", max_df=1.0, stopwords=())._jdf.queryExecution().toString()
    assert "collect_list" not in plan


@pytest.mark.parametrize("most", [0, 3, 10**6])
def test_keywords_do_not_depend_on_what_is_broadcast(spark, monkeypatch, most):
    texts = [" ".join(f"w{j % (i + 1)}" for j in range(12)) + " all" for i in range(9)] + [None, ""]
    df = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts)], "id int, t string")
    monkeypatch.setattr(keywords, "OFTEN", most)
    got = {r["term"]: r["score"] for r in keyword_scores(df, "t", stopwords=()).collect()}
    counts = [Counter((t or "").split()) for t in texts]
    docs = Counter(w for c in counts for w in c)
    idf = {w: math.log(12 / (1 + n)) + 1 for w, n in docs.items() if 2 <= n <= 0.8 * 11}
    want = Counter()
    for c in counts:
        weights = {w: n * idf[w] for w, n in c.items() if w in idf}
        length = math.sqrt(sum(x * x for x in weights.values()))
        want.update({w: x / length for w, x in weights.items()})
    assert got == pytest.approx(dict(want)) and "all" in docs
