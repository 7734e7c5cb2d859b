"""Topics against what was planted, and their points against plain versions."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearsay.operators import termcounts, topics
from hearsay.operators.termcounts import count_terms, term_totals


def planted(spark, n_posts, k=3, words=25, seed=7):
    """Posts of ``k`` topics over words of the given documents, and the topics' weights. A post has
    four fifths of its words from one topic, the rest from all."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = term_totals(count_terms(docs, "text", keep=[])).orderBy(F.desc("total"), "term")
    vocabulary = [r["term"] for r in found.limit(k * words).collect()]
    rng = random.Random(seed)
    rng.shuffle(vocabulary)
    share = [1 / (i + 2) for i in range(words)]
    own = [vocabulary[t * words : (t + 1) * words] for t in range(k)]
    rows = []
    for i in range(n_posts):
        main = i % k
        text = []
        for _ in range(rng.randrange(30, 60)):
            topic = main if rng.random() < 0.8 else rng.randrange(k)
            text.append(rng.choices(own[topic], share)[0])
        rows.append((i, " ".join(text), main))
    weights = [
        (t, w, x / sum(share)) for t in range(k) for w, x in zip(own[t], share)
    ]
    posts = spark.createDataFrame(rows, "post_id bigint, text string, main int").repartition(4)
    return posts, spark.createDataFrame(weights, "topic int, term string, weight double")


@pytest.fixture(scope="module")
def fitted(spark):
    posts, wanted = planted(spark, 600)
    learned = posts.where("post_id % 6 <> 0")
    model = topics.fit_topics(learned, "text", k=3, stopwords=(), max_df=1.0)
    return posts, wanted, model


def test_planted_topics_are_found(fitted):
    posts, wanted, model = fitted
    found = topics.topic_weights(model)
    assert found.groupBy("topic").agg(F.sum("weight").alias("w")).where("abs(w - 1) > 1e-9").count() == 0
    pairs = topics.match_topics(found, wanted)
    assert len(pairs) == 3 and all(cosine > 0.9 for *_, cosine in pairs)
    # Posts not learned from go to the topic they were made of.
    topic_of = {a: b for a, b, _ in pairs}
    held = model.transform(posts.where("post_id % 6 = 0"), "text").select("topic", "main").collect()
    assert sum(topic_of[r["topic"]] == r["main"] for r in held) > 0.95 * len(held)


def test_held_out_perplexity(fitted, spark):
    posts, wanted, model = fitted
    held = count_terms(posts.where("post_id % 6 = 0"), "text", keep=["post_id"])

    def of(weights):
        return topics.perplexity(topics.fold_in(held, weights, 20)).first()["perplexity"]

    one = term_totals(count_terms(posts.where("post_id % 6 <> 0"), "text", keep=[]))
    total = one.agg(F.sum("total")).first()[0]
    flat = one.select(F.lit(0).alias("topic"), "term", (F.col("total") / total).alias("weight"))
    found, best, single = of(topics.topic_weights(model)), of(wanted), of(flat)
    assert best < found < 1.1 * best
    assert found < 0.75 * single


def test_fold_in_by_hand(spark):
    rows = [(0, "aa aa bb"), (1, "cc"), (2, "zz"), (3, None), (4, "bb cc cc aa zz")]
    counted = count_terms(spark.createDataFrame(rows, "id int, t string"), "t", keep=["id"])
    table = {"aa": (0.7, 0.1), "bb": (0.2, 0.3), "cc": (0.1, 0.6)}
    weights = spark.createDataFrame(
        [(t, w, x[t]) for w, x in table.items() for t in (0, 1)], "topic int, term string, weight double"
    )
    for steps in (0, 1, 5):
        got = {r["id"]: r for r in topics.fold_in(counted, weights, steps).collect()}
        for i, text in rows:
            words = Counter(w for w in (text or "").split() if w in table)
            share = [0.5, 0.5]
            for _ in range(steps if words else 0):
                new = [0.0, 0.0]
                for w, n in words.items():
                    z = sum(s * p for s, p in zip(share, table[w]))
                    for t in (0, 1):
                        new[t] += n * share[t] * table[w][t] / z
                share = [x / sum(words.values()) for x in new]
            ll = sum(n * math.log(sum(s * p for s, p in zip(share, table[w]))) for w, n in words.items())
            assert got[i]["words"] == sum(words.values())
            assert got[i]["topic_weights"] == pytest.approx(share)
            assert got[i]["log_likelihood"] == pytest.approx(ll)
    empty = topics.fold_in(counted.where("id = 3"), weights, 3)
    assert topics.perplexity(empty).first().asDict() == {"posts": 1, "words": 0, "perplexity": None}


def test_principal_axes(spark):
    rng = np.random.default_rng(2)
    x = rng.dirichlet([0.5, 1, 2, 0.2], 300)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, w array<double>").repartition(5)
    axes = topics.principal_axes(df, "w", 4)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    for k in (0, 1):
        want = vectors[:, -1 - k]
        assert abs(axes[:, k] @ want) == pytest.approx(1)
        assert axes[np.argmax(np.abs(axes[:, k])), k] > 0
    got = {r["id"]: (r["x"], r["y"]) for r in topics.topic_points(df, "w", 4).collect()}
    for i, v in enumerate(x):
        assert got[i] == pytest.approx(tuple(v @ axes))


def plain_clusters(points, k, max_iter=50):
    """The same start and steps on plain numbers."""
    away = lambda p, c: (p[0] - c[0]) ** 2 + (p[1] - c[1]) ** 2
    mean = (sum(p[0] for p in points) / len(points), sum(p[1] for p in points) / len(points))
    chosen = []
    while len(chosen) < k:
        near = lambda p: min(away(p, c) for c in (chosen or [mean]))
        far = max(points, key=lambda p: (near(p), -p[0], -p[1]))
        if chosen and near(far) == 0:
            break
        chosen.append(far)
    for _ in range(max_iter):
        of = [min(range(len(chosen)), key=lambda i: (away(p, chosen[i]), i)) for p in points]
        moved = []
        for i, c in enumerate(chosen):
            mine = [p for p, j in zip(points, of) if i == j]
            moved.append(tuple(sum(v) / len(mine) for v in zip(*mine)) if mine else c)
        if np.allclose(moved, chosen, rtol=0, atol=1e-12):
            break
        chosen = moved
    return of


@pytest.mark.parametrize("k", [1, 3, 8])
def test_clusters_match_plain_steps(spark, k):
    rng = random.Random(k)
    points = [(rng.gauss(3 * (i % 4), 1), rng.gauss(2 * (i % 3), 1)) for i in range(150)]
    points += [points[0]] * 3
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, x double, y double")
    clustered, centres = topics.cluster_points(df.repartition(4), k)
    got = {r["id"]: r["cluster"] for r in clustered.collect()}
    assert [got[i] for i in range(len(points))] == plain_clusters(points, k)
    assert len(centres) == k


def test_fewer_points_than_clusters(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, 0.0, 1.0), (3, 2.0, 1.0)], "id int, x double, y double")
    clustered, centres = topics.cluster_points(df, 5)
    got = {r["id"]: r["cluster"] for r in clustered.collect()}
    assert len(centres) == 2 and got[1] == got[2] != got[3]
    none, centres = topics.cluster_points(df.limit(0), 5)
    assert none.count() == 0 and centres == []


def test_class_weights(spark):
    rows = [("x", "aa aa bb"), ("x", "bb"), ("y", "cc"), (None, "aa"), ("y", "dd")]
    counted = count_terms(spark.createDataFrame(rows, "c string, t string"), "t", keep=["c"])
    got = topics.class_weights(counted, "c", ("aa", "bb", "cc"), smoothing=1.0).collect()
    assert {(r["topic"], r["class"], r["term"]): r["weight"] for r in got} == pytest.approx({
        (0, "x", "aa"): 3 / 7, (0, "x", "bb"): 3 / 7, (0, "x", "cc"): 1 / 7,
        (1, "y", "aa"): 1 / 4, (1, "y", "bb"): 1 / 4, (1, "y", "cc"): 2 / 4,
    })


def test_topic_clusters_of_a_fitted_model(fitted):
    posts, _, model = fitted
    assigned = model.transform(posts.limit(200), "text")
    rows = topics.topic_clusters(assigned, 3).collect()
    assert len(rows) == 200 and {r["cluster"] for r in rows} == {0, 1, 2}
    alike = Counter((r["cluster"], r["main"]) for r in rows)
    assert sum(max(alike[c, m] for m in range(3)) for c in range(3)) > 190
    assert topics.topic_clusters(assigned.limit(0), 3).count() == 0


def test_topics_are_found_for_what_was_counted(spark, tmp_path):
    """The same topics as from the texts, which are read once."""
    planted(spark, 60)[0].coalesce(1).write.parquet(str(tmp_path / "t"))
    posts = spark.read.parquet(str(tmp_path / "t"))
    options = {"k": 3, "max_iter": 3, "stopwords": (), "max_df": 1.0}
    model, assigned = topics.fit_assign(posts, "text", keep=["post_id"], **options)
    weights = lambda df: {
        r["post_id"]: (r["topic"], [round(float(w), 6) for w in r["topic_weights"]])
        for r in df.select("post_id", "topic", "topic_weights").collect()
    }
    got, again = weights(assigned), weights(model.transform(posts, "text"))
    assert len(got) == 60 and got == again
    assert "MapInArrow" not in assigned._jdf.queryExecution().toString()


def test_shares_do_not_depend_on_the_parts_of_a_batch(spark, monkeypatch):
    posts, weights = planted(spark, 40)
    counted = count_terms(posts, "text", keep=["post_id"])
    found = []
    for most in (1, 50, 1 << 18):
        monkeypatch.setattr(termcounts.small_parts, "__defaults__", (most,))
        folded = topics.fold_in(counted, weights, 3).collect()
        found.append({r["post_id"]: [round(x, 9) for x in r["topic_weights"]] for r in folded})
    assert found[0] == found[1] == found[2] and len(found[0]) == 40
