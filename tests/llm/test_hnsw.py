from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearsay.llm import hnsw
from hearsay.llm.queries import op12_approximate_neighbours

SCHEMA = "vec_id bigint, embedding array<float>"
EVERY_THIRD = "vec_id % 3 = 0"


def plain(rows, k, is_query):
    """``{query row: [(id, cosine)]}``, nearest first, by comparing with every row."""
    usable = [
        (i, key, np.array(v, dtype=float)) for i, (key, v) in enumerate(rows)
        if key is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)
    ]
    out = {}
    for i, key, v in usable:
        if is_query(key):
            every = [
                (-(v @ w) / math.sqrt(v @ v) / math.sqrt(w @ w), other)
                for j, other, w in usable if j != i and len(v) == len(w)
            ]
            out[i, key] = [(o, -c) for c, o in sorted((round(c, 12), o) for c, o in every)[:k]]
    return out


def as_float32(rows):
    return [
        (i, None if v is None else [None if x is None else float(np.float32(x)) for x in v])
        for i, v in rows
    ]


def results(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("shard_rows", [1000, 7])
def test_brute_force(spark, shard_rows):
    rng = random.Random(shard_rows)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(80)]
    v = rows[3][1]
    rows += [(100 + i, v) for i in range(12)] + [(6, v), (9, v)]
    rows += [
        (200, None), (201, []), (202, [0.0] * 8), (None, v), (203, [None, *v[1:]]),
        (204, [math.nan, *v[1:]]), (205, [math.inf, *v[1:]]), (207, v[:3]), (210, v[:3]),
        (213, [1.0]), (216, [-x for x in v]), (219, [1e-30 * x for x in v]), (222, [1e30 * x for x in v]),
    ]
    rows = as_float32(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"ids": F.lit(1), "h1": F.lit("x"), "label": F.lit(1)})
    got = hnsw.nearest(df.repartition(3), F.expr(EVERY_THIRD), shard_rows=shard_rows).collect()
    want = plain(rows, 5, lambda i: i % 3 == 0)
    wanted = [
        (key, rank, o, round(c, 9)) for (_, key), near in want.items()
        for rank, (o, c) in enumerate(near, 1)
    ]
    # Cosines that differ in the last place only are in the order of that place.
    of = lambda r: (r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9))
    scores = lambda x: sorted((q, r, c) for q, r, _, c in x)
    assert scores(map(of, got)) == scores(wanted)
    tied = {(q, c) for q, _, _, c in wanted if abs(abs(c) - 1) < 1e-9}
    rest = lambda x: sorted(t for t in x if (t[0], t[3]) not in tied)
    assert rest(map(of, got)) == rest(wanted)


def test_equal_vectors_go_by_id(spark):
    """A vector that most rows have: the smallest other ids, from each of its rows."""
    v, w = [0.25, 0.5, -1.0], [1.0, 0.0, 0.0]
    rows = [(i, v) for i in range(5, 400)] + [(6, v), (1, w)]
    found = results(hnsw.nearest(spark.createDataFrame(rows, SCHEMA).repartition(8), F.expr(EVERY_THIRD)))
    assert [i for _, i, _ in found[9]] == [5, 6, 6, 7, 8]
    assert [i for _, i, _ in found[300]] == [5, 6, 6, 7, 8]
    # Both rows with id 6 are queries, and each is the other's neighbour.
    assert sorted(i for _, i, _ in found[6]) == sorted([5, 6, 7, 8, 9] * 2)
    assert 1 not in found


def test_recall(spark):
    """The given vectors, and clusters of near-equal ones, against brute force."""
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in given.collect())
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((10, 64))
    near = centres[rng.integers(0, 10, 3000)] + 0.05 * rng.standard_normal((3000, 64))
    for data, size in ((rows, 600), ([(i, v.tolist()) for i, v in enumerate(near)], 8192)):
        ids = np.array([i for i, _ in data])
        x = np.array([v for _, v in data], dtype=np.float32).astype(float)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        found = results(
            hnsw.nearest(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 50 == 0, shard_rows=size)
        )
        hits = total = 0
        for i in np.flatnonzero(ids % 50 == 0):
            c = x @ x[i]
            c[i] = -2
            fifth = np.sort(c)[-5]
            hits += sum(s >= fifth - 1e-9 for _, _, s in found[ids[i]])
            total += 5
            assert [r for r, _, _ in found[ids[i]]] == [1, 2, 3, 4, 5]
            assert all(abs(s - c[np.flatnonzero(ids == o)[0]]) < 1e-12 for _, o, s in found[ids[i]])
        assert hits >= 0.95 * total


def test_same_graph_each_time():
    x = hnsw.unit(np.random.default_rng(2).standard_normal((700, 12)))
    one, two = hnsw.build(x), hnsw.build(x)
    assert len(one) >= 2 and all((a == b).all() for a, b in zip(one, two))
    for near in one:
        assert near.max() < len(near) and not (near == np.arange(len(near))[:, None]).any()
        assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in near)


def test_few_rows(spark):
    schema = SCHEMA
    assert hnsw.nearest(spark.createDataFrame([], schema), F.expr(EVERY_THIRD)).count() == 0
    one = spark.createDataFrame([(3, [1.0, 2.0])], schema)
    assert hnsw.nearest(one, F.expr(EVERY_THIRD)).count() == 0
    two = spark.createDataFrame([(3, [1.0, 2.0]), (4, [2.0, 4.0])], schema)
    assert [tuple(r)[:3] for r in hnsw.nearest(two, F.expr(EVERY_THIRD)).collect()] == [(3, 1, 4)]
    assert hnsw.nearest(two, F.lit(None).cast("boolean")).count() == 0


def test_query(spark):
    got = op12_approximate_neighbours(spark, "/root/testdata/sf0.01")
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    ids = {r["query_id"] for r in got.collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert ids == {r["vec_id"] for r in rows.where("vec_id % 50 = 0").collect()}
    assert got.count() == 5 * len(ids)
