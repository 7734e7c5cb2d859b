from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from hearsay.llm import embeddings

from .helpers import components

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, threshold):
    """n_links and component of every position in ``rows``."""
    def usable(v, label):
        return (
            label is not None and v and None not in v
            and all(map(math.isfinite, v)) and any(v)
        )

    links = []
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows[:i]):
            if la == lb and usable(a, la) and usable(b, lb) and len(a) == len(b):
                dot = sum(x * y for x, y in zip(a, b))
                norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
                if dot / norm >= threshold:
                    links.append((i, j))
    n = [sum(i in p for p in links) for i in range(len(rows))]
    return n, components(range(len(rows)), links), links


def clustered(rng, groups, dim=16, noise=0.02):
    rows = []
    for size in groups:
        centre = [rng.gauss(0, 1) for _ in range(dim)]
        label = rng.randrange(2)
        for _ in range(size):
            v = [x + rng.gauss(0, noise) for x in centre]
            rows.append((len(rows), v, label))
    return rows


def as_float32(rows):
    import numpy as np

    return [
        (i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label)
        for i, v, label in rows
    ]


@pytest.mark.parametrize("group", [1000, 4])
def test_brute_force(spark, group):
    rng = random.Random(group)
    rows = clustered(rng, [1, 1, 2, 3, 25, 1, 7])
    n = len(rows)
    rows += [(n, rows[5][1], rows[5][2]), (n + 1, rows[5][1], rows[5][2])]
    rows += [
        (n + 2, None, 1), (n + 3, [], 1), (n + 4, [0.0] * 16, 1), (n + 5, rows[8][1], None),
        (n + 6, [None] + rows[8][1][1:], 1), (n + 7, [math.nan] + rows[8][1][1:], 1),
        (n + 8, [math.inf] + rows[8][1][1:], 1), (n + 9, rows[8][1][:7], 1),
        (n + 10, [2 * x for x in rows[8][1]], rows[8][2]),
    ]
    rows = as_float32(rows)
    links, roots, _ = plain(rows, 0.93)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("root", F.lit("x"))
    got = embeddings.near_duplicates(df, group=group).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {
        i: (links[i], roots[i], roots[i] == i) for i in range(len(rows))
    }


def test_recall_near_the_threshold(spark):
    """Pairs spread evenly over cosines from 0.93 to 1: at least nine tenths are found."""
    rng, rows = random.Random(5), []
    for i in range(400):
        a = [rng.gauss(0, 1) for _ in range(64)]
        b = [rng.gauss(0, 1) for _ in range(64)]
        na = math.sqrt(sum(x * x for x in a))
        dot = sum(x * y for x, y in zip(a, b)) / na / na
        b = [y - dot * x for x, y in zip(a, b)]
        nb = math.sqrt(sum(x * x for x in b))
        c = 0.931 + 0.069 * i / 400
        near = [c * x / na + math.sqrt(1 - c * c) * y / nb for x, y in zip(a, b)]
        rows += [(2 * i, a, 0), (2 * i + 1, near, 0)]
    rows = as_float32(rows)
    got = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    found = sum(r["n_links"] for r in got) / 2
    assert found >= 0.95 * 400
    assert found <= 400 + 5


def test_repeated_and_null_keys(spark):
    v, w = [1.0, 2.0, 3.0], [-3.0, 1.0, 0.0]
    rows = [(1, v, 0), (1, v, 0), (None, v, 0), (None, w, 0), (2, w, 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in got) == [
        ("1", 2, 1, True), ("1", 2, 1, True), ("2", 0, 2, True), ("None", 0, None, False),
        ("None", 2, 1, False),
    ]


def test_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
