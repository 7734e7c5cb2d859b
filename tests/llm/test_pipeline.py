"""Every stage, and the whole pipeline, beside plain versions of its decisions."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from hearsay.llm import sharding, simhash

from .helpers import DOC, plain_targets
from .test_decontamination import plain as plain_contamination
from .test_simhash import plain_simhash

SF_DIR = "/root/testdata/sf0.001"


def key(r):
    return tuple(r)[:5]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], SF_DIR).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stage_columns(steps):
    for before, after in zip(steps, steps[1:-1]):
        assert after.dtypes == before.dtypes
    assert steps[-1].columns == [*steps[0].columns, "shard", "slot"]


def test_language(steps):
    gone = steps[0].subtract(steps[1]).collect()
    assert not [r for r in gone if any(c.isalpha() for c in r["text"] or "")]


def test_near_duplicates(steps):
    rows = sorted(steps[1].collect())
    fps = [plain_simhash(r["text"]) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    want = [key(r) for i, r in enumerate(rows) if root[i] == i]
    assert sorted(key(r) for r in steps[2].collect()) == sorted(want)


def test_decontamination(spark, steps):
    rows = steps[2].collect()
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    judged = plain_contamination([r["text"] for r in rows], items, 10)
    want = [key(r) for i, r in enumerate(rows) if not judged[i][-1]]
    assert sorted(key(r) for r in steps[3].collect()) == sorted(want)


def test_mixing(steps):
    rows = steps[3].collect()
    size = lambda r: len((r["text"] or "").split())
    sums, taken = Counter(), Counter()
    for r in rows:
        sums[r["source"]] += size(r)
    for r in steps[4].collect():
        taken[r["source"]] += size(r)
    most = max(map(size, rows))
    for source, _, target in plain_targets(sums):
        assert abs(taken[source] - target) <= most / 2
    copies = Counter(map(key, steps[4].collect()))
    assert set(copies) <= set(map(key, rows)) and max(copies.values()) <= 3


def test_sharding(steps):
    rows = steps[5].collect()
    assert Counter(map(key, rows)) == Counter(map(key, steps[4].collect()))
    sizes = Counter(r["shard"] for r in rows)
    assert [sizes[s] for s in range(24)] == sharding.shard_sizes(len(rows), 24)
    for s in range(24):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def test_run(spark, steps):
    got = P.run(spark, SF_DIR)
    assert got.columns == steps[-1].columns
    assert Counter(map(key, got.collect())) == Counter(map(key, steps[-1].collect()))


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stage_edges(spark, name, stage):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0),
            (2, "a b", None, None, 3), (2, "a b", None, None, 3)]
    docs = spark.createDataFrame(rows, DOC).withColumns(
        {c: F.lit("clash") for c in ("size", "fp", "root", "h", "copies", "rid", "kind", "lang_pred")}
    )
    out = stage(spark, docs, SF_DIR)
    assert out.columns[: len(docs.columns)] == docs.columns
    out.collect()
    assert stage(spark, docs.limit(0), SF_DIR).count() == 0


def test_one_stage_keeps_the_smallest(spark):
    docs = spark.createDataFrame([(5, "x y z", "en", "a", 1), (3, "X y z", "en", "b", 1)], DOC)
    assert [r["doc_id"] for r in simhash.keep_first(docs).collect()] == [3]
