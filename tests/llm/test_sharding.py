from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hearsay.llm import sharding

from .helpers import documents


@pytest.mark.parametrize("good, bad, drawn", [(5, 7, 6), (40, 3, 20), (1, 100, 50), (0, 5, 3), (9, 0, 4)])
def test_hypergeometric_law(good, bad, drawn):
    from math import comb

    rng, runs = random.Random(1), 20_000
    got = Counter(sharding.hypergeometric(rng, good, bad, drawn) for _ in range(runs))
    for k in range(max(0, drawn - bad), min(good, drawn) + 1):
        p = comb(good, k) * comb(bad, drawn - k) / comb(good + bad, drawn)
        assert abs(got.pop(k, 0) / runs - p) < 0.015
    assert not got


def test_large_populations():
    n = sharding.hypergeometric(random.Random(2), 10**12, 10**12, 10**6)
    assert abs(n - 500_000) < 5_000


def test_matrix_sums():
    blocks, shards = [10, 0, 33, 7], sharding.shard_sizes(50, 7)
    matrix = sharding.communication_matrix(blocks, shards, 4)
    assert [sum(row) for row in matrix] == blocks
    assert [sum(col) for col in zip(*matrix)] == shards


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BLOCK", 10)


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_shards_are_even_and_slots_gapless(spark, small_blocks, n):
    texts = [None if i == 3 else "" if i == 4 else f"é{i % 50}" for i in range(n)]
    docs = documents(spark, texts).withColumn("slot", F.lit("x")).withColumn("size", F.lit(1))
    rows = sharding.assign_shards(docs, 7).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(range(n))
    for r in rows:
        content = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(content) + 8, zlib.crc32(content))
        assert (r["law"], r["grown_shard"]) == ("rows", None)
    sizes = Counter(r["shard"] for r in rows)
    assert [sizes[s] for s in range(7)] == sharding.shard_sizes(n, 7)
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def test_whole_documents(spark, small_blocks):
    docs = documents(spark, [f"t{i}" for i in range(60)]).withColumn("slot", F.lit("x"))
    rows = docs.union(docs)
    out = sharding.shard_documents(rows, 5)
    assert out.columns == [*(c for c in docs.columns if c != "slot"), "shard", "slot"]
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(
        {(i, f"t{i}"): 2 for i in range(60)}
    )
    assert set(Counter(r["shard"] for r in got).values()) == {24}


def test_one_repeated_row_is_spread(spark, small_blocks):
    rows = spark.range(0, 400, 1, 4).select(
        F.lit(None).cast("bigint").alias("doc_id"), F.lit("same").alias("text")
    )
    sizes = Counter(r["shard"] for r in sharding.assign_shards(rows, 8).collect())
    assert set(sizes.values()) == {50}


def test_places_are_uniform(spark, small_blocks):
    docs = documents(spark, [str(i) for i in range(200)])
    together, runs = 0, 12
    for seed in range(runs):
        places = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(docs, 4, seed).collect()}
        together += sum(places[i] == places[i + 1] for i in range(199))
    # Neighbours share a shard as often as chance has it: 49 / 199.
    assert abs(together / (199 * runs) - 49 / 199) < 0.04


@pytest.mark.parametrize("kind", ["json", "csv", "orc"])
def test_tables_of_other_formats(spark, tmp_path, kind):
    docs = documents(spark, ["a b", "c", "a b", "d e f"])
    docs.write.option("header", True).format(kind).save(str(tmp_path / kind))
    read = spark.read.schema(docs.schema).option("header", True).format(kind)
    got = sharding.assign_shards(read.load(str(tmp_path / kind))).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 1, 2, 3]
