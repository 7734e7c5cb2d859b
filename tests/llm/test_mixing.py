from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearsay.llm import mixing
from hearsay.llm.queries import LLM_ORACLES, LLM_QUERIES

from .helpers import DOC, plain_targets


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_plain_targets(sizes):
    """The plain version, which the others are held against, has what the contract asks for."""
    named = {f"s{i:02d}": n for i, n in enumerate(sizes[1:])} | {None: sizes[0]}
    budgets = plain_targets(named)
    assert [s for s, _, _ in budgets] == [*sorted(s for s in named if s), None]
    assert sum(t for *_, t in budgets) == pytest.approx(sum(sizes))
    open_ratio = set()
    for i, (_, size, target) in enumerate(budgets):
        assert 0 <= target <= 3 * size + 1e-6
        if target < 3 * size - 1e-6:
            open_ratio.add(round(target / mixing.WEIGHTS[i % 3], 6))
    assert len(open_ratio) <= 1  # all below their limit share by weight
    for i, (_, size, target) in enumerate(budgets):
        if open_ratio and target >= 3 * size - 1e-6:
            assert target / mixing.WEIGHTS[i % 3] <= max(open_ratio) + 1e-5


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "é", "日", *(f"s{i}" for i in range(rng.randrange(40)))]
    sizes = {s: rng.choice([0, 1, 7, rng.randrange(1000), 10**12]) for s in names}
    if seed == 3:
        sizes = dict.fromkeys(sizes, 0)
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.targets(df.repartition(3)).collect()}
    assert got == {s: (n, pytest.approx(t, rel=1e-12)) for s, n, t in plain_targets(sizes)}


def test_any_number_of_sources(spark):
    """More sources than reach a driver: no list of them is made."""
    n = 150_000
    rows = spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("s"), F.col("id")).alias("source"),
        (F.col("id") % 5).alias("size"),
        F.xxhash64("id").bitwiseAND(F.lit((1 << 60) - 1)).alias("h"),
    )
    got = mixing.mix(rows).agg(
        F.count("*").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("taken"),
        F.sum("target").alias("target"), F.sum("size").alias("size"), F.max("copies").alias("most"),
    ).first()
    assert got["n"] == n and got["most"] <= 3
    assert got["target"] == pytest.approx(got["size"], rel=1e-9)


def rows_of(spark, rows):
    docs = spark.createDataFrame(rows, DOC).withColumn("copies", F.lit("x"))
    sized = docs.select(
        "doc_id",
        "source",
        mixing.word_count("text").alias("size"),
        mixing.row_hash("doc_id", "text").alias("h"),
    )
    return docs, mixing.mix(sized).collect()


def test_taken_words_come_near_the_target(spark):
    rows = [
        (i, " ".join("w" * (1 + i % 7)) if i % 11 else None, "en", ["b", "a", None, "c"][i % 4], 0)
        for i in range(600)
    ]
    docs, got = rows_of(spark, rows)
    taken, most, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        target[r["source"]] = r["target"]
    for s in taken:
        assert abs(taken[s] - target[s]) <= most[s] / 2
    repeated = mixing.mix_documents(docs)
    assert repeated.columns == docs.columns
    counts = Counter(r["doc_id"] for r in repeated.collect())
    assert counts == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def test_nested_budgets(spark):
    """A smaller weight takes a subset."""
    rows = [(i, "a b c", "en", "x" if i % 2 else "y", 0) for i in range(300)]
    sized = spark.createDataFrame(rows, DOC).select(
        "doc_id",
        "source",
        mixing.word_count("text").alias("size"),
        mixing.row_hash("doc_id", "text").alias("h"),
    )
    small = {r["doc_id"]: r["copies"] for r in mixing.mix(sized, (1, 9)).collect()}
    large = {r["doc_id"]: r["copies"] for r in mixing.mix(sized, (1, 2)).collect()}
    assert all(small[i] <= large[i] for i in small if i % 2)
    assert sum(large.values()) == 300


def test_edges(spark):
    docs, got = rows_of(spark, [])
    assert got == [] and mixing.mix_documents(docs).count() == 0
    _, got = rows_of(spark, [(1, None, "en", None, 0), (2, " ", "en", "a", 0)])
    assert [(r["size"], r["target"], r["copies"]) for r in got] == [(0, 0.0, 0)] * 2
    # Equal rows are taken together; one source alone is taken once.
    _, got = rows_of(spark, [(7, "a b", "en", "a", 0)] * 5)
    assert [r["copies"] for r in got] == [1] * 5


def test_word_count(spark):
    texts = [(None,), ("",), (" a\tb\x0bc\x0c\rd\n",), ("x y z",)]
    got = spark.createDataFrame(texts, "text string").select(mixing.word_count("text")).collect()
    assert [r[0] for r in got] == [0, 0, 4, 2]


def test_matches_sql(spark):
    from tools.check_oracles import connect, rows_of as normal

    sf_dir = "/root/testdata/sf0.001"
    df = LLM_QUERIES["op5_mixing"](spark, sf_dir)
    result = connect(sf_dir).execute(LLM_ORACLES["op5_mixing"])
    columns = [d[0] for d in result.description]
    assert normal(df.columns, df.collect()) == normal(columns, result.fetchall())
