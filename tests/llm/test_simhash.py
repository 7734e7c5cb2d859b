from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from hearsay.llm import simhash
from hearsay.llm.common import least_reachable

from .helpers import components, documents


def plain_simhash(text):
    import re

    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [words[i : i + 3] for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = [
    None, "", " \n\t ", "One", "one", "one two", "a b c", "A B  C", "a b c d", "É b c", "é b c",
    "the cat sat on the mat " * 50, "nbsp joined word", "\x0bx\x0cy z", "😀 b 日本",
]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.simhash((text or "").encode()) % (1 << 64) == plain_simhash(text)


def test_fingerprint_in_chunks(monkeypatch):
    text = " ".join(random.Random(1).choices("abcdefgh", k=500))
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.simhash(text.encode()) % (1 << 64) == plain_simhash(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_every_word_is_near_an_anchor(spark):
    rng = random.Random(3)
    words = [0, (1 << 64) - 1, 1 << 63, 1, *(rng.getrandbits(64) for _ in range(200))]
    rows = spark.createDataFrame([(signed(w),) for w in words], "fp bigint")
    for fp, anchors in rows.select("fp", simhash.anchors(F.col("fp"))).collect():
        distances = [bin((fp ^ a) % (1 << 64)).count("1") for a in anchors]
        assert min(distances) <= 1 and max(distances) <= 2
        assert len(set(anchors)) == len(anchors) in (2, 33)


def test_links_match_all_pairs(spark):
    rng = random.Random(7)
    words = set()
    for _ in range(25):
        centre = rng.getrandbits(64)
        words.add(centre)
        for _ in range(rng.choice((0, 2, 30))):
            near = centre
            for _ in range(rng.randrange(5)):
                near ^= 1 << rng.randrange(64)
            words.add(near)
    words = [signed(w) for w in words]
    pairs = [
        (a, b)
        for i, a in enumerate(words)
        for b in words[:i]
        if bin((a ^ b) % (1 << 64)).count("1") <= 2
    ]
    edges = simhash.links(spark.createDataFrame([(w,) for w in words], "fp bigint"))
    got = [(r["a"], r["b"]) for r in edges.collect()]
    assert {tuple(sorted(p)) for p in got} <= {tuple(sorted(p)) for p in pairs}
    assert components(words, got) == components(words, pairs)
    roots = {r["node"]: r["root"] for r in least_reachable(edges).collect()}
    want = components(words, pairs)
    assert roots == {n: want[n] for n in {n for p in pairs for n in p}}


def test_top_bit(spark):
    """The free bit of the code, alone and beside another flipped bit."""
    top = -(1 << 63)
    words = [0, top, 1, top | 1, 6, top | 6, 0x7FF, top | 0x7FF]
    edges = simhash.links(spark.createDataFrame([(w,) for w in words], "fp bigint")).collect()
    pairs = [
        (a, b) for a in words for b in words if 0 < bin((a ^ b) % (1 << 64)).count("1") <= 2
    ]
    assert components(words, [tuple(r) for r in edges]) == components(words, pairs)


def test_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(5).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(3, 3)], "a bigint, b bigint")
    roots = {r["node"]: r["root"] for r in least_reachable(edges).collect()}
    assert roots == dict.fromkeys(range(n), 0)


def test_near_duplicates(spark):
    texts = TEXTS + ["one", None, "the cat sat on the mat " * 50]
    docs = documents(spark, texts).withColumn("root", F.lit(1)).withColumn("fp", F.lit("x"))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = {i: plain_simhash(t) for i, t in enumerate(texts)}
    links = [(i, j) for i in fps for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    assert {i: r["fp"] % (1 << 64) for i, r in got.items()} == fps
    assert {i: r["component_id"] for i, r in got.items()} == components(fps, links)


def test_keep_first(spark):
    docs = documents(spark, ["a b c", "A b  c", "x y z", None, ""]).withColumn("shard", F.lit(1))
    twice = docs.union(docs)
    kept = simhash.keep_first(twice)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]
    nulls = docs.withColumn("doc_id", F.lit(None).cast("bigint"))
    assert simhash.keep_first(nulls).count() == 3
    assert simhash.keep_first(docs.limit(0)).count() == 0
