from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearsay.llm import lm_scoring as L
from hearsay.llm.common import fold
from hearsay.llm.queries import LLM_QUERIES

from .helpers import documents


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", lowered) + ["\n"]


def base(docs):
    """Per document: held out, tokens, known tokens, N, base score."""
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = Counter(w for i, t in docs.items() if not held[i] for w in words(t))
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in docs.items():
        w = words(t)
        score = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        out[i] = held[i], len(w), sum(c[x] > 0 for x in w), n, score
    return out


def check_base(rows, docs):
    want = base(docs)
    assert len(rows) == len(docs)
    for r in rows:
        *exact, score = want[r["doc_id"]]
        got = [r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]]
        assert got == exact
        assert r["base_score"] == pytest.approx(score, rel=1e-9)
        assert r["score"] < 0


def test_given_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = LLM_QUERIES["op1_lm_scoring"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check_base(rows, {r["doc_id"]: r["text"] for r in docs})
    held = [r for r in rows if r["held_out"]]
    per_token = lambda c: sum(r[c] for r in held) / sum(r["n_tokens"] for r in held)
    assert per_token("score") > per_token("base_score") + 0.2


@pytest.mark.parametrize("tokens, piece", [(1 << 20, 1 << 22), (7, 16)])
def test_edges_and_blocks(spark, monkeypatch, tokens, piece):
    """Small blocks and pieces give what large ones give."""
    monkeypatch.setattr(L, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(L, "PIECE_BYTES", piece)
    texts = ["The the cat", None, "", " É é\x0bx", "a " * 30, "unseen", "b\tb", "x" * 50] * 3
    docs = documents(spark, texts).withColumn("score", F.lit("clash")).repartition(2)
    rows = L.score_texts(docs, fold("doc_id", 7) != 2, vocabulary_size=4).collect()
    check_base(rows, dict(enumerate(texts)))


def test_no_training_rows(spark):
    docs = documents(spark, ["a b", None])
    rows = L.score_texts(docs, F.lit(False)).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows} == {
        (3, 0, 0, 0.0), (1, 0, 0, 0.0),
    }
    assert all(r["score"] < 0 for r in rows)
    assert L.score_texts(docs.limit(0), F.lit(True)).count() == 0


def test_repeated_and_null_keys(spark):
    docs = documents(spark, ["a b"]).withColumn("doc_id", F.lit(None).cast("bigint"))
    rows = L.score_texts(docs.union(docs).union(docs), F.lit(True)).collect()
    assert [(r["n_tokens"], r["train_tokens"]) for r in rows] == [(3, 9)] * 3


def test_packing():
    numbers = np.array([0, 1, 255, 256, 70_000, 2**32 - 1], dtype=np.uint32)
    assert (L.unpacked(L.packed(numbers)) == numbers).all()
    assert len(L.unpacked(L.packed(numbers[:0]))) == 0


def test_probabilities_add_up():
    """Over all symbols after any two symbols; and over the words of a class."""
    p = L.initial(np.arange(40.0), seed=1)
    rng = np.random.default_rng(2)
    p["c1"] = rng.standard_normal(p["c1"].shape).astype(np.float32)
    p["target"] *= 10
    first, second, log_z = L.scorer(p)
    for w2, w1 in [(0, 0), (3, 39), (17, 5)]:
        log_p = first[w1] + second[w2] - log_z[w2, w1]
        assert np.exp(log_p.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_words_of_a_class_add_up(spark):
    """The known words of a class and its one unseen outcome share the class's probability: texts
    of one word differ, inside a class, by the word's probability in it alone."""
    texts = ["a b", "a c", "b cc", "d ee", "a dd b", "zcc xcc", "ycc cc"]
    n = len(texts)
    known = sorted({w for t in texts for w in words(t)[:-1]})
    by_class = {}
    for w in known:
        by_class.setdefault(L.word_class(w.encode()), []).append(w)
    fresh, i = {}, 0
    while set(fresh) != set(by_class):
        if (k := L.word_class(f"u{i}".encode())) in by_class:
            fresh.setdefault(k, f"u{i}")
        i += 1
    probes = [*known, *fresh.values()]
    docs = documents(spark, texts + probes)
    rows = L.score_texts(docs, F.col("doc_id") < n, vocabulary_size=0).collect()
    score = {probes[r["doc_id"] - n]: 10 ** r["score"] for r in rows if r["doc_id"] >= n}
    counts = Counter(w for t in texts for w in words(t)[:-1])
    for k, members in by_class.items():
        total = sum(counts[w] for w in members)
        once = sum(counts[w] == 1 for w in members)
        whole = score[fresh[k]] + sum(score[w] for w in members)
        left = (once + 0.5) / (total + 1)
        assert score[fresh[k]] / whole == pytest.approx(left, rel=1e-5)
        for w in members:
            assert score[w] / whole == pytest.approx((1 - left) * counts[w] / total, rel=1e-5)


def test_spark_and_python_agree_on_classes(spark):
    listed = [b"a", b"ab", b"abc", b"abcd", "é".encode(), "aé日".encode()]
    rows = spark.createDataFrame([(bytearray(w),) for w in listed], "word binary")
    k = F.crc32(F.substring("word", -L.SUFFIX, L.SUFFIX)) % L.CLASSES
    got = {bytes(r[0]): r[1] for r in rows.select("word", k).collect()}
    assert got == {w: L.word_class(w) for w in listed}


def test_context_is_learned():
    """After b comes c, after a comes d: the trained model says so."""
    rng = np.random.default_rng(3)
    w1 = rng.integers(0, 2, 40_000)
    w = np.where(rng.random(40_000) < 0.9, w1 + 2, rng.integers(2, 4, 40_000))
    counts = np.bincount(np.concatenate((w1, w)), minlength=6).astype(float)
    trainer = L.Trainer(L.initial(counts), 1, 0.05)
    for i in range(0, 40_000, 500):
        s = slice(i, i + 500)
        trainer.step(np.full(500, 5), w1[s], w[s])
    first, second, log_z = L.scorer(trainer.p)
    p = lambda a, b: np.exp(first[a, b] + second[5, b] - log_z[5, a])
    assert p(0, 2) > 0.8 and p(1, 3) > 0.8 and p(0, 3) < 0.15


def test_scores_by_hand(spark, monkeypatch):
    """Whole scores from given parameters, token by token: symbol after two symbols, normalised over
    all symbols, and the word's share of its class."""
    rng, held = np.random.default_rng(8), {}

    def fixed(blocks, parameters, vocabulary, seed, rate):
        new = {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in parameters.items()}
        new["noise"] = parameters["noise"]
        held.update(p=new, vocabulary=vocabulary)
        return new

    monkeypatch.setattr(L, "train_round", fixed)
    texts = ["the cat sat", "the dog sat on the mat", "a cat", None, "", "new words here the cat", "sat"]
    learned = 5
    got = L.score_texts(
        documents(spark, texts).repartition(3), F.col("doc_id") < learned, vocabulary_size=3, rounds=1
    )
    p = {k: v.astype(float) for k, v in held["p"].items()}
    vocabulary = held["vocabulary"]
    counts = Counter(w for t in texts[:learned] for w in words(t))
    rest = {w: n for w, n in counts.items() if w.encode() not in vocabulary}
    in_class = lambda w: L.word_class(w.encode())

    def symbol(w):
        return vocabulary.get(w.encode(), len(vocabulary) + in_class(w))

    def log_p(w2, w1, w):
        query = p["context"][symbol(w1)] @ p["c1"] + p["context"][symbol(w2)] @ p["c2"]
        every = p["target"] @ query + p["bias"]
        out = every[symbol(w)] - math.log(sum(math.exp(x) for x in every))
        if w.encode() in vocabulary:
            return out
        same = [n for x, n in rest.items() if in_class(x) == in_class(w)]
        left = (sum(n == 1 for n in same) + 0.5) / (sum(same) + 1) if same else 1.0
        share = (1 - left) * rest[w] / sum(same) if w in rest else left
        return out + math.log(share)

    for r in got.collect():
        w = ["\n", "\n", *words(texts[r["doc_id"]])]
        want = sum(log_p(*w[i - 2 : i + 1]) for i in range(2, len(w))) / math.log(10)
        assert r["score"] == pytest.approx(want, rel=1e-4)


def test_rows_have_numbers_of_their_own(spark):
    """Many equal rows over several tasks, keys repeated: none is lost or added to another."""
    docs = documents(spark, ["same text"] * 500).withColumn("doc_id", F.lit(1).cast("bigint"))
    rows = L.score_texts(docs.repartition(7), F.lit(True), rounds=1).collect()
    assert len(rows) == 500 and {r["n_tokens"] for r in rows} == {3}


def test_symbols_of_an_arrow_array():
    """Words stay in Arrow: those listed by place, others by their last bytes, short ones too."""
    vocabulary = {L.END: 0, b"the": 1, b"of": 2}
    words = [b"of", b"a", b"bc", b"walking", b"\xc3\xa9", L.END, b"the", b"king", b""]
    found = L._symbols(pa.array(words, pa.binary()), vocabulary)
    want = [vocabulary.get(w, len(vocabulary) + zlib.crc32(w[-3:]) % L.CLASSES) for w in words]
    assert found.dtype == np.int32 and found.tolist() == want
    assert L._symbols(pa.array([L.END], pa.binary()), vocabulary).tolist() == [0]


@pytest.mark.parametrize("spread", [1, 5, 300, 5000])
def test_sums_are_those_of_whole_runs(spread):
    """The same bits as adding every run by itself, for runs of any length."""
    rng = np.random.default_rng(spread)
    trainer = L.Trainer(L.initial(np.ones(6000)), 1, 0.05)
    at = (rng.random(4096) ** 3 * spread).astype(np.int32)
    rows = rng.standard_normal((4096, L.WIDTH)).astype(np.float32)
    want = np.zeros((6000, L.WIDTH), np.float32)
    for symbol in np.unique(at):
        want[symbol] = np.add.reduceat(rows[at == symbol], [0], axis=0)[0]
    assert trainer._sums("x", at, rows).tobytes() == want.tobytes()


def test_sums_in_one_go_are_those_of_each():
    """Places behind the rows take the last rows again; the bits are those of separate sums."""
    rng = np.random.default_rng(4)
    trainer = L.Trainer(L.initial(np.ones(700)), 1, 0.05)
    a, b, c = ((rng.random(900) ** 3 * 700).astype(np.int32) for _ in range(3))
    x, y = rng.standard_normal((2, 900, L.WIDTH)).astype(np.float32)
    want = [trainer._sums("w", at, rows).copy() for at, rows in ((a, x), (b, y), (c, y))]
    every = np.concatenate((a, b + 700, c + 1400))
    got = trainer._sums("g", every, np.concatenate((x, y)), 2100)
    assert got.tobytes() == np.concatenate(want).tobytes()


def test_a_step_adds_rows_up_once(monkeypatch):
    calls, sums = [], L.Trainer._sums
    monkeypatch.setattr(L.Trainer, "_sums", lambda *a: calls.append(a[1]) or sums(*a))
    trainer, at = L.Trainer(L.initial(np.ones(9)), 1, 0.05), np.arange(9)
    trainer.step(at, at, at)
    assert len(calls) == 1


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_word_counts(spark, monkeypatch, buckets):
    """Words move by bucket, not one a row, and every word of a block gets its whole count."""
    monkeypatch.setattr(L, "BLOCK_TOKENS", 40)
    monkeypatch.setattr(L, "BUCKETS", buckets)
    texts = [f"The w{i % 5} v{i} é\x0b\x1ct{i % 2}" for i in range(60)] + ["held out", None, ""]
    docs = documents(spark, texts).repartition(3)
    blocks = L.token_blocks(docs, "text", "doc_id", F.col("doc_id") < 60)
    counted = L.word_counts(blocks)
    want = Counter(w.encode() for t in texts[:60] for w in words(t))
    totals = counted.where("block is null").select(F.inline("totals")).collect()
    assert len(totals) == len(want) and {bytes(r["word"]): r["c"] for r in totals} == want
    own = {(r["block"], r["bucket"]): r["counts"] for r in counted.where("block >= 0").collect()}
    stored = blocks.collect()
    assert len(stored) > 3 and len(own) == sum(len(r["words"]) for r in stored)
    assert all(len(r["words"]) <= buckets for r in stored)
    for r in stored:
        for held in r["words"]:
            c = np.frombuffer(own[r["block"], held["bucket"]], "<i8")
            assert c.tolist() == [want[bytes(w)] for w in held["words"].split(b" ")]
