from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearsay.llm import alignment
from hearsay.llm.queries import op11_cross_tokenizer_alignment

from .helpers import documents

BYTE_FILE, PIECE_FILE = alignment.default_paths()


@pytest.fixture(scope="module")
def encoders():
    """Ids and bytes of the tokens by the libraries that the files belong to."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(BYTE_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)

    def of_a(text):
        got = a.encode(" " + text, add_special_tokens=False)
        assert decoders.ByteLevel().decode(got.tokens) == " " + text
        # One character stands for one byte.
        return [(i, len(t)) for i, t in zip(got.ids, got.tokens)]

    def of_b(text):
        out = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            raw = bytes([int(piece[3:5], 16)]) if b.is_byte(i) else None
            out.append((i, piece.replace("▁", " ").encode() if raw is None else raw))
        if b"".join(x for _, x in out) != (" " + text).encode():
            return None
        return [(i, len(x)) for i, x in out]

    return of_a, of_b


def spans(tokens):
    out, at = [], 0
    for i, n in tokens:
        out.append((i, at, at + n))
        at += n
    return out


def plain(texts, encoders):
    """The contract's columns, token by token."""
    docs = []
    for text in texts:
        a = b = []
        if text and encoders[1](text) is not None:
            a, b = spans(encoders[0](text)), spans(encoders[1](text))
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = [
            ",".join(str(i) for i, _, e in a if lo < e <= hi)
            + "|"
            + ",".join(str(i) for i, _, e in b if lo < e <= hi)
            for lo, hi in zip([0, *cuts], cuts)
        ]
        docs.append((len(a), len(b), groups, links))
    count = Counter(p for *_, links in docs for p in set(links))
    most: dict = {}
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    return [
        (
            a, b, len(groups), len(links), sum(count[p] == most[p[0]] for p in links),
            sum(count[p] for p in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for a, b, groups, links in docs
    ]


TEXTS = [
    None, "", " ", "a", "Hello, wide world!", "Hello, wide world!", "the the the the the cat",
    "Ünïcödé — naïve café, 漢字 and 🙂🙂", "line\nbreak\ttab  two   spaces", "<|endoftext|> <s> </s>",
    "▁ is a mark of its own", "unbroken" * 200, "x" * 300, "é́ \x00 �",
]
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_brute_force(spark, encoders):
    rng = random.Random(3)
    words = "alpha Beta gamma delta überall señor naïve 12345 l'eau don't".split()
    texts = TEXTS + [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(60)]
    docs = documents(spark, texts).repartition(5).withColumns(
        {"a": F.lit("x"), "pos": F.lit(0), "block": F.lit(1), "bits": F.lit(None).cast("string")}
    )
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align_documents(docs).collect()}
    assert got == dict(enumerate(plain(texts, encoders)))


@pytest.mark.parametrize("entries,chunk", [(1, 1), (40, 30), (1 << 20, 1 << 20)])
def test_blocks_of_any_size(spark, encoders, entries, chunk):
    docs = documents(spark, TEXTS).repartition(3)
    index = alignment.build_index(docs, block_entries=entries, chunk_bytes=chunk)
    got = {r[alignment.KEY]: tuple(r[c] for c in COLUMNS) for r in alignment.scores(index).collect()}
    assert got == dict(enumerate(plain(TEXTS, encoders)))


def test_pair_counts(spark, encoders):
    texts = ["the the cat", "the dog", "The cat the cat"]
    index = alignment.build_index(documents(spark, texts))
    links = [
        [(x[0], y[0]) for x in spans(encoders[0](t)) for y in spans(encoders[1](t))
         if x[1] < y[2] and y[1] < x[2]]
        for t in texts
    ]
    docs = Counter(p for x in links for p in set(x))
    every = Counter(p for x in links for p in x)
    got = {(r["a"], r["b"]): (r["docs"], r["links"]) for r in alignment.pair_counts(index).collect()}
    assert got == {p: (docs[p], every[p]) for p in every}


@pytest.mark.parametrize("n_docs", [1, 7, 8, 200, 5000, 1 << 16])
def test_postings_round_trip(n_docs):
    rng = np.random.default_rng(n_docs)
    pos, links, starts = [], [], [0]
    for _ in range(40):
        n = int(rng.integers(1, n_docs + 1)) if rng.random() < 0.3 else int(min(n_docs, rng.integers(1, 20)))
        pos.append(np.sort(rng.choice(n_docs, n, replace=False)))
        links.append(np.where(rng.random(n) < 0.7, 1, rng.integers(1, 5000, n)))
        starts.append(starts[-1] + n)
    starts = np.array(starts)
    offsets, data = alignment.pack(starts, np.concatenate(pos), np.concatenate(links), n_docs)
    row, doc, many = alignment.unpack(np.diff(starts), offsets, data, n_docs)
    assert (row == np.repeat(np.arange(40), np.diff(starts))).all()
    assert (doc == np.concatenate(pos)).all() and (many == np.concatenate(links)).all()
    assert len(data) <= 2 * len(doc) + sum(len(p) * 13 / 8 + 13 for p in pos)


def test_file_of_another_form_uses_its_own_library(tmp_path):
    """Ids out of the order of merges: the rank form would not do."""
    import json

    with open(BYTE_FILE, encoding="utf-8") as file:
        spec = json.load(file)
    vocab = spec["model"]["vocab"]
    first, second = (k for k, v in vocab.items() if v in (300, 301))
    vocab[first], vocab[second] = vocab[second], vocab[first]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    plain_, other = alignment.ByteTokenizer(BYTE_FILE), alignment.ByteTokenizer(str(path))
    text = " the and of in to " + plain_.bytes[300].decode() + plain_.bytes[301].decode()
    swap = {300: 301, 301: 300}
    assert other.encode(text) == [swap.get(i, i) for i in plain_.encode(text)]


def test_null_and_repeated_keys_and_empty_table(spark, encoders):
    schema = "doc_id bigint, text string"
    rows = [(None, "one two"), (None, "one two"), (3, "three"), (3, "three"), (3, None)]
    got = alignment.align_documents(spark.createDataFrame(rows, schema)).collect()
    want = [(str(i), *w) for (i, _), w in zip(rows, plain([t for _, t in rows], encoders))]
    assert sorted((str(r["doc_id"]), *(r[c] for c in COLUMNS)) for r in got) == sorted(want)
    assert alignment.align_documents(spark.createDataFrame([], schema)).count() == 0


def test_query(spark, encoders):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = op11_cross_tokenizer_alignment(spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), *((c, "bigint") for c in COLUMNS[:-1]), (COLUMNS[-1], "string")]
    rows = sorted(rows)
    # Long texts make the token-by-token form slow, so pairs there come from a walk over spans.
    want = walk([r["text"] for r in rows], encoders)
    assert sorted(got.collect()) == [(r["doc_id"], *w) for r, w in zip(rows, want)]


def walk(texts, encoders):
    docs = []
    for text in texts:
        a, b = spans(encoders[0](text)), spans(encoders[1](text))
        links, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            links.append((a[i][0], b[j][0]))
            end_a, end_b = a[i][2], b[j][2]
            i, j = i + (end_a <= end_b), j + (end_b <= end_a)
        groups, ga, gb, both = [], [], [], {x[2] for x in a} & {y[2] for y in b}
        j = 0
        for i, _, end in a:
            ga.append(str(i))
            while j < len(b) and b[j][2] <= end:
                gb.append(str(b[j][0]))
                j += 1
            if end in both:
                groups.append(",".join(ga) + "|" + ",".join(gb))
                ga, gb = [], []
        docs.append((len(a), len(b), groups, links))
    count = Counter(p for *_, links in docs for p in set(links))
    most: dict = {}
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    return [
        (
            a, b, len(groups), len(links), sum(count[p] == most[p[0]] for p in links),
            sum(count[p] for p in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for a, b, groups, links in docs
    ]
