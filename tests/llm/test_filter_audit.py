from __future__ import annotations

import itertools
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from hearsay.llm import filter_audit
from hearsay.llm.queries import LLM_ORACLES, op13_filter_audit

COLUMNS = ["part", "filter_order", "step", *filter_audit.LONGS]
DOC = "doc_id bigint, text string, source string, part string, mask int, n int, good string"


def failures_of(rows):
    """Letters that each ``(doc_id, text, source)`` fails."""
    out = []
    for key, text, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": key is not None
            and any(k is not None and k < key and (u or "") == t for k, u, _ in rows),
        }
        out.append({x for x, bad in fails.items() if bad})
    return out


def plain(rows, labels):
    """Every order applied filter by filter to the documents themselves."""
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, x in labels if x == 1 and k is not None}
    fails = failures_of(rows)
    out = []
    for part in {r[2] or "" for r in rows}:
        docs = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        found, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                before = sum(x in f for _, f in docs) - len(gone)
                left = [d for d in left if x not in d[1]]
                shapley[x] += len(gone)
                found.append(
                    (
                        part, "".join(order), step, len(left), len(gone), before,
                        sum(f == {x} for _, f in docs), sum(k in good for k, _ in gone),
                        sum(k in toxic for k, _ in gone), x,
                    )
                )
        out += [(*r[:-1], shapley[r[-1]]) for r in found]
    return sorted(out)


def made_up(rng, n):
    words = ["alpha", "Beta", "GAMMA", "über", "a|b", "　", "cost$", "x"]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.25 and rows:
            text = rng.choice(rows)[1]
        elif kind < 0.5:
            text = " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(150, 260)))
        else:
            pick = rng.sample(words, rng.randrange(1, 5))
            text = rng.choice(" \t\n").join(rng.choices(pick, k=rng.randrange(1, 400)))
        rows.append((rng.choice([i, i, i, i // 2, None]), text, rng.choice(["s0", "s0", "s1", None])))
    return rows + [(900, None, "s1"), (901, "", "s0"), (902, None, ""), (903, " \t ", "only")]


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 7, 7, "x") for r in rows], DOC).repartition(4)
    marks = spark.createDataFrame(
        [(*x, "text", "s") for x in labels],
        "doc_id bigint, quality int, toxic int, text string, part string",
    )
    return docs, marks


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = made_up(rng, 120)
    keys = [k for k, *_ in rows] + [5, 5, None, 10_000]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in keys if rng.random() < 0.6]
    got = filter_audit.audit_documents(*frames(spark, rows, labels))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == plain(rows, labels)


def test_empty_tables(spark):
    docs, labels = frames(spark, [], [])
    assert filter_audit.audit_documents(docs, labels).count() == 0
    rows = [(1, "a", "s")]
    docs, labels = frames(spark, rows, [])
    got = filter_audit.audit_documents(docs, labels)
    assert sorted(map(tuple, got.collect())) == plain(rows, [])


@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_visit_every_order_once(n):
    order = list(range(n))
    seen = {tuple(order)}
    for at in filter_audit.adjacent_swaps(n):
        order[at], order[at + 1] = order[at + 1], order[at]
        seen.add(tuple(order))
    assert len(seen) == math.factorial(n)
    assert sum(1 for _ in filter_audit.adjacent_swaps(n)) == math.factorial(n) - 1


def test_diagram_stays_reduced_and_equal():
    """After any swaps: the diagram of the same masks in that order, node for node."""
    rng = random.Random(4)
    counts = {m: (rng.randrange(1, 4), rng.randrange(2)) for m in rng.sample(range(64), 40)}
    diagram = filter_audit.Diagram(counts, 6)
    size = lambda d: [len(level) for level in d.levels]
    for at in itertools.chain(filter_audit.adjacent_swaps(6), [0, 4, 2, 2]):
        diagram.swap(at)
        turned = {
            sum(1 << k for k, bit in enumerate(diagram.order) if m >> bit & 1): c
            for m, c in counts.items()
        }
        again = filter_audit.Diagram(turned, 6)
        assert size(again) == size(diagram)
        assert [x[1:] for x in again.steps()] == [x[1:] for x in diagram.steps()]
    assert len(diagram.children) < 64


def test_other_filters(spark):
    rows = [(i, "ab"[i % 2] * (i % 5), "s") for i in range(20)]
    docs, labels = frames(spark, rows, [])
    got = filter_audit.audit_documents(
        docs, labels, failures={"x": F.length("text") > 2, "y": F.col("text").contains("a")}
    )
    first = got.where("filter_order = 'xyE' AND step = 1").first()
    assert first["removed"] == sum(len(t) > 2 for _, t, _ in rows)
    assert got.count() == 6 * 3
    with pytest.raises(ValueError):
        filter_audit.audit(got, "abcdefgh")


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_sql_twin(spark, sf):
    con, folder = duckdb.connect(), f"/root/testdata/sf{sf}"
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = op13_filter_audit(spark, folder)
    want = con.execute(LLM_ORACLES["op13_filter_audit"])
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
