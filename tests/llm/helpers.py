"""Brute-force pieces that several tests share."""

from __future__ import annotations

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def components(nodes, links):
    """Node -> least node reachable."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def documents(spark, texts, **more):
    """Documents with ids from 0, and defaults for the other columns."""
    rows = [
        (i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOC)


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """``[(source, size, target)]`` in order of code points, null last: shares by weight, limits
    applied and the rest shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and left * weight[s] > most * sizes[s] * share}
        if not over:
            break
        full |= over
    return [
        (s, sizes[s], float(most * sizes[s]) if s in full else left * weight[s] / share)
        for s in order
    ]
