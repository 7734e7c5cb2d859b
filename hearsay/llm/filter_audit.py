"""What each filter removes, in every order of the filters, by part of the corpus.

A document's failures are a mask with one bit a filter. The masks of a part, counted, are drawn as a
decision diagram: a level a filter, an edge for passing and one for failing, equal sub-diagrams
shared, and at every node the counts of the documents below it. Exchanging two neighbouring levels
rewrites only the nodes of these two, and a walk of such exchanges visits every order. In each, the
path on which all filters are passed has at its nodes what is kept after each step, and beside it
what that step removes.

Only counts by part and mask reach a diagram (at most 32 rows a part for five filters), so a part
that holds most documents takes no longer than any other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.operators.scratch import store

MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 2
SYMBOLS = "#$%&*|"
WHITE = " \t\n\x0b\x0c\r"
REPEATED = "E"
#: Orders, and so result rows a part, grow with the factorial of the filters.
MAX_FILTERS = 7

Counts = tuple[int, ...]


def text_failures(text: str = "text") -> dict[str, Column]:
    """The filters that need only the text; null counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(whole, F.lit(WHITE))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    n = F.when(trimmed == "", 0).otherwise(F.size(words))
    distinct = F.when(trimmed == "", 0).otherwise(F.size(F.array_distinct(words)))
    upper = F.length(F.regexp_replace(whole, "[^A-Z]+", ""))
    return {
        "A": n < MIN_WORDS,
        "B": 100 * distinct.cast("bigint") < MIN_DISTINCT_PERCENT * n.cast("bigint"),
        "C": 100 * upper.cast("bigint") > MAX_UPPER_PERCENT * F.length(whole).cast("bigint"),
        "D": whole.rlike(f"[{SYMBOLS}]"),
    }


def mask_counts(
    docs: DataFrame,
    labels: DataFrame,
    failures: dict[str, Column],
    text: str = "text",
    key: str = "doc_id",
    part: str = "source",
) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by part and mask, and those of them that a label
    of their key marks as quality 1 or toxic 1 (any of its labels, if it has several).

    Bit i of ``mask`` is the i-th of ``failures``; the bit after them is set for a text that a row
    with a smaller key has too, anywhere in the table. Null parts and texts count as empty. A null
    key is smaller and larger than none and has no label. Repeated rows are documents of their own.
    """
    bits = sum((c.cast("int") * (1 << i) for i, c in enumerate(failures.values())), F.lit(0))
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = store(
        docs.select(
            F.col(key).alias("_key"),
            F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(whole, 256)).alias("digest"),
            bits.alias("bits"),
        ),
        "failures",
    )
    # Joined on text and key, so the rows of one text are not gathered in one task.
    first = (
        rows.groupBy("digest")
        .agg(F.min("_key").alias("_key"))
        .where("_key IS NOT NULL")
        .withColumn("first", F.lit(True))
    )
    marked = (
        labels.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(
            F.max((F.col("quality") == 1).cast("int")).alias("good"),
            F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
        )
    )
    repeated = (F.col("first").isNull() & F.col("_key").isNotNull()).cast("int")
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("bigint").alias(c)
    return (
        rows.join(first, ["digest", "_key"], "left")
        .join(marked, "_key", "left")
        .withColumn("mask", F.col("bits") + repeated * (1 << len(failures)))
        .groupBy("part", "mask")
        .agg(F.count("*").alias("n"), total("good"), total("toxic"))
    )


class Diagram:
    """Counts of failure masks as a decision diagram over ``order``, a permutation of the bits.

    Node 0 stands for no documents at any level. Any other node has its children for passing and
    failing, and the counts of all documents below. Two nodes never have the same documents by
    mask: they would be one.
    """

    def __init__(self, counts: dict[int, Counts], filters: int):
        self.order = list(range(filters))
        self.zero: Counts = tuple(0 for _ in next(iter(counts.values()), (0,)))
        self.last = 0
        self.children: dict[int, tuple[int, int]] = {0: (0, 0)}
        self.weight: dict[int, Counts] = {0: self.zero}
        self.levels: list[dict[tuple[int, int], int]] = [{} for _ in range(filters)]
        leaves: dict[Counts, int] = {self.zero: 0}
        below = {}
        for mask, count in counts.items():
            if count not in leaves:
                leaves[count] = self._new((0, 0), count)
            below[mask] = leaves[count]
        # From the last filter up: masks without the bits of the levels done.
        for level in range(filters - 1, -1, -1):
            bit, above = 1 << level, {}
            for mask in {m & ~bit for m in below}:
                pair = below.get(mask, 0), below.get(mask | bit, 0)
                above[mask] = self._node(level, pair)
            below = above
        self.root = below.get(0, 0)

    def _new(self, pair: tuple[int, int], weight: Counts) -> int:
        self.last += 1
        self.children[self.last], self.weight[self.last] = pair, weight
        return self.last

    def _node(self, level: int, pair: tuple[int, int]) -> int:
        if pair == (0, 0):
            return 0
        known = self.levels[level]
        if pair not in known:
            a, b = self.weight[pair[0]], self.weight[pair[1]]
            known[pair] = self._new(pair, tuple(x + y for x, y in zip(a, b)))
        return known[pair]

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next. Nodes of ``level`` keep their number, so
        nothing above changes; those of the next level are made anew."""
        upper, old = self.levels[level], self.levels[level + 1]
        self.levels[level], self.levels[level + 1] = {}, {}
        for passed, failed in list(upper):
            node = upper[passed, failed]
            (pp, pf), (fp, ff) = self.children[passed], self.children[failed]
            pair = self._node(level + 1, (pp, fp)), self._node(level + 1, (pf, ff))
            self.children[node] = pair
            self.levels[level][pair] = node
        for node in old.values():
            del self.children[node], self.weight[node]
        order = self.order
        order[level], order[level + 1] = order[level + 1], order[level]

    def steps(self) -> list[tuple[int, Counts, Counts]]:
        """Of each step its filter, the counts kept after it and those removed by it."""
        out, node = [], self.root
        for bit in self.order:
            passed, failed = self.children[node]
            out.append((bit, self.weight[passed], self.weight[failed]))
            node = passed
        return out


def adjacent_swaps(n: int) -> Iterator[int]:
    """Positions whose exchange with the next, one after another, visits all orders of ``n``."""
    order, left = list(range(n)), [True] * n
    while True:
        # The largest element that has a smaller one on the side it moves to.
        for x in range(n - 1, 0, -1):
            at = order.index(x)
            to = at - 1 if left[x] else at + 1
            if 0 <= to < n and order[to] < x:
                break
        else:
            return
        order[at], order[to] = order[to], order[at]
        for y in range(x + 1, n):
            left[y] = not left[y]
        yield min(at, to)


def audit_part(counts: dict[int, Counts], names: str) -> Iterable[tuple]:
    """``(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley)`` for every order of the filters ``names`` and every step."""
    n = len(names)
    diagram = Diagram(counts, n)
    fails = [sum(c[0] for m, c in counts.items() if m >> i & 1) for i in range(n)]
    alone = [counts.get(1 << i, diagram.zero)[0] for i in range(n)]
    found, swaps = [], adjacent_swaps(n)
    while True:
        order = "".join(names[i] for i in diagram.order)
        found += [(order, k, *x) for k, x in enumerate(diagram.steps(), 1)]
        at = next(swaps, None)
        if at is None:
            break
        diagram.swap(at)
    shapley = [0] * n
    for _, _, bit, _, removed in found:
        shapley[bit] += removed[0]
    for order, k, bit, kept, removed in found:
        redundant = fails[bit] - removed[0]
        yield (
            order, k, kept[0], removed[0], redundant, alone[bit], removed[1], removed[2],
            shapley[bit],
        )


LONGS = [
    "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
]
SCHEMA = T.StructType(
    [
        T.StructField("part", T.StringType()),
        T.StructField("filter_order", T.StringType()),
        T.StructField("step", T.IntegerType()),
        *(T.StructField(c, T.LongType()) for c in LONGS),
    ]
)


def audit(counts: DataFrame, names: str) -> DataFrame:
    """One row for each part, order of the filters and step, from ``part, mask, n, good, toxic``.
    ``names`` has a letter for each bit of the masks, seven at most. No parts, no rows."""
    if not 0 < len(names) <= MAX_FILTERS:
        raise ValueError(f"one to {MAX_FILTERS} filters, for every order of them has rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                masks = {m["mask"]: (m["n"], m["good"], m["toxic"]) for m in part["masks"]}
                columns = list(zip(*((part["part"], *x) for x in audit_part(masks, names))))
                kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * len(LONGS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=SCHEMA.names
                )

    masks = F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks")
    return counts.groupBy("part").agg(masks).mapInArrow(run, SCHEMA)


def audit_documents(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    part: str = "source",
    failures: dict[str, Column] | None = None,
) -> DataFrame:
    """Audit of the text filters (``text_failures`` unless others are given, by letter) and of the
    repeated texts, which are called E. Other columns of either table play no part."""
    failures = text_failures(text) if failures is None else failures
    counts = mask_counts(docs, labels, failures, text, key, part)
    return audit(counts, "".join(failures) + REPEATED)
