"""Embedding near-duplicates by p-stable hashing of normalised vectors.

Each table joins HASHES quantised Gaussian projections floor((a.v + b) / WIDTH) to one bucket
number; near vectors share a bucket in some table with high probability. Vectors that share one are
compared by exact cosine in double precision. A pair counts in the first table that brings it
together, so counts need no list of pairs, and each bucket sends on a spanning forest of its links.

At cosine 0.93 (distance 0.374) one projection agrees with probability 0.85, a table with 0.105 and
some of 24 tables with 0.93; at cosine 0.97 it is over 0.99. Vectors at right angles meet in a table
with probability 4e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.operators.scratch import store

from .common import least_reachable

THRESHOLD = 0.93
TABLES = 24
HASHES = 14
WIDTH = 2.0
GROUP = 1000
BLOCK = 256


def _codes(vectors: np.ndarray, tables: int, hashes: int, width: float, seed: int) -> np.ndarray:
    """Bucket numbers (rows x tables) of unit vectors; fixed by dimension and seed."""
    rng = np.random.default_rng([seed, vectors.shape[1]])
    planes = rng.standard_normal((vectors.shape[1], tables * hashes))
    shift = rng.uniform(0, width, tables * hashes)
    cells = np.floor((vectors @ planes + shift) / width).astype(np.int64).astype(np.uint64)
    cells = cells.reshape(len(vectors), tables, hashes)
    mixed = np.full(cells.shape[:2], 0x9E3779B97F4A7C15, dtype=np.uint64)
    for k in range(hashes):
        mixed = (mixed ^ cells[:, :, k]) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def _coded(classes: DataFrame, tables: int, hashes: int, width: float, seed: int) -> DataFrame:
    """Add ``codes`` to the distinct vectors, which become lists of doubles of length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(x, float) for x in batch.column(1).to_pylist()]
            vectors = [x / np.abs(x).max() for x in vectors]
            vectors = [x / np.sqrt(x @ x) for x in vectors]
            codes: list = [None] * len(vectors)
            by_size: dict[int, list[int]] = {}
            for i, x in enumerate(vectors):
                by_size.setdefault(len(x), []).append(i)
            for rows in by_size.values():
                found = _codes(np.array([vectors[i] for i in rows]), tables, hashes, width, seed)
                for i, c in zip(rows, found):
                    codes[i] = c
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(vectors, pa.list_(pa.float64())),
                    pa.array(codes, pa.list_(pa.int64())),
                    *batch.columns[2:],
                ],
                names=["cid", "unit", "codes", "label", "size"],
            )

    return classes.select("cid", "embedding", "label", "size").mapInArrow(
        run, "cid bigint, unit array<double>, codes array<bigint>, label string, size bigint"
    )


def compare_group(
    sizes: np.ndarray,
    vectors: np.ndarray,
    codes: np.ndarray,
    side: np.ndarray,
    table: int,
    threshold: float,
) -> tuple[np.ndarray, np.ndarray]:
    """For each member the rows it is linked to here for the first time, and the least member (by
    position) it is connected to through them. ``side`` is 2 for all members, or 0 and 1 where
    only members of different sides are to be compared."""
    n = len(sizes)
    crossed = side[0] != 2
    linked = np.zeros((n, n), dtype=bool)
    for start in range(0, n, BLOCK):
        rows = slice(start, min(start + BLOCK, n))
        near = vectors[rows] @ vectors.T >= threshold
        near[np.arange(near.shape[0]), np.arange(start, rows.stop)] = False
        if crossed:
            near &= side[rows, None] != side[None, :]
        if table and near.any():
            i, j = np.nonzero(near)
            for k in range(0, len(i), 1 << 18):
                a, b = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
                met = (codes[start + a, :table] == codes[b, :table]).any(axis=1)
                near[a[met], b[met]] = False
        linked[rows] = near
    counts = linked @ sizes
    least = np.arange(n)
    while True:
        # Least label among the neighbours, then labels of labels.
        best = least.copy()
        for start in range(0, n, BLOCK):
            rows = slice(start, min(start + BLOCK, n))
            around = np.where(linked[rows], least[None, :], n).min(axis=1)
            best[rows] = np.minimum(best[rows], around)
        best = best[best]
        if (best == least).all():
            return counts, least
        least = best


def _groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal ``g`` in sorted batches, also where a run goes over a batch's end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        if held and held[-1].column(0)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b < len(keys):
                yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
                held = []
            else:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _compared(members: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups_of(batches):
            if group.num_rows < 2:
                continue
            group = group.combine_chunks()
            ids = group.column("cid").to_numpy()
            n = len(ids)
            flat = lambda c: group.column(c).chunk(0).flatten().to_numpy().reshape(n, -1)
            counts, least = compare_group(
                group.column("size").to_numpy(),
                flat("unit"),
                flat("codes"),
                group.column("side").to_numpy(),
                group.column("t")[0].as_py(),
                threshold,
            )
            at = np.flatnonzero(counts)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.array(counts[at]), pa.array(ids[least[at]])],
                    names=["cid", "links", "root"],
                )

    # Every group has a number of its own and at most twice GROUP members or so.
    return (
        members.select("g", "t", "side", "cid", "size", "unit", "codes")
        .repartition("g")
        .sortWithinPartitions("g", "cid")
        .mapInArrow(run, "cid bigint, links bigint, root bigint")
    )


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    tables: int = TABLES,
    hashes: int = HASHES,
    width: float = WIDTH,
    group: int = GROUP,
    seed: int = 42,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``key``, ``n_links`` (other rows linked directly), ``component_id`` (smallest key reachable)
    and ``kept`` (whether it is the row's own key) of every row.

    Rows link when their labels are equal and not null, their lengths are equal and the cosine is at
    least ``threshold``. Null, empty and zero vectors and those with a null or non-finite component
    link with nothing. Equal vectors are compared once and counted as often as they occur. A
    bucket of more than ``group`` different vectors is cut into parts, and each pair of parts
    is compared as a group of its own. A null key is linked like others, but is a component's
    id only if all its keys are null.
    """
    numbers = F.col("_v")
    usable = (
        F.col("_label").isNotNull()
        & numbers.isNotNull()
        & F.coalesce(F.size(numbers) > 0, F.lit(False))
        & F.coalesce(
            F.forall(
                numbers,
                lambda x: x.isNotNull()
                & ~F.isnan(x)
                & (F.abs(x) != F.lit(float("inf"))),
            ),
            F.lit(False),
        )
        & F.coalesce(F.exists(numbers, lambda x: x != 0), F.lit(False))
    )
    rows = vectors.select(
        F.col(key).alias("_key"),
        F.col(label).cast("string").alias("_label"),
        F.col(vector).cast("array<double>").alias("_v"),
    ).withColumn("ok", usable)
    # A vector's class: label and 128 bits of hash.
    classed = rows.withColumns(
        {
            "h1": F.when(F.col("ok"), F.xxhash64("_label", "_v")),
            "h2": F.when(F.col("ok"), F.xxhash64(F.lit(1), "_v", "_label")),
        }
    )
    narrow = store(classed.select("_key", "ok", "h1", "h2"), "vectors")
    classes = store(
        classed.where("ok")
        .groupBy("h1", "h2")
        .agg(
            F.first("_label").alias("label"),
            F.first("_v").alias("embedding"),
            F.count("*").alias("size"),
            F.min("_key").alias("first_key"),
        )
        .withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    coded = store(_coded(classes, tables, hashes, width, seed), "coded")
    bucket = ["label", "dim", "t", "code"]
    members = coded.select(
        "cid", "label", F.size("unit").alias("dim"), F.posexplode("codes").alias("t", "code")
    )
    full = store(
        members.groupBy(*bucket)
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .withColumns(
            {"b": F.monotonically_increasing_id(), "parts": F.ceil(F.col("n") / group)}
        ),
        "buckets",
    )
    part = F.pmod(F.xxhash64("cid", "t"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    dealt = (
        members.join(full, bucket)
        .select("cid", "t", "b", part.alias("part"), other.alias("other"))
        .select(
            "cid",
            "t",
            F.xxhash64("b", F.least("part", "other"), F.greatest("part", "other")).alias("g"),
            F.when(F.col("part") == F.col("other"), 2)
            .otherwise((F.col("part") > F.col("other")).cast("int"))
            .alias("side"),
        )
    )
    compared = store(_compared(dealt.join(coded, "cid"), threshold), "compared")
    totals = compared.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = least_reachable(
        compared.select(F.col("cid").alias("a"), F.col("root").alias("b"))
    ).withColumnRenamed("node", "cid")
    rooted = store(
        classes.join(totals, "cid", "left")
        .join(roots, "cid", "left")
        .select(
            "h1",
            "h2",
            "first_key",
            (F.coalesce("links", F.lit(0)) + F.col("size") - 1).cast("bigint").alias("n_links"),
            F.coalesce("root", "cid").alias("root"),
        ),
        "rooted",
    )
    whole = rooted.groupBy("root").agg(F.min("first_key").alias("component_id"))
    table = store(
        rooted.join(whole, "root").select("h1", "h2", "n_links", "component_id"), "components"
    )
    alone = narrow.where("NOT ok").select(
        "_key", F.lit(0).cast("bigint").alias("n_links"), F.col("_key").alias("component_id")
    )
    linked = narrow.where("ok").join(table, ["h1", "h2"]).select("_key", "n_links", "component_id")
    kept = F.coalesce(F.col("_key") == F.col("component_id"), F.lit(False)).alias("kept")
    return linked.union(alone).select(F.col("_key").alias(key), "n_links", "component_id", kept)
