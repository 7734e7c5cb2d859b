"""Nearest neighbours by cosine with a hierarchical small-world graph for each shard.

Different vectors are dealt to shards of about ``shard_rows`` by hash. A shard's graph is built in
one task and stored row by row: a node's vector and its neighbours as one flat array of positions,
layer after layer, each of a fixed width and filled up with -1. To search, the nodes of a shard and
the queries are brought together; each shard gives its nearest rows with their exact cosines, and
the best of all shards are the result.

Everything runs on whole blocks of vectors in numpy. Nodes are linked in batches that double with
the graph: a batch is searched in the graph as it stands, the members of a batch see each other as
further candidates, and then all its links are made. Levels come from a hash of the vector, so a
task that runs again makes the same graph.

Equal vectors are one node that keeps the k + 1 smallest ids of its rows: ties go to the smaller id,
so no other row of them can be among the k nearest of any query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearsay.operators.scratch import store

#: Different vectors of a shard. Search takes time in proportion to the number of shards, so large
#: tables want larger ones; a shard of d dimensions takes some (12 d + 500) bytes a row in a task.
SHARD_ROWS = 8192
LINKS = 16
BUILD_BEAM = 80
SEARCH_BEAM = 128
#: Nodes that each query opens at a time, and the batch sizes of building and searching.
OPEN = 3
BATCH = 256
LEVELS = 6


def levels_of(n: int, links: int, seed: int) -> np.ndarray:
    """Top layer of each of ``n`` nodes, highest first: on average one in ``links`` goes up one."""
    draws = np.random.default_rng([seed, n]).random(n)
    top = np.floor(-np.log(1 - draws) / np.log(links)).astype(np.int64)
    return -np.sort(-np.minimum(top, LEVELS - 1))


def beam_search(
    vectors: np.ndarray, near: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes found for each query, best first (-1 where there are fewer), and
    their products. ``near`` has a row of neighbours for each node, filled up with -1; ``entry``
    a row of starting nodes for each query, filled up likewise. All queries go on together."""
    n, rows = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((n, len(vectors) + 1), dtype=bool)  # the last column is that of -1
    seen[:, -1] = True

    def products(at: np.ndarray) -> np.ndarray:
        out = np.full(at.shape, -np.inf, dtype=np.float32)
        which = np.nonzero(at >= 0)
        out[which] = np.einsum("ij,ij->i", vectors[at[which]], queries[which[0]])
        return out

    found = np.full((n, beam), -1)
    score = np.full((n, beam), -np.inf, dtype=np.float32)
    opened = np.ones((n, beam), dtype=bool)
    fresh = entry
    while True:
        seen[rows[: len(fresh)], fresh] = True
        seen[:, -1] = True
        every = np.concatenate([found, fresh], axis=1)
        values = np.concatenate([score, products(fresh)], axis=1)
        done = np.concatenate([opened, fresh < 0], axis=1)
        best = np.argsort(-values, axis=1, kind="stable")[:, :beam]
        found, score, opened = (np.take_along_axis(x, best, 1) for x in (every, values, done))
        # The best that are not open yet; a query without any is done.
        order = np.argsort(opened, axis=1, kind="stable")[:, :OPEN]
        turn = ~np.take_along_axis(opened, order, 1)
        if not turn.any():
            return found, score
        nodes = np.where(turn, np.take_along_axis(found, order, 1), -1)
        np.put_along_axis(opened, order, True, 1)
        fresh = np.where(nodes[:, :, None] >= 0, near[nodes], -1).reshape(n, -1)
        fresh = np.where(seen[rows, fresh], -1, fresh)
        # A node that two opened ones share is taken once.
        fresh = -np.sort(-fresh, axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1


def diverse(
    vectors: np.ndarray, candidates: np.ndarray, score: np.ndarray, links: int
) -> np.ndarray:
    """Of each row's ``candidates`` (best first, -1 where there are fewer) up to ``links``: those
    nearer to the row than to any chosen before, then the best of the rest."""
    n, width = candidates.shape
    if not n:
        return np.full((0, links), -1)
    there = candidates >= 0
    held = vectors[candidates]
    between = held @ held.transpose(0, 2, 1)
    chosen = np.zeros((n, width), dtype=bool)
    for j in range(width):
        closer = (between[:, j, :j] > score[:, j, None]) & chosen[:, :j]
        chosen[:, j] = there[:, j] & ~closer.any(axis=1) & (chosen[:, :j].sum(axis=1) < links)
    rank = np.where(there, np.where(chosen, 0, 1), 2)
    order = np.argsort(rank, axis=1, kind="stable")[:, :links]
    out = np.where(np.take_along_axis(there, order, 1), np.take_along_axis(candidates, order, 1), -1)
    return np.pad(out, ((0, 0), (0, links - out.shape[1])), constant_values=-1)


def _link_back(
    vectors: np.ndarray, near: np.ndarray, new: np.ndarray, chosen: np.ndarray
) -> None:
    """Add the batch's nodes to the neighbours of those they chose; a full node keeps a diverse
    choice of the old and the new."""
    links = near.shape[1]
    source = np.repeat(new, chosen.shape[1])
    target = chosen.ravel()
    source, target = source[target >= 0], target[target >= 0]
    score = np.einsum("ij,ij->i", vectors[source], vectors[target])
    order = np.lexsort((-score, target))
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    rank = np.arange(len(target)) - np.repeat(first, count)
    kept = rank < links
    offered = np.full((len(nodes), links), -1)
    offered[np.repeat(np.arange(len(nodes)), count)[kept], rank[kept]] = source[kept]
    for i in range(0, len(nodes), BATCH):
        part = nodes[i : i + BATCH]
        every = np.concatenate([near[part], offered[i : i + BATCH]], axis=1)
        value = np.einsum("ijk,ik->ij", vectors[every], vectors[part])
        value[every < 0] = -np.inf
        best = np.argsort(-value, axis=1, kind="stable")
        every, value = np.take_along_axis(every, best, 1), np.take_along_axis(value, best, 1)
        near[part] = diverse(vectors, every, value, links)


def build(vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 42):
    """Neighbour arrays of the layers, lowest first, of unit ``vectors`` (float32) whose order is
    that of ``levels_of``. Layer 0 has twice the links of the others."""
    top = levels_of(len(vectors), links, seed)
    layers = []
    for layer in range(int(top[0]) + 1 if len(top) else 0):
        layers.append(np.full((int((top >= layer).sum()), links * (2 if layer == 0 else 1)), -1))
    done = 1
    while done < len(vectors):
        new = np.arange(done, min(done + min(done, BATCH), len(vectors)))
        own = vectors[new]
        entry = np.zeros((len(new), 1), dtype=np.int64)
        # Members of the batch that come before each are candidates too.
        inside = own @ own.T
        inside[np.triu_indices(len(new))] = -np.inf
        for layer in range(len(layers) - 1, -1, -1):
            near, here = layers[layer], top[new] >= layer
            width = beam if here.any() else 1
            if min(done, len(near)) == 0:
                continue
            found, score = beam_search(vectors[: len(near)], near, own, entry, width)
            entry = found[:, : max(1, width // 4)]
            at = np.flatnonzero(here)
            if not len(at):
                continue
            peers = np.where(np.isfinite(inside[at]) & here[None, :], new[None, :], -1)
            value = np.concatenate([score[at], np.where(peers >= 0, inside[at], -np.inf)], axis=1)
            every = np.concatenate([found[at], peers], axis=1)
            best = np.argsort(-value, axis=1, kind="stable")[:, :beam]
            every, value = np.take_along_axis(every, best, 1), np.take_along_axis(value, best, 1)
            chosen = diverse(vectors, every, value, links)
            near[new[at], :links] = chosen
            _link_back(vectors, near, new[at], chosen)
        done += len(new)
    return layers


def search(vectors: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, beam: int):
    """The nearest nodes of each query (unit, float32), best first, by descent through the layers."""
    entry = np.zeros((len(queries), 1), dtype=np.int64)
    for near in layers[:0:-1]:
        entry, _ = beam_search(vectors[: len(near)], near, queries, entry, 4)
    return beam_search(vectors, layers[0], queries, entry, beam)[0]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in single precision, for finding candidates only."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``a`` and ``b`` in double precision. Rows whose squares would leave
    its range are scaled first."""
    for x in (a, b):
        most = np.abs(x).max(axis=1)
        far = (most > 1e150) | (most < 1e-150)
        if far.any():
            x[far] /= most[far, None]
    return (a * b).sum(axis=1) / (
        np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    )


def _stacked(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.Table | pa.RecordBatch]]:
    """Pieces of batches sorted by shard, ``(first of its shard, piece)``."""
    last = None
    for batch in batches:
        keys = list(zip(batch.column("dim").to_pylist(), batch.column("shard").to_pylist()))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                yield keys[start] != last, batch.slice(start, i - start)
                last, start = keys[start], i


def build_graphs(
    classes: DataFrame, shards: int, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 42
) -> DataFrame:
    """Nodes of all shards from ``dim, shard, vector, ids``; a shard is built in one task."""

    def graph(pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = np.concatenate([_stacked(p.column("vector")) for p in pieces])
        layers = build(unit(vectors), links, beam, seed)
        base, first = layers[0], 0
        for piece in pieces:
            rows = np.arange(first, first + piece.num_rows)
            flat, cuts = [], [0]
            for i in rows.tolist():
                own = [base[i], *(x[i] for x in layers[1:] if i < len(x))]
                flat += own
                cuts.append(cuts[-1] + sum(map(len, own)))
            near = pa.ListArray.from_arrays(
                pa.array(cuts, pa.int32()), pa.array(np.concatenate(flat).astype(np.int32))
            )
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("dim"),
                    piece.column("shard"),
                    pa.array(rows.astype(np.int32)),
                    piece.column("vector"),
                    piece.column("ids"),
                    near,
                ],
                names=["dim", "shard", "pos", "vector", "ids", "near"],
            )
            first += piece.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for first, piece in _groups(batches):
            if first and held:
                yield from graph(held)
                held = []
            held.append(piece)
        if held:
            yield from graph(held)

    return (
        classes.select("dim", "shard", "vector", "ids", "h1", "h2")
        .repartitionById(shards, "shard")
        .sortWithinPartitions("dim", "shard", "h1", "h2")
        .select("dim", "shard", "vector", "ids")
        .mapInArrow(
            run,
            f"dim int, shard int, pos int, vector {classes.schema['vector'].dataType.simpleString()},"
            " ids array<bigint>, near array<int>",
        )
    )


def search_graphs(
    nodes: DataFrame,
    queries: DataFrame,
    shards: int,
    k: int,
    beam: int = SEARCH_BEAM,
    links: int = LINKS,
) -> DataFrame:
    """``q1, q2, vec_id, score``: of every query (``dim, q1, q2, vector``) and shard of its
    dimension the ``k`` nearest rows, ties to the smaller id."""
    spread = queries.select(
        "dim",
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.lit(None).cast("int").alias("pos"),
        "vector",
        F.lit(None).cast("array<bigint>").alias("ids"),
        F.lit(None).cast("array<int>").alias("near"),
        "q1",
        "q2",
    )
    none = F.lit(None).cast("bigint")
    both = nodes.select("*", none.alias("q1"), none.alias("q2")).unionByName(spread)

    class Shard:
        def __init__(self):
            self.vectors: list = []
            self.ids: list = []
            self.near: list = []
            self.layers = None

        def add(self, piece: pa.RecordBatch) -> None:
            self.vectors.append(_stacked(piece.column("vector")))
            self.ids += piece.column("ids").to_pylist()
            self.near.append(piece.column("near"))

        def ready(self) -> None:
            if self.layers is None:
                self.exact = np.concatenate(self.vectors)
                self.unit = unit(self.exact)
                flat = [x.flatten().to_numpy() for x in self.near]
                sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in self.near])
                flat, starts = np.concatenate(flat).astype(np.int64), np.cumsum(sizes) - sizes
                self.layers = [flat[starts[:, None] + np.arange(2 * links)]]
                while (sizes > links * (len(self.layers) + 1)).any():
                    at = starts[sizes > links * (len(self.layers) + 1)]
                    start = at[:, None] + links * (len(self.layers) + 1)
                    self.layers.append(flat[start + np.arange(links)])
                self.count = np.array([len(x) for x in self.ids])
                self.first = np.cumsum(self.count) - self.count
                self.all_ids = np.array([i for x in self.ids for i in x], dtype=np.int64)

        def nearest(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Row of ``wanted``, id and cosine, the best k rows of each."""
            found = search(self.unit, self.layers, unit(wanted), max(beam, k))
            row, at = np.nonzero(found >= 0)
            node = found[row, at]
            score = cosines(wanted[row], self.exact[node])
            many = self.count[node]
            row, score = np.repeat(row, many), np.repeat(score, many)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            ids = self.all_ids[np.repeat(self.first[node], many) + inside]
            order = np.lexsort((ids, -score, row))
            row, ids, score = row[order], ids[order], score[order]
            starts = np.searchsorted(row, np.arange(len(wanted)))
            kept = np.arange(len(row)) - starts[row] < k
            return row[kept], ids[kept], score[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for first, piece in _groups(batches):
            if first:
                shard = Shard()
            is_node = piece.column("pos").is_valid().to_numpy(zero_copy_only=False)
            split = int(is_node.sum())  # nodes come before the queries
            if split:
                shard.add(piece.slice(0, split))
            asked = piece.slice(split)
            if not asked.num_rows or not shard.vectors:
                continue
            shard.ready()
            for i in range(0, asked.num_rows, BATCH):
                part = asked.slice(i, BATCH)
                row, ids, score = shard.nearest(_stacked(part.column("vector")).copy())
                q1, q2 = (part.column(c).take(pa.array(row)) for c in ("q1", "q2"))
                yield pa.RecordBatch.from_arrays(
                    [q1, q2, pa.array(ids), pa.array(score)],
                    names=["q1", "q2", "vec_id", "score"],
                )

    return (
        both.repartitionById(shards, "shard")
        .sortWithinPartitions("dim", "shard", F.col("pos").asc_nulls_last())
        .mapInArrow(run, "q1 bigint, q2 bigint, vec_id bigint, score double")
    )


def usable(vector: str) -> Column:
    """Whether a vector can be compared: not null, not empty, finite throughout and not zero."""
    numbers = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(
        (F.size(numbers) > 0) & F.forall(numbers, finite) & F.exists(numbers, lambda x: x != 0),
        F.lit(False),
    )


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    links: int = LINKS,
    build_beam: int = BUILD_BEAM,
    beam: int = SEARCH_BEAM,
    seed: int = 42,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query`` (of its key) holds, the
    ``k`` other rows nearest by cosine, ties to the smaller key; all of them, if there are fewer.

    Vectors that are null, empty or zero or hold null or non-finite components take no part, nor do
    rows with a null key, which a result could not name. Vectors of different lengths are not
    compared. Repeated rows are rows of their own: each is a candidate of the others, and each that
    is a query has its result. Other columns play no part.
    """
    kind = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    rows = (
        vectors.select(
            F.col(key).cast("bigint").alias("vec_id"),
            F.col(vector).cast(f"array<{kind}>").alias("vector"),
            F.coalesce(is_query, F.lit(False)).alias("query"),
        )
        .where(usable("vector") & F.col("vec_id").isNotNull())
        .withColumns(
            {"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(seed), "vector")}
        )
    )
    rows = store(rows, "vectors")
    # Few rows of each vector leave a task, so a vector that a third of the rows have does no harm.
    order = Window.partitionBy("h1", "h2").orderBy("vec_id")
    classes = store(
        rows.withColumn("at", F.row_number().over(order))
        .where(F.col("at") <= k + 1)
        .groupBy("h1", "h2")
        .agg(
            F.sort_array(F.collect_list("vec_id")).alias("ids"),
            F.first("vector").alias("vector"),
        )
        .withColumn("dim", F.size("vector")),
        "classes",
    )
    shards = max(1, -(-classes.count() // shard_rows))
    dealt = F.pmod(F.xxhash64("h2", "h1"), F.lit(shards)).cast("int")
    graphs = store(
        build_graphs(classes.withColumn("shard", dealt), shards, links, build_beam, seed), "graphs"
    )
    asked = rows.where("query")
    queries = store(
        asked.groupBy("h1", "h2")
        .agg(F.first("vector").alias("vector"))
        .select(
            F.size("vector").alias("dim"),
            F.col("h1").alias("q1"),
            F.col("h2").alias("q2"),
            "vector",
        ),
        "queries",
    )
    best = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id")
    found = (
        search_graphs(graphs, queries, shards, k + 1, beam, links)
        .withColumn("at", F.row_number().over(best))
        .where(F.col("at") <= k + 1)
        .groupBy("q1", "q2")
        .agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score"))).alias("found"))
    )
    # Without one row of the query's own key: itself, which is the nearest of that key.
    ids = F.transform("found", lambda x: x["vec_id"])
    own = F.array_position(ids, F.col("query_id"))
    left = F.filter("found", lambda x, i: (own == 0) | (i != own - 1))
    return (
        asked.select(F.col("vec_id").alias("query_id"), "h1", "h2")
        .join(found.withColumnsRenamed({"q1": "h1", "q2": "h2"}), ["h1", "h2"])
        .select("query_id", F.posexplode(F.slice(left, 1, k)).alias("i", "x"))
        .select(
            "query_id",
            (F.col("i") + 1).cast("int").alias("rank"),
            F.col("x.vec_id").alias("vec_id"),
            F.col("x.score").alias("score"),
        )
    )
