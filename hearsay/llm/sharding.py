"""A uniform random shuffle into shards of exact sizes, by a communication matrix.

Rows are dealt to blocks by a hash. For each block the numbers of its rows that go to each shard are
drawn from the multivariate hypergeometric law, which is how a uniform shuffle would spread them.
Each block orders its rows by a hash and cuts that order by its numbers; after the exchange, each
shard orders what it got by another hash. Shard sizes are exact because the matrix has them as
column sums. Only the matrix (blocks x shards numbers) is drawn outside the executors.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearsay.operators.scratch import store

from .common import FILE, ROW, with_row_id

SHARDS = 24
ROWS_PER_BLOCK = 200
MAX_BLOCKS = 4096
LAW = "rows"


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Counts at most one apart; the first shards have the larger."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` out of ``good + bad`` are good: inversion that walks outwards from the
    mode, so its steps grow with the standard deviation and any size of population works."""
    low, high = max(0, drawn - bad), min(good, drawn)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    at_mode = math.exp(
        log_choose(good, mode) + log_choose(bad, drawn - mode) - log_choose(good + bad, drawn)
    )
    left = rng.random() - at_mode
    up, down, p_up, p_down = mode, mode, at_mode, at_mode
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:
            break
    return mode


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts with the given row and column sums, distributed as in a uniform shuffle."""
    rng, left, matrix = random.Random(seed), list(shards), []
    for rows in blocks:
        row, open_total = [], sum(left)
        for s, room in enumerate(left):
            n = hypergeometric(rng, room, open_total - room, rows) if rows else 0
            row.append(n)
            open_total -= room
            rows -= n
            left[s] -= n
        matrix.append(row)
    return matrix


def _placed(rows: DataFrame, identity: Column, shards: int, seed: int) -> DataFrame:
    """Add ``shard`` and ``slot`` to stored rows. ``identity`` is a hash that tells rows apart;
    rows that share it also share every column that matters."""
    total = rows.count()
    blocks = max(1, min(MAX_BLOCKS, total // ROWS_PER_BLOCK))
    dealt = rows.withColumns(
        {
            "_block": F.pmod(F.xxhash64(F.lit(seed), identity), F.lit(blocks)).cast("int"),
            "_first": F.xxhash64(F.lit(seed + 1), identity),
            "_second": F.xxhash64(F.lit(seed + 2), identity),
        }
    )
    counts = {r["_block"]: r["count"] for r in dealt.groupBy("_block").count().collect()}
    sizes = [counts.get(b, 0) for b in range(blocks)]
    matrix = communication_matrix(sizes, shard_sizes(total, shards), seed)
    ends = []
    for row in matrix:
        ends.append([sum(row[: s + 1]) for s in range(shards)])
    spark = rows.sparkSession
    # At most MAX_BLOCKS rows of one number a shard.
    plan = spark.createDataFrame(list(enumerate(ends)), "_block int, _ends array<bigint>")
    in_block = Window.partitionBy("_block").orderBy("_first", "_second")
    ranked = dealt.withColumn("_rank", F.row_number().over(in_block))
    # The shard is the number of cuts that the rank has passed.
    passed = F.filter("_ends", lambda end: end < F.col("_rank"))
    sent = ranked.join(F.broadcast(plan), "_block").withColumn("shard", F.size(passed))
    # Inside a shard the order is by the second hash; its leading bits make ranges of even size,
    # whose counts give each range's first slot, so no task holds a whole shard.
    ranges = max(1, blocks // shards)
    width = (1 << 32) // ranges + 1
    high = F.shiftrightunsigned("_second", 32)
    placed = sent.withColumn("_range", F.floor(high / width).cast("int"))
    ranged = Window.partitionBy("shard").orderBy("_range")
    counted = (
        placed.groupBy("shard", "_range")
        .count()
        .withColumn("_offset", F.sum("count").over(ranged) - F.col("count"))
        .select("shard", "_range", "_offset")
    )
    in_range = Window.partitionBy("shard", "_range").orderBy(high, "_second", "_first")
    slotted = placed.withColumn("_slot", F.row_number().over(in_range) - 1)
    slot = (F.col("_slot") + F.col("_offset")).cast("bigint")
    # Offsets: at most MAX_BLOCKS + shards rows.
    return (
        slotted.join(F.broadcast(counted), ["shard", "_range"])
        .withColumn("slot", slot)
        .drop("_block", "_first", "_second", "_ends", "_rank", "_range", "_slot", "_offset")
    )


def _assigned(known: DataFrame, shards: int, seed: int, text: str, key: str) -> DataFrame:
    content = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = store(
        known.select(
            F.col(key).alias("_key"),
            (F.octet_length(content).cast("bigint") + 8).alias("size"),
            F.crc32(content).alias("text_crc32"),
            FILE,
            ROW,
        ),
        "shard-digest",
    )
    identity = F.xxhash64("_key", "size", "text_crc32", ROW)
    return _placed(rows, identity, shards, seed)


def assign_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: int = 42,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """Digest of every row: key, ``size`` (UTF-8 bytes and 8), ``text_crc32``, ``law``, ``shard``,
    ``slot`` (gapless from 0 in its shard) and ``grown_shard`` (null: the law is equal counts).

    Only the digest is shuffled. Reruns on the same files agree. Null texts have size 8. Equal
    texts are shuffled like others; with fewer rows than shards the last shards are empty.
    """
    return _assigned(with_row_id(docs), shards, seed, text, key).select(
        F.col("_key").alias(key),
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_documents(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: int = 42,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (replacing columns of those names).

    The places are found on digests; each row is then shuffled once, to meet its place.
    """
    known = with_row_id(docs)
    places = _assigned(known, shards, seed, text, key).select(FILE, ROW, "shard", "slot")
    return known.drop("shard", "slot").join(places, [FILE, ROW]).drop(FILE, ROW)
