"""Near-duplicates by SimHash fingerprints, found through the anchors of a covering code.

The anchors are the words of the Hamming code of length 63 with the top bit free: every 64-bit
word lies within covering radius 1 of an anchor. Two fingerprints that differ in at most 2 bits
have a word between them at 1 bit from each, so both lie within 1 + 1 bits of that word's anchor.
Copying every fingerprint to its 2 or 33 anchors within 2 bits therefore finds every link. (Radius
plus the whole threshold would find the same links with some 650 copies.) Around one anchor lie at
most 2,081 different fingerprints, so no group can grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hearsay.operators.scratch import store

from .common import FILE, ROW, least_reachable, utf8, with_row_id

SHINGLE = 3
SEED = 42
CHUNK = 1 << 16
TOP_BIT = -(1 << 63)


def simhash(text: bytes) -> int:
    """Signed 64-bit fingerprint of UTF-8 text: A-Z lower-cased, words between ASCII white space,
    shingles of three words with repeats (fewer words: all of them; none: fingerprint 0)."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    shingles = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, shingles, CHUNK):
        stop = min(start + CHUNK, shingles)
        hashes = np.array(
            [xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(start, stop)],
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > shingles, bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns and ``fp``, row by row; no shuffle, whole texts."""
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            columns = [*batch.columns[:-1], pa.array(fps, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*keep, utf8(text).alias("_llm_text")).mapInArrow(run, schema)


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (position - 1).cast("int"))


def anchors(fp: Column) -> Column:
    """Array of the code words within 2 bits of ``fp``.

    Positions 1 to 63 of the code are the low bits; the exclusive or of the set positions is 0 for
    a code word and else names the one position to flip. Flipping any two positions whose
    exclusive or is that number gives the words at distance 2.
    """
    wrong = F.lit(0)
    for k in range(6):
        mask = sum(1 << (p - 1) for p in range(1, 64) if p >> k & 1)
        parity = F.bit_count(fp.bitwiseAND(F.lit(mask))) % 2
        wrong = wrong + parity * (1 << k)
    top = F.lit(TOP_BIT)
    nearest = fp.bitwiseXOR(_bit(wrong))
    pairs = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(63)), lambda i: i.bitwiseXOR(wrong) > i),
        lambda i: fp.bitwiseXOR(_bit(i)).bitwiseXOR(_bit(i.bitwiseXOR(wrong))),
    )
    return F.when(wrong == 0, F.array(fp, fp.bitwiseXOR(top))).otherwise(
        F.concat(F.array(nearest, nearest.bitwiseXOR(top)), pairs)
    )


def links(distinct: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` over the distinct ``fp`` with the same components as all links.

    Every edge joins fingerprints at most 2 bits apart. Around an anchor a fingerprint is the
    anchor with 0, 1 or 2 bits flipped, and two of them are that near exactly if one is the anchor,
    or both have one flipped bit, or they share a flipped bit. So each such star is joined to its
    least member (or the anchor), which takes no pairs.
    """
    near = Window.partitionBy("anchor")
    # A row becomes up to 33, so the few files of a narrow table are dealt to all tasks first.
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = (
        distinct.repartition(parts, "fp")
        .select("fp", F.explode(anchors(F.col("fp"))).alias("anchor"))
        .withColumn("flipped", F.col("fp").bitwiseXOR(F.col("anchor")))
        .withColumn("weight", F.bit_count("flipped"))
        .withColumns({"n": F.count("*").over(near), "least": F.min("weight").over(near)})
        .where("n > 1")
    )
    zero = F.lit(0).cast("bigint")
    low = F.col("flipped").bitwiseAND(-F.col("flipped"))
    low = F.when(F.col("flipped") == TOP_BIT, F.col("flipped")).otherwise(low)
    high = F.col("flipped").bitwiseXOR(low)
    stars = (
        F.when(F.col("least") == 0, F.array(zero))
        .when(F.col("weight") == 1, F.array(low, zero))
        .otherwise(F.array(low, high))
    )
    star = Window.partitionBy("anchor", "bit")
    centre = F.when(F.col("least") == 0, F.col("anchor")).otherwise(F.min("fp").over(star))
    return (
        met.select("fp", "anchor", "least", F.explode(stars).alias("bit"))
        .select(F.col("fp").alias("a"), centre.alias("b"))
        .where("a != b")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``key``, the ``keep`` columns, ``fp``, ``root`` and ``component_id`` for every row.

    root is the least fingerprint of the component, component_id is the smallest key of the rows whose fingerprints are linked, directly or through
    others, by at most 2 differing bits. Null and empty texts have fingerprint 0 and are linked like
    any other. Rows with a null key take part; a component of null keys only has a null id.
    """
    rows = store(fingerprints(docs, text, (key, *keep)), "fingerprints")
    by_fp = store(rows.groupBy("fp").agg(F.min(key).alias("first_key")), "distinct")
    roots = least_reachable(links(by_fp.select("fp")))
    rooted = by_fp.join(
        roots.withColumnsRenamed({"node": "fp"}), "fp", "left"
    ).select("fp", "first_key", F.coalesce("root", "fp").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("first_key").alias("component_id"))
    table = store(rooted.join(whole, "root").select("fp", "root", "component_id"), "components")
    return rows.join(table, "fp")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest key (nulls last), then
    the first by file and position. Columns and their order stay."""
    known = with_row_id(docs)
    found = near_duplicates(known, text, key, (FILE, ROW))
    order = F.struct(F.col(key).isNull(), F.col(key), F.col(FILE), F.col(ROW))
    first = found.groupBy("root").agg(F.min(order).alias("o"))
    kept = first.select(F.col(f"o.{FILE}").alias(FILE), F.col(f"o.{ROW}").alias(ROW))
    return known.join(kept, [FILE, ROW], "left_semi").select(*docs.columns)
