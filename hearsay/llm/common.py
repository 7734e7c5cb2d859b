"""Helpers that several operators share: folds, row identity, worker caches, components."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearsay.operators.scratch import store

FILE, ROW = "_llm_file", "_llm_row"


def fold(key: str | Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as empty text (fold 0)."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds


def utf8(column: str) -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def with_row_id(df: DataFrame) -> DataFrame:
    """Add the file and the position of each row, a key even where rows are repeated.

    A frame read straight from Parquet files has them; anything else is stored first.
    """
    plan = df._jdf.queryExecution().analyzed()
    of_files = plan.getClass().getSimpleName() == "LogicalRelation" and (
        plan.relation().getClass().getSimpleName() == "HadoopFsRelation"
        and plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat"
    )
    if not of_files or "_metadata" in df.columns:
        df = store(df.withColumnsRenamed({"_metadata": "_metadata_"}), "rows")
    return df.withColumns(
        {FILE: F.col("_metadata.file_path"), ROW: F.col("_metadata.row_index").cast("bigint")}
    )


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Stored ``df`` with, by name, the sums of the columns over all rows that ``order`` puts before
    each row. The order must have no ties, or they are in any order.

    Rows are sorted across the cluster and added up inside their partitions; only one row a
    partition is added up in one task.
    """
    placed = store(
        df.orderBy(*order).withColumns(
            {
                "_part": F.spark_partition_id(),
                "_at": F.monotonically_increasing_id(),
                **{f"_own_{n}": c for n, c in sums.items()},
            }
        ),
        "placed",
    )
    held = placed.groupBy("_part").agg(*[F.sum(f"_own_{n}").alias(f"_held_{n}") for n in sums])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(
        "_part",
        *[F.coalesce(F.sum(f"_held_{n}").over(earlier), F.lit(0)).alias(f"_start_{n}") for n in sums],
    )
    before = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    inside = {n: F.coalesce(F.sum(f"_own_{n}").over(before), F.lit(0)) for n in sums}
    return (
        placed.withColumns(inside)
        .join(F.broadcast(starts), "_part")
        .select(*df.columns, *[(F.col(n) + F.col(f"_start_{n}")).alias(n) for n in sums])
    )


def worker_cache(key: str, make: Callable[[], Any], version: Any = None) -> Any:
    """``make()`` once per Python worker and version; of each key only the last version is kept.
    Task code is shipped by value, so its own globals are new in each task; a module that stays
    loaded keeps the value."""
    import sys
    import types

    kept = sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache"))
    values = kept.__dict__.setdefault("values", {})
    if key not in values or values[key][0] != version:
        values[key] = version, make()
    return values[key][1]


def least_reachable(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for undirected ``edges (a bigint, b bigint)``: root is the least node of the
    component. Nodes without an edge are not returned; self loops and repeats do no harm.

    Alternates between linking every node's larger neighbours to its least neighbour and linking
    its smaller neighbours to the least of them, until nothing changes. Rounds grow with the
    logarithm of the component size; each writes its edges, so nothing is recomputed and nothing
    is collected but a count and a checksum.
    """
    edges = store(
        edges.select(
            F.greatest("a", "b").cast("bigint").alias("a"),
            F.least("a", "b").cast("bigint").alias("b"),
        )
        .where("a != b")
        .distinct(),
        "edges",
    )
    before = None
    while True:
        # Every edge is held as (larger a, smaller b).
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == before or state[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select("b", "b").distinct()
            )
        before = state
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = store(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = store(
            both.join(least, "u")
            .where("v > u and v != m")
            .select(F.col("v").alias("a"), F.col("m").alias("b"))
            .distinct(),
            "edges",
        )
        least = store(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        met = large.join(least, "a").select("a", "b", "m")
        edges = store(
            met.select("a", F.col("m").alias("b"))
            .union(met.where("b != m").select("b", "m"))
            .distinct(),
            "edges",
        )
