"""Equi-joins that hold up when one key has a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
LEAST_SALTS = 32
# The most words that a word list matched inline may have.
MAX_INLINE_WORDS = 20_000


def salts_of(df: DataFrame) -> int:
    """Parts of a hot key: as many as a shuffle has partitions, so its share of a task stays even
    when the cluster and the data grow."""
    return max(LEAST_SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def check_match(match: str) -> None:
    if match not in ("inline", "join"):
        raise ValueError(f"match must be 'inline' or 'join', not {match!r}")


def inline_rows(table: DataFrame, names: Sequence[str]) -> list[tuple]:
    """The rows of a word list that is to be matched inside each row of another table."""
    rows = [tuple(r) for r in table.select(*names).limit(MAX_INLINE_WORDS + 1).collect()]
    check_inline(rows)
    return rows


def check_inline(rows: Sequence) -> None:
    if len(rows) > MAX_INLINE_WORDS:
        raise ValueError(f"more than {MAX_INLINE_WORDS} words: use match='join'")


def fits_broadcast(
    table: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> bool:
    """Measure a look-up table, reading no more than ``max_rows + 1`` rows of it."""
    width = sum(
        (F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in table.columns),
        F.lit(0),
    )
    size = table.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(width).alias("b")).first()
    return size["n"] <= max_rows and (size["b"] or 0) <= max_bytes


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    on: str,
    salt_by: Sequence[str | Column],
    how: str = "left",
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
    salts: int | None = None,
) -> DataFrame:
    """Join ``df`` to a table with one row per ``on``.

    A table measured as small is broadcast. A larger one is shuffled, with the rows of each key
    spread over ``salts`` partitions by a hash of ``salt_by`` so that no hot key lands in one task.
    The salt is a pure function of the row, hence the same when a lost task is run again.
    """
    if fits_broadcast(table, max_rows, max_bytes):
        return df.join(F.broadcast(table), on, how)
    salts = salts or salts_of(df)
    salt = F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # Spark's own estimate does not know of the copies and might broadcast them after all.
    return df.withColumn("_salt", salt).join(spread.hint("merge"), [on, "_salt"], how).drop("_salt")
