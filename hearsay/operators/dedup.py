"""Duplicate texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .topn import first_per_group


def dedup_posts(
    df: DataFrame,
    order_by: Sequence[Column | str],
    text_column: str = "text",
    key: str | Sequence[str] = "post_id",
) -> DataFrame:
    """Keep the first row of each text by ``order_by``, then by ``key``; null texts count as equal.

    ``order_by`` may hold any sort order, ``F.desc`` too. ``key`` must be unique (one or more
    columns), which also makes the order total. Only a digest of the text, the order and the key are
    shuffled to find the first rows, and each task first reduces its rows to one per text; the rows
    themselves move once, to meet the keys that stay.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    digest = F.coalesce(F.sha2(F.col(text_column), 256), F.lit(""))
    ranked = first_per_group(
        df.withColumn("_digest", digest), "_digest", [*order, *keys], 1, keys, keep=keys
    )
    return df.join(ranked, keys, "left_semi")
