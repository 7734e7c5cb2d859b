"""Exact quantiles that never gather a group's values in one task."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import as_column
from .joins import fits_broadcast
from .scratch import store

# Bins per factor of e in magnitude: under 200,000 for all doubles there are.
BINS_PER_E = 64
PARTS = 1024


def _bin(v: Column) -> Column:
    """A bin number that never decreases as ``v`` grows: signed, logarithmic in magnitude."""
    size = F.floor(F.log(F.least(F.abs(v), F.lit(sys.float_info.max))) * BINS_PER_E)
    offset = 1 << 24  # above |log| of any double times BINS_PER_E, so signs do not overlap
    return (
        F.when(v == 0, F.lit(0))
        .when(v > 0, size + F.lit(offset))
        .otherwise(-(size + F.lit(offset)))
        .cast("bigint")
    )


def exact_quantiles(
    df: DataFrame,
    columns: Mapping[str, Column | str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Long form ``(*by, metric, prob, value, count)`` of linearly interpolated quantiles.

    1. Values are stored once, narrow, and counted per logarithmic bin; running counts say in which
       bin each wanted rank lies.
    2. The values of such a bin are counted again in PARTS equal parts of the range they really
       have, and so on, until the part with the rank holds one value only.

    No values are sorted and no task sees a whole bin: each round sends at most PARTS counts of a
    rank from each task, and a round narrows the range at least a thousandfold. ``count`` is the number of
    values of the group; ``weight`` names a column that says how often each row counts.
    """
    items = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), as_column(c).cast("double").alias("value"))
            for name, c in columns.items()
        ]
    )
    counted = (F.lit(1) if weight is None else F.col(weight)).cast("bigint").alias("count")
    group = [*by, "metric"]
    values = store(
        df.select(*by, counted, F.inline(items))
        .where(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("count") > 0))
        .select(*group, "value", "count", _bin(F.col("value")).alias("bin")),
        "values",
    )
    bins = values.groupBy(*group, "bin").agg(
        F.sum("count").alias("count"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    so_far = Window.partitionBy(*group).orderBy("bin")
    whole = Window.partitionBy(*group)
    bins = bins.select(
        "*",
        (F.sum("count").over(so_far) - F.col("count")).alias("before"),
        F.sum("count").over(whole).alias("n"),
    )
    # Zero-based position of each quantile and the ranks around it.
    position = (F.col("n") - 1) * F.col("prob")
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs]))
    ends = F.explode(F.array_distinct(F.array(F.floor(position), F.ceil(position))))
    state = (
        bins.select("*", wanted.alias("prob"))
        .select("*", position.alias("position"), ends.alias("rank"))
        .where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("count")))
        .select(*group, "n", "prob", "position", "rank", "before", "low", "high")
    )
    state = store(state, "ranks")
    done = state.where("low = high")
    open_ranks = state.where("low < high")
    while not open_ranks.isEmpty():
        open_ranks = store(_narrowed(values, open_ranks, group), "ranks")
        done = done.unionByName(open_ranks.where("low = high"))
        open_ranks = open_ranks.where("low < high")
    found = done.groupBy(*group, "prob", "position", "n").agg(
        F.min(F.struct("rank", "low"))["low"].alias("low"),
        F.max(F.struct("rank", "low"))["low"].alias("high"),
    )
    fraction = F.col("position") - F.floor("position")
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(
        F.col("low") + (F.col("high") - F.col("low")) * fraction
    )
    return found.select(*group, "prob", value.alias("value"), F.col("n").alias("count"))


def _narrowed(values: DataFrame, state: DataFrame, group: Sequence[str]) -> DataFrame:
    """Each rank's part of its range, with the least and greatest value in it."""
    ranges = state.select(*group, "low", "high").distinct()
    small = F.broadcast(ranges) if fits_broadcast(ranges) else ranges
    inside = values.alias("v").join(
        small.alias("w"),
        _same(group)
        & (F.col("v.value") >= F.col("w.low"))
        & (F.col("v.value") <= F.col("w.high")),
    )
    # Halved, so that the width of no range overflows; the ends have parts of their own.
    low, high, v = (F.col(c) / 2 for c in ("w.low", "w.high", "v.value"))
    finite = F.lit(sys.float_info.max / 2)
    low, high = F.greatest(low, -finite), F.least(high, finite)
    inner = F.floor(F.least((v - low) / (high - low), F.lit(1.0)) * PARTS)
    part = (
        F.when(F.col("v.value") == F.col("w.low"), -1)
        .when(F.col("v.value") == F.col("w.high"), PARTS + 1)
        .otherwise(inner)
    )
    keys = [*group, "low", "high"]
    parts = (
        inside.select(
            *[F.col(f"v.{c}").alias(c) for c in group], "w.low", "w.high", "v.value", "v.count",
            part.cast("int").alias("part"),
        )
        .groupBy(*keys, "part")
        .agg(F.sum("count").alias("count"), F.min("value").alias("least"), F.max("value").alias("most"))
    )
    so_far = Window.partitionBy(*keys).orderBy("part")
    parts = parts.withColumn("offset", F.sum("count").over(so_far) - F.col("count"))
    met = state.alias("v").join(
        parts.alias("w"),
        _same(keys)
        & (F.col("v.rank") >= F.col("v.before") + F.col("w.offset"))
        & (F.col("v.rank") < F.col("v.before") + F.col("w.offset") + F.col("w.count")),
    )
    return met.select(
        *[F.col(f"v.{c}").alias(c) for c in [*group, "n", "prob", "position", "rank"]],
        (F.col("v.before") + F.col("w.offset")).alias("before"),
        F.col("w.least").alias("low"),
        F.col("w.most").alias("high"),
    )


def _same(names: Sequence[str]) -> Column:
    """Null-safe equality: a null group is a group."""
    pairs = [F.col(f"v.{c}").eqNullSafe(F.col(f"w.{c}")) for c in names]
    return reduce(Column.__and__, pairs)
