"""One small table of counts and sums a day and label, from which the reports follow.

The cube is one aggregation over the scored posts. Cubes of different posts, such as those of each
day's run, merge by adding up, so a report over a year reads a few rows a day and no post again.
Medians and quartiles do not add up; they stay with ``sentiment_statistics`` and
``confidence_boxstats``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import to_datetime
from ..functions.scores import SENTIMENT_COLUMNS
from ..schema import SENTIMENT_LABELS
from .summary import LABEL, Period, time_bucket

MEASURES = {
    "confidence": SENTIMENT_COLUMNS["score"],
    "positive": SENTIMENT_COLUMNS["positive_score"],
    "negative": SENTIMENT_COLUMNS["negative_score"],
    "neutral": SENTIMENT_COLUMNS["neutral_score"],
}
KEYS = ("day", LABEL)


def report_cube(
    scored: DataFrame, date_column: str = "date", formats: Sequence[str] = ()
) -> DataFrame:
    """``day, sentiment_label, posts`` and of each score its number, sum, sum of squares, least and
    greatest value. Posts without a readable date or without a label have a null there."""
    day = to_datetime(date_column, scored.schema[date_column].dataType, formats).cast("date")
    narrow = scored.select(day.alias("day"), LABEL, *MEASURES.values())
    return narrow.groupBy(*KEYS).agg(F.count("*").alias("posts"), *_sums())


def _sums() -> list[Column]:
    out = []
    for name, column in MEASURES.items():
        c = F.col(column).cast("double")
        out += [
            F.count(c).alias(f"{name}_n"),
            F.sum(c).alias(f"{name}_sum"),
            F.sum(c * c).alias(f"{name}_squares"),
            F.min(c).alias(f"{name}_min"),
            F.max(c).alias(f"{name}_max"),
        ]
    return out


def merge_cubes(*cubes: DataFrame) -> DataFrame:
    """The cube of all posts together; each post must be in one cube only."""
    return _added(reduce(DataFrame.unionByName, cubes), *KEYS)


def _added(cube: DataFrame, *keys: str | Column) -> DataFrame:
    fold = {"min": F.min, "max": F.max}
    return cube.groupBy(*keys).agg(
        F.sum("posts").alias("posts"),
        *[
            fold.get(c.rsplit("_", 1)[1], F.sum)(c).alias(c)
            for m in MEASURES
            for c in (f"{m}_n", f"{m}_sum", f"{m}_squares", f"{m}_min", f"{m}_max")
        ],
    )


def cube_distribution(cube: DataFrame) -> DataFrame:
    """``label_distribution`` of the cube's posts."""
    counts = cube.where(F.col(LABEL).isNotNull()).groupBy(LABEL).agg(F.sum("posts").alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("share", F.col("count") / total)


def cube_statistics(cube: DataFrame) -> DataFrame:
    """``sentiment_statistics`` of the cube's posts without the median, and the range."""
    whole = _added(cube)
    n, total, squares = (F.col(f"confidence_{x}") for x in ("n", "sum", "squares"))
    # Rounding may leave a little below zero.
    spread = F.greatest(squares - total * total / n, F.lit(0.0))
    mean = lambda m: F.col(f"{m}_sum") / F.nullif(F.col(f"{m}_n"), F.lit(0))
    return whole.select(
        F.coalesce("posts", F.lit(0).cast("bigint")).alias("total_posts"),
        mean("positive").alias("avg_positive"),
        mean("negative").alias("avg_negative"),
        mean("neutral").alias("avg_neutral"),
        mean("confidence").alias("mean_confidence"),
        F.when(n > 1, F.sqrt(spread / (n - 1))).alias("std_confidence"),
        F.col("confidence_min").alias("min_confidence"),
        F.col("confidence_max").alias("max_confidence"),
    )


def cube_range(cube: DataFrame) -> DataFrame:
    """``sentiment_label, min, max, count`` of the confidence of each label that has scores."""
    found = _added(cube.where(F.col(LABEL).isNotNull()), LABEL).where("confidence_n > 0")
    return found.select(
        LABEL,
        F.col("confidence_min").alias("min"),
        F.col("confidence_max").alias("max"),
        F.col("confidence_n").alias("count"),
    )


def _dated(cube: DataFrame) -> DataFrame:
    return cube.where(F.col("day").isNotNull() & F.col(LABEL).isNotNull())


def cube_timeline(cube: DataFrame) -> DataFrame:
    """``sentiment_timeline`` of the cube's posts."""
    return _dated(cube).groupBy(F.col("day").alias("bucket"), LABEL).agg(
        F.sum("posts").alias("count")
    )


def _by_label(labels: Sequence[str]) -> list[Column]:
    of = lambda name: F.sum(F.when(F.col(LABEL) == name, F.col("posts")).otherwise(0))
    return [of(name).alias(name) for name in labels]


def cube_timeline_wide(
    cube: DataFrame, labels: Sequence[str] = SENTIMENT_LABELS
) -> DataFrame:
    return _dated(cube).groupBy(F.col("day").alias("bucket")).agg(*_by_label(labels))


def cube_trends(
    cube: DataFrame,
    period: str = "D",
    labels: Sequence[str] = SENTIMENT_LABELS,
    label: str = "end",
    origin: str | None = None,
) -> DataFrame:
    """``sentiment_trends`` of the cube's posts, by days or longer periods."""
    parsed = Period.parse(period)
    if parsed.unit == "H":
        raise ValueError("The cube holds days, not hours")
    dated = _dated(cube)
    if parsed.many > 1 and origin is None:
        origin = dated.agg(F.min("day")).first()[0]
    bucket = time_bucket(F.col("day").cast("timestamp_ntz"), period, label, origin)
    counts = dated.groupBy(bucket.alias("bucket")).agg(
        *_by_label(labels), F.sum("posts").alias("_all")
    )
    return counts.select("bucket", *[(F.col(n) / F.col("_all") * 100).alias(n) for n in labels])
