"""Profiles, distributions and trends: the tables behind the reports."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.dates import to_datetime
from ..functions.scores import SENTIMENT_COLUMNS
from ..schema import SENTIMENT_LABELS
from .quantiles import exact_quantiles
from .scratch import store
from .topn import first_per_group

LABEL = SENTIMENT_COLUMNS["label"]
SCORE = SENTIMENT_COLUMNS["score"]
MAX_WORDS = 100


def dataset_profile(df: DataFrame, user_column: str = "user", date_column: str = "date") -> DataFrame:
    """One row: size, distinct users, date range, column names and nulls per column."""
    users = F.count_distinct(user_column) if user_column in df.columns else F.lit(0)
    dates = (
        (F.min(date_column), F.max(date_column))
        if date_column in df.columns
        else (F.lit(None), F.lit(None))
    )
    profile = df.agg(
        F.count("*").alias("total_posts"),
        users.cast("bigint").alias("unique_users"),
        dates[0].alias("date_start"),
        dates[1].alias("date_end"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in df.columns],
    )
    return profile.withColumn("columns", F.lit(",".join(df.columns)))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``(column, count)`` by descending count, nulls left out."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), column)


def hashtag_distribution(df: DataFrame, column: str = "source_hashtag") -> DataFrame:
    return value_counts(df, column)


def label_distribution(df: DataFrame, column: str = LABEL) -> DataFrame:
    """Counts and shares (0 to 1) per label."""
    counts = value_counts(df, column)
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("share", F.col("count") / total)


def distinct_values(df: DataFrame, column: str = LABEL) -> DataFrame:
    return df.select(column).distinct()


def sentiment_statistics(df: DataFrame) -> DataFrame:
    """One row: size, mean of each score, and mean, median and sample deviation of confidence.

    The score columns alone are stored first, so posts are scored once.
    """
    columns = [SENTIMENT_COLUMNS[c] for c in SENTIMENT_COLUMNS if c != "label"]
    df = store(df.select(*columns), "scores")
    averages = df.agg(
        F.count("*").alias("total_posts"),
        F.avg(SENTIMENT_COLUMNS["positive_score"]).alias("avg_positive"),
        F.avg(SENTIMENT_COLUMNS["negative_score"]).alias("avg_negative"),
        F.avg(SENTIMENT_COLUMNS["neutral_score"]).alias("avg_neutral"),
        F.avg(SCORE).alias("mean_confidence"),
        F.stddev_samp(SCORE).alias("std_confidence"),
    )
    median = exact_quantiles(df, {"confidence": SCORE}, (0.5,)).select("value").scalar()
    return averages.withColumn("median_confidence", median)


def confidence_boxstats(df: DataFrame, label_column: str = LABEL, score_column: str = SCORE) -> DataFrame:
    """Minimum, quartiles, maximum and number of scores per label that has scores."""
    names = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    labelled = df.where(F.col(label_column).isNotNull())
    found = exact_quantiles(
        labelled, {"score": score_column}, tuple(names.values()), by=(label_column,)
    )
    ends = [F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in names.items()]
    return found.groupBy(label_column).agg(*ends, F.max("count").alias("count"))


# Bucket start by unit.
UNITS = {"H": "hour", "D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}
HOURS = {"H": 1, "D": 24}
MONTHS = {"M": 1, "Q": 3, "Y": 12}


@dataclass(frozen=True)
class Period:
    """A unit of time, or so many of them together: ``D``, ``W``, ``2W``, ``6H``."""

    many: int
    unit: str

    @classmethod
    def parse(cls, period: str) -> Period:
        found = re.fullmatch(r"([1-9]\d*)?([HDWMQY])", period)
        if not found:
            raise ValueError(f"Unsupported period: {period}")
        return cls(int(found[1] or 1), found[2])


def time_bucket(
    d: Column, period: str = "D", label: str = "end", origin: dt.date | str | None = None
) -> Column:
    """Bucket of a timestamp. Weeks run Monday to Sunday.

    Weeks, months, quarters and years are labelled by their last day unless ``label='start'``;
    hours and days by their start. Several units together are counted from ``origin``, the first
    date: hours and days from its midnight; of longer units, the one that holds the origin ends the
    first bucket.
    """
    p = Period.parse(period)
    start = F.date_trunc(UNITS[p.unit], d).cast("timestamp_ntz")
    if p.many == 1:
        return _labelled(start, p.unit, label)
    if origin is None:
        raise ValueError("Several units together need an origin")
    origin = F.lit(origin).cast("timestamp_ntz")
    if p.unit in HOURS:
        midnight = F.date_trunc("day", origin).cast("timestamp_ntz")
        hours = HOURS[p.unit] * p.many
        passed = F.floor(F.timestamp_diff("HOUR", midnight, start) / hours) * hours
        bucket = F.timestamp_add("HOUR", passed.cast("int"), midnight)
        return bucket if p.unit == "H" else bucket.cast("date")
    first = F.date_trunc(UNITS[p.unit], origin).cast("timestamp_ntz")
    step = "WEEK" if p.unit == "W" else "MONTH"
    size = MONTHS.get(p.unit, 1)
    units = F.floor(F.timestamp_diff(step, first, start) / size)
    last = F.ceil(units / p.many) * p.many
    if label == "start":
        last = last - (p.many - 1)
    return _labelled(F.timestamp_add(step, (last * size).cast("int"), first), p.unit, label)


def _labelled(start: Column, unit: str, label: str) -> Column:
    if unit == "H":
        return start
    first = start.cast("date")
    if label == "start" or unit == "D":
        return first
    if unit == "W":
        return F.date_add(first, 6)
    return F.last_day(F.add_months(first, MONTHS[unit] - 1))


def _label_counts(labels: Sequence[str], column: str) -> list[Column]:
    return [F.count_if(F.col(column) == name).alias(name) for name in labels]


def _all_labels(df: DataFrame) -> list[str]:
    """The usual labels, then all others found; labels are classes, so they are few."""
    found = distinct_values(df.where(F.col(LABEL).isNotNull())).collect()
    return [*SENTIMENT_LABELS, *sorted({r[0] for r in found} - set(SENTIMENT_LABELS))]


def _dated(df: DataFrame, date_column: str, formats: Sequence[str]) -> DataFrame:
    """Times and labels of the labelled posts."""
    parsed = to_datetime(date_column, df.schema[date_column].dataType, formats)
    return df.where(F.col(LABEL).isNotNull()).select(parsed.alias("_date"), LABEL)


def _bucketed(
    dated: DataFrame, period: str, label: str, origin: dt.date | str | None = None
) -> DataFrame:
    if Period.parse(period).many > 1 and origin is None:
        origin = dated.agg(F.min("_date").cast("date")).first()[0] or "1970-01-01"
    bucketed = dated.select(time_bucket(F.col("_date"), period, label, origin).alias("bucket"), LABEL)
    return bucketed.where(F.col("bucket").isNotNull())


def sentiment_trends(
    df: DataFrame,
    date_column: str = "date",
    period: str = "D",
    labels: Sequence[str] | None = None,
    label: str = "end",
    formats: Sequence[str] = (),
    origin: dt.date | str | None = None,
) -> DataFrame:
    """Percentage of each label per time bucket, of all labelled posts in it. Posts are read once:
    their times and labels are stored where several jobs need them.

    ``period`` is ``H``, ``D``, ``W``, ``M``, ``Q`` or ``Y``, or a number of them, counted from
    ``origin``; without one a small job finds the first date. Only buckets with posts appear. Without ``labels`` every label found has a column (one small
    job finds them); with them the columns are fixed and one aggregation is enough.
    """
    dated = _dated(df, date_column, formats)
    if labels is None or (Period.parse(period).many > 1 and origin is None):
        dated = store(dated, "dated")
    labels = _all_labels(dated) if labels is None else labels
    counts = _bucketed(dated, period, label, origin).groupBy("bucket").agg(
        *_label_counts(labels, LABEL), F.count("*").alias("_all")
    )
    percents = [(F.col(n) / F.col("_all") * 100).alias(n) for n in labels]
    return counts.select("bucket", *percents)


def sentiment_timeline(
    df: DataFrame, date_column: str = "date", formats: Sequence[str] = ()
) -> DataFrame:
    """Posts per day and label, in long form."""
    days = _bucketed(_dated(df, date_column, formats), "D", "start")
    return days.groupBy("bucket", LABEL).agg(F.count("*").alias("count"))


def sentiment_timeline_wide(
    df: DataFrame,
    date_column: str = "date",
    labels: Sequence[str] | None = None,
    formats: Sequence[str] = (),
) -> DataFrame:
    """Posts per day with a column for each label, by default for every label found."""
    dated = _dated(df, date_column, formats)
    if labels is None:
        dated = store(dated, "dated")
        labels = _all_labels(dated)
    days = _bucketed(dated, "D", "start")
    return days.groupBy("bucket").agg(*_label_counts(labels, LABEL))


def _explode_words(df: DataFrame, text_column: str, stopwords: Sequence[str], *keep: str) -> DataFrame:
    tokens = F.regexp_extract_all(F.lower(text_column), F.lit(P.WORD_RUN), F.lit(0))
    if stopwords:
        stop = sorted(set(stopwords))
        tokens = F.filter(tokens, lambda w: ~w.isin(stop))
    return df.select(*keep, F.explode(tokens).alias("word"))


def top_words(
    df: DataFrame,
    text_column: str = "text_cleaned",
    sentiment: str | None = None,
    n: int = MAX_WORDS,
    stopwords: Sequence[str] = (),
) -> DataFrame:
    """Most frequent words over all posts or those of one label."""
    if sentiment and LABEL in df.columns:
        df = df.where(F.col(LABEL) == sentiment.upper())
    counts = _explode_words(df, text_column, stopwords).groupBy("word").agg(
        F.count("*").alias("count")
    )
    return counts.orderBy(F.desc("count"), "word").limit(n)


def top_words_by_label(
    df: DataFrame,
    text_column: str = "text_cleaned",
    n: int = MAX_WORDS,
    stopwords: Sequence[str] = (),
    label_column: str = LABEL,
) -> DataFrame:
    """Most frequent words of each label. Counting comes first, so only counts are ranked."""
    counts = _explode_words(df, text_column, stopwords, label_column).groupBy(
        label_column, "word"
    ).agg(F.count("*").alias("count"))
    order = [F.desc("count"), F.col("word")]
    return first_per_group(counts, label_column, order, n, ["word"], rank_as="rank")


def dashboard(scored: DataFrame, text_column: str = "text_cleaned") -> dict[str, DataFrame]:
    """All report tables of one scored table; write or persist that table first."""
    return {
        "distribution": label_distribution(scored),
        "statistics": sentiment_statistics(scored),
        "confidence": confidence_boxstats(scored),
        "timeline": sentiment_timeline(scored),
        "timeline_wide": sentiment_timeline_wide(scored),
        "trends": sentiment_trends(scored),
        "words": top_words(scored, text_column),
        "words_by_label": top_words_by_label(scored, text_column),
    }
