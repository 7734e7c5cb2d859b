"""Cleaning a column, row filters and the dataset contract check."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import to_datetime
from ..functions.scores import SENTIMENT_COLUMNS
from ..functions.text import (
    Cleaner,
    as_column,
    bind,
    is_not_blank,
    moderate_clean,
    remove_stopwords,
    strip,
    words,
)
from ..schema import REQUIRED_COLUMNS
from .joins import check_match, inline_rows, lookup_join
from .scratch import store

LABEL = SENTIMENT_COLUMNS["label"]
SCORE = SENTIMENT_COLUMNS["score"]


def clean_posts(
    df: DataFrame,
    text_column: str = "text",
    cleaner: Cleaner = moderate_clean,
    create_new_column: bool = True,
    longer_than: int | None = None,
) -> DataFrame:
    """Clean a text column and drop rows whose result is blank, or not ``longer_than`` characters.

    The cleaned value goes through a one-element array that the test may empty. A plain filter on
    the new column would be pushed below the projection and run the whole chain a second time.
    """
    if text_column not in df.columns:
        return df

    def kept(c: Column) -> Column:
        if longer_than is None:
            return is_not_blank(c)
        return is_not_blank(c) & (F.length(c) > longer_than)

    cleaned = F.explode(F.filter(F.array(cleaner(F.col(text_column))), kept))
    name = f"{text_column}_cleaned" if create_new_column else text_column
    others = [F.col(c) if c != name else cleaned.alias(name) for c in df.columns]
    if name not in df.columns:
        others.append(cleaned.alias(name))
    return df.select(*others)


def remove_listed_words(
    df: DataFrame,
    words_table: DataFrame,
    text_column: str = "text",
    output: str = "text_cleaned",
    match: str = "join",
) -> DataFrame:
    """``remove_stopwords`` with the words of a table (its first column) of any size.

    ``match="join"`` numbers the rows, joins their words to the table, spread so that a frequent
    word is in no task alone, and takes the positions of those found out of each text; words that
    stay are not gathered again. ``match="inline"``
    tests words inside each row, for up to MAX_INLINE_WORDS (more is an error). Both give the same
    texts: words left, one space between them, null for null. Case does not matter.
    """
    check_match(match)
    listed = words_table.select(F.lower(F.col(words_table.columns[0])).alias("_word"))
    listed = listed.where(F.col("_word").isNotNull()).distinct()
    others = [c for c in df.columns if c != output]
    if match == "inline":
        rows = inline_rows(listed, ("_word",))
        return df.select(*others, remove_stopwords(text_column, [r[0] for r in rows]).alias(output))
    numbered = store(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    apart = numbered.select("_row", F.posexplode(words(text_column)).alias("_at", "_word"))
    apart = apart.withColumn("_word", F.lower("_word"))
    known = store(listed, "words")
    found = (
        lookup_join(apart, known, "_word", ["_row", "_at"], "inner")
        .groupBy("_row")
        .agg(F.collect_list("_at").alias("_out"))
    )
    joined = numbered.join(found, "_row", "left")

    def left(pieces: Column) -> Column:
        """``array_except`` looks positions up in a hash set and keeps their order."""
        every = F.when(F.size(pieces) > 0, F.sequence(F.lit(0), F.size(pieces) - 1))
        stay = F.array_except(every, F.coalesce("_out", F.array().cast("array<int>")))
        return F.coalesce(F.array_join(F.transform(stay, lambda i: F.get(pieces, i)), " "), F.lit(""))

    text = F.when(F.col(text_column).isNotNull(), bind(words(text_column), left))
    return joined.select(*others, text.alias(output))


def coerce_dates(
    df: DataFrame, date_column: str = "date", formats: Sequence[str] = (), day_first: bool = False
) -> DataFrame:
    """Read the date column as timestamps; values that are not dates become null."""
    parsed = to_datetime(date_column, df.schema[date_column].dataType, formats, day_first)
    return df.withColumn(date_column, parsed)


def filter_by_date(
    df: DataFrame,
    start_date: str | None = None,
    end_date: str | None = None,
    date_column: str = "date",
    day_column: str | None = None,
    formats: Sequence[str] = (),
) -> DataFrame:
    """Both bounds inclusive and optional. A bare end date means its midnight.

    ``day_column`` names the partition column of a table stored by day; other days are not read.
    """
    if date_column not in df.columns:
        return df
    dated = coerce_dates(df, date_column, formats)
    if start_date:
        start = F.lit(start_date).cast("timestamp_ntz")
        dated = dated.where(F.col(date_column) >= start)
        if day_column:
            dated = dated.where(F.col(day_column) >= start.cast("date"))
    if end_date:
        end = F.lit(end_date).cast("timestamp_ntz")
        dated = dated.where(F.col(date_column) <= end)
        if day_column:
            dated = dated.where(F.col(day_column) <= end.cast("date"))
    return dated


def is_valid_text(c: Column | str, min_length: int = 10) -> Column:
    """Long enough once stripped, and at least two words."""
    valid = bind(
        strip(as_column(c)), lambda s: (F.length(s) >= min_length) & (F.size(words(s)) >= 2)
    )
    return F.coalesce(valid, F.lit(False))


def filter_valid_posts(
    df: DataFrame, text_column: str = "text_cleaned", min_length: int = 10
) -> DataFrame:
    if text_column not in df.columns:
        return df
    return df.where(is_valid_text(text_column, min_length))


def filter_by_sentiment(df: DataFrame, sentiment: str, min_confidence: float = 0.5) -> DataFrame:
    if LABEL not in df.columns:
        return df
    wanted = F.col(LABEL) == sentiment.upper()
    if SCORE in df.columns:
        wanted = wanted & (F.col(SCORE) >= min_confidence)
    return df.where(wanted)


positive_posts = partial(filter_by_sentiment, sentiment="POSITIVE")
negative_posts = partial(filter_by_sentiment, sentiment="NEGATIVE")
neutral_posts = partial(filter_by_sentiment, sentiment="NEUTRAL")
high_confidence_positive = partial(filter_by_sentiment, sentiment="POSITIVE", min_confidence=0.8)
high_confidence_negative = partial(filter_by_sentiment, sentiment="NEGATIVE", min_confidence=0.8)


def validate_posts(df: DataFrame) -> DataFrame:
    """One row: are the required columns there, the table filled and its texts not all empty?"""
    missing = sorted(set(REQUIRED_COLUMNS) - set(df.columns))
    rows = F.count("*")
    if "text" in df.columns:
        text = F.col("text")
        nulls = F.count_if(text.isNull())
        blanks = F.count_if(text.isNotNull() & ~is_not_blank(text))
    else:
        nulls = blanks = F.lit(0).cast("bigint")
    checked = df.agg(
        rows.alias("total_rows"), nulls.alias("null_texts"), blanks.alias("blank_texts")
    )
    total = F.col("total_rows")
    valid = (
        F.lit(not missing)
        & (total > 0)
        & (F.col("null_texts") != total)
        & (F.col("blank_texts") != total)
    )
    return checked.select(
        "total_rows",
        "null_texts",
        "blank_texts",
        F.lit(",".join(missing)).alias("missing_columns"),
        valid.alias("is_valid"),
    )
