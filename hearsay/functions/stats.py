"""Text statistics and time features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import as_column, bind, words

# Names of the derived columns, in order.
TEXT_STATS = (
    "char_count",
    "word_count",
    "sentence_count",
    "avg_word_length",
    "exclamation_count",
    "question_count",
    "uppercase_ratio",
    "digit_count",
    "special_char_count",
)
TIME_FEATURES = ("year", "month", "day", "hour", "day_of_week", "is_weekend", "quarter")


def _occurrences(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def text_statistics(c: Column | str) -> Column:
    """A struct of the nine statistics; its fields are null for null text."""
    c = as_column(c)
    chars = F.length(c)
    sentences = F.filter(F.split(c, r"\."), lambda s: s.rlike(P.NON_SPACE))
    zero_if_text = F.when(c.isNotNull(), F.lit(0.0))

    def rule(pieces: Column) -> Column:
        letters = F.aggregate(pieces, F.lit(0), lambda acc, w: acc + F.length(w))
        columns = (
            chars,
            F.size(pieces),
            F.size(sentences),
            F.coalesce(letters / F.nullif(F.size(pieces), F.lit(0)), zero_if_text),
            _occurrences(c, "!"),
            _occurrences(c, "?"),
            F.coalesce(F.regexp_count(c, F.lit(P.UPPER)) / F.nullif(chars, F.lit(0)), zero_if_text),
            F.regexp_count(c, F.lit(P.DIGIT)),
            F.regexp_count(c, F.lit(P.SPECIAL)),
        )
        return F.struct(*[x.alias(name) for name, x in zip(TEXT_STATS, columns)])

    return bind(words(c), rule)


def time_features(d: Column | str) -> dict[str, Column]:
    """Calendar fields of a timestamp; Monday is day 0 and an unknown date is no weekend."""
    d = as_column(d)
    hour = F.hour(d)
    # Right-closed bins of the hour.
    period = (
        F.when(hour <= 6, "Night")
        .when(hour <= 12, "Morning")
        .when(hour <= 18, "Afternoon")
        .when(hour <= 24, "Evening")
    )
    return {
        "year": F.year(d),
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "hour": hour,
        "day_of_week": F.weekday(d),
        "is_weekend": F.coalesce(F.weekday(d).isin(5, 6).cast("int"), F.lit(0)),
        "quarter": F.quarter(d),
        "time_period": period,
    }
