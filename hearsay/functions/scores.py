"""Turning classifier output or word hits into the five sentiment columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column, bind, is_not_blank, once

# Label spellings, the result for text without a score, and output names.
POSITIVE_LABELS = ("POSITIVE", "POS", "1")
NEGATIVE_LABELS = ("NEGATIVE", "NEG", "0")
NEUTRAL_LABELS = ("NEUTRAL", "NEU", "2")
DEFAULT_SCORES = {
    "label": "NEUTRAL",
    "score": 0.0,
    "positive_score": 0.33,
    "negative_score": 0.33,
    "neutral_score": 0.34,
}
SENTIMENT_COLUMNS = {
    "label": "sentiment_label",
    "score": "sentiment_score",
    "positive_score": "sentiment_positive",
    "negative_score": "sentiment_negative",
    "neutral_score": "sentiment_neutral",
}
MODEL_MAX_CHARS = 512

# Opt-in grouping for five-star models.
STAR_GROUPS = {
    "POSITIVE": ("4 STARS", "5 STARS"),
    "NEGATIVE": ("1 STAR", "2 STARS"),
    "NEUTRAL": ("3 STARS",),
}


def default_scores() -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in DEFAULT_SCORES.items()])


def _scores(label: Column, score: Column, pos: Column, neg: Column, neu: Column) -> Column:
    zero = F.lit(0.0)
    return F.struct(
        label.alias("label"),
        score.alias("score"),
        F.coalesce(pos, zero).alias("positive_score"),
        F.coalesce(neg, zero).alias("negative_score"),
        F.coalesce(neu, zero).alias("neutral_score"),
    )


def _last_score(items: Column, labels: tuple[str, ...]) -> Column:
    matching = F.filter(items, lambda x: F.upper(x["label"]).isin(*labels))
    return F.try_element_at(matching, F.lit(-1))["score"]


def _winner(items: Column, pos: Column, neg: Column, neu: Column) -> Column:
    """Only positive and negative compete and a tie is negative; else the first item stands."""
    first = F.try_element_at(items, F.lit(1))
    both = pos.isNotNull() & neg.isNotNull()
    label = (
        F.when(both & (pos > neg), "POSITIVE")
        .when(both, "NEGATIVE")
        .otherwise(F.upper(first["label"]))
    )
    score = F.when(both & (pos > neg), pos).when(both, neg).otherwise(first["score"])
    return _scores(label, score, pos, neg, neu)


def normalize_scores(items: Column | str) -> Column:
    """``array<struct<label, score>>`` to one struct of the five standard fields."""

    def rule(x: Column) -> Column:
        pos = _last_score(x, POSITIVE_LABELS)
        neg = _last_score(x, NEGATIVE_LABELS)
        neu = _last_score(x, NEUTRAL_LABELS)
        return F.when(F.size(x) > 0, _winner(x, pos, neg, neu)).otherwise(default_scores())

    return bind(items, rule)


def star_scores(items: Column | str) -> Column:
    """Rewrite five-star output as POSITIVE / NEGATIVE / NEUTRAL items by adding up the stars."""

    def total(x: Column, labels: tuple[str, ...]) -> Column:
        matching = F.filter(x, lambda i: F.upper(i["label"]).isin(*labels))
        return F.aggregate(matching, F.lit(0.0), lambda acc, i: acc + i["score"])

    def rule(x: Column) -> Column:
        grouped = F.array(
            *[
                F.struct(F.lit(name).alias("label"), total(x, labels).alias("score"))
                for name, labels in STAR_GROUPS.items()
            ]
        )
        return F.when(F.size(x) > 0, grouped)

    return bind(items, rule)


def hit_scores(positive_hits: Column, negative_hits: Column) -> Column:
    """Shares of positive and negative words; text with neither gets the default."""

    def rule(hits: Column) -> Column:
        p, n = hits["p"], hits["n"]
        total = F.nullif(p + n, F.lit(0))
        label = F.when(p > n, "POSITIVE").otherwise("NEGATIVE")
        scored = _scores(label, F.greatest(p, n) / total, p / total, n / total, F.lit(0.0))
        return F.when(p + n > 0, scored).otherwise(default_scores())

    return bind(F.struct(positive_hits.alias("p"), negative_hits.alias("n")), rule)


def unless_blank(text: Column | str, scores: Column) -> Column:
    return F.when(is_not_blank(text), scores).otherwise(default_scores())


def truncate(c: Column | str, max_chars: int = MODEL_MAX_CHARS) -> Column:
    """First ``max_chars`` characters: the input limit of a fixed-length classifier."""
    return F.left(as_column(c), F.lit(max_chars))


def sentiment_columns(scores: Column) -> Column:
    """The five ``sentiment_*`` columns of a struct of scores, for ``select``."""
    return once(scores).alias(*SENTIMENT_COLUMNS.values())
