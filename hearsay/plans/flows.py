"""End-to-end flows: collect, preprocess, analyse, and all of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import SENTIMENT_COLUMNS
from ..functions.text import Cleaner, is_not_blank, moderate_clean
from ..operators.dedup import dedup_posts
from ..operators.filters import clean_posts
from ..operators.summary import label_distribution
from ..schema import DEFAULT_HASHTAGS, DEFAULT_MAX_POSTS
from ..sources.posts import hashtag_quota, tag_posts

# Thresholds of the ready-made flows.
MIN_CHARS = 10
MIN_CONFIDENCE = 0.6

Scorer = Callable[[DataFrame], DataFrame]


def collect(
    posts: DataFrame,
    tags: Sequence[str] = DEFAULT_HASHTAGS,
    total: int = DEFAULT_MAX_POSTS,
    newest_first: Sequence[Column] = (),
    key: str = "post_id",
) -> DataFrame:
    """Posts carrying the tags, up to an even quota per tag, one per text, none blank.

    A text found under several tags is kept under the tag listed first.
    """
    tags = [t.lower() for t in tags]
    order = [*newest_first, F.col(key)]
    tagged = hashtag_quota(tag_posts(posts, tags), order, total, tags, (key,))
    position = F.array_position(F.array(*[F.lit(t) for t in tags]), F.col("source_hashtag"))
    unique = (key, "source_hashtag")
    return dedup_posts(tagged, (position,), key=unique).where(is_not_blank("text"))


def preprocess(posts: DataFrame, cleaner: Cleaner = moderate_clean) -> DataFrame:
    """Cleaned text of more than ten characters, in one projection."""
    return clean_posts(posts, cleaner=cleaner, longer_than=MIN_CHARS)


def analyze(posts: DataFrame, scorer: Scorer) -> DataFrame:
    """Scored posts; cleaned first when they are not yet."""
    cleaned = posts if "text_cleaned" in posts.columns else clean_posts(posts)
    return scorer(cleaned)


def full(posts: DataFrame, scorer: Scorer, **collect_options) -> DataFrame:
    return analyze(preprocess(collect(posts, **collect_options)), scorer)


def quick_start(posts: DataFrame, scorer: Scorer) -> DataFrame:
    """Label counts and shares among confidently scored posts."""
    scored = analyze(posts, scorer)
    confident = scored.where(F.col(SENTIMENT_COLUMNS["score"]) > MIN_CONFIDENCE)
    return label_distribution(confident)
