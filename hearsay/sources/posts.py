"""Raw records to posts, and choosing posts by tag or term."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import as_column, is_not_blank
from ..operators.dedup import dedup_posts
from ..operators.topn import first_per_group
from ..schema import DEFAULT_HASHTAGS, DEFAULT_MAX_POSTS, RAW_POST
from .files import read_json


def read_raw(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Nested records, one JSON object per line; see ``read_json`` for ``mode``."""
    return read_json(spark, path, RAW_POST, mode)


def flatten_posts(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Nested records to the flat post columns; missing text is empty and missing counts are 0."""
    text, count = F.lit(""), F.lit(0).cast("bigint")
    return raw.select(
        *keep,
        F.coalesce("text", text).alias("text"),
        F.coalesce("date", text).alias("date"),
        F.coalesce("user.name", text).alias("user"),
        F.coalesce("user.username", text).alias("username"),
        F.coalesce("stats.likes", count).alias("likes"),
        F.coalesce("stats.retweets", count).alias("retweets"),
        F.coalesce("stats.replies", count).alias("replies"),
        F.coalesce("source_hashtag", text).alias("source_hashtag"),
        F.coalesce("url", text).alias("url"),
    )


def union_by_tag(batches: Mapping[str, DataFrame]) -> DataFrame:
    """Stack one frame per tag, stamping each row with its tag."""
    stamped = [df.withColumn("source_hashtag", F.lit(tag)) for tag, df in batches.items()]
    return reduce(DataFrame.unionByName, stamped)


def hashtags(c: Column | str) -> Column:
    """Lower-cased tag words of a text, without the sign."""
    return F.regexp_extract_all(F.lower(as_column(c)), F.lit(P.TAG_WORD), F.lit(1))


def select_by_hashtag(df: DataFrame, tag: str, text_column: str = "text") -> DataFrame:
    return df.where(F.array_contains(hashtags(text_column), tag.lower()))


def select_by_keyword(df: DataFrame, keyword: str, text_column: str = "text") -> DataFrame:
    return df.where(F.contains(F.lower(text_column), F.lower(F.lit(keyword))))


def post_selector(mode: str = "hashtag"):
    selectors = {"hashtag": select_by_hashtag, "keyword": select_by_keyword}
    if mode not in selectors:
        raise ValueError(f"Unsupported selection mode: {mode}")
    return selectors[mode]


def hashtag_quota(
    df: DataFrame,
    order_by: Sequence[Column],
    total: int = DEFAULT_MAX_POSTS,
    tags: Sequence[str] | None = None,
    salt_by: Sequence[str] = ("post_id",),
    tag_column: str = "source_hashtag",
) -> DataFrame:
    """The first ``total // len(tags)`` rows of each tag; the remainder is left out."""
    tags = tuple(DEFAULT_HASHTAGS if tags is None else tags)
    wanted = df.where(F.col(tag_column).isin(*tags))
    return first_per_group(wanted, tag_column, order_by, total // len(tags), salt_by)


layoff_posts = partial(hashtag_quota, tags=("layoffs",))
jobcut_posts = partial(hashtag_quota, tags=("jobcuts",))
recession_posts = partial(hashtag_quota, tags=("recession",))


def tag_posts(df: DataFrame, tags: Sequence[str], text_column: str = "text") -> DataFrame:
    """One row per post and wanted tag in it, stamped with the tag; a single pass for all tags."""
    wanted = F.array(*[F.lit(t.lower()) for t in tags])
    found = F.explode(F.array_intersect(wanted, hashtags(text_column)))
    return df.drop("source_hashtag").select("*", found.alias("source_hashtag"))


def collect_posts(
    raw: DataFrame,
    order_by: Sequence[Column | str],
    keep: Sequence[str] = ("post_id",),
    key: str | Sequence[str] = "post_id",
) -> DataFrame:
    """Flatten, keep the first row of each text, drop blank texts. ``key`` must be among ``keep``."""
    posts = dedup_posts(flatten_posts(raw, keep), order_by, key=key)
    return posts.where(is_not_blank("text"))
