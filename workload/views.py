"""Views over the given tables, once as Spark frames and once as SQL for the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.functions.scores import SENTIMENT_COLUMNS
from hearsay.operators.sentiment import score_sentiment

LEXICON = (("the", 1), ("with", 1), ("this", 1), ("and", -1), ("for", -1), ("was", -1))
EMOTIONS = (("that", "JOY"), ("are", "JOY"), ("from", "ANGER"), ("was", "ANGER"), ("this", "FEAR"))
POST_COLUMNS = ("post_id", "text", "source_hashtag", "lang", "likes", "n_chars")
GAZETTEER = (("The", "ORG"), ("Of", "ORG"), ("De", "ORG"), ("La", "PERSON"), ("Der", "PERSON"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts; the source stands for the tag a post was collected under."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("post_id"),
        "text",
        F.col("source").alias("source_hashtag"),
        "lang",
        (F.col("n_chars") % 97).alias("likes"),
        "n_chars",
    )


def _dated(spark: SparkSession, sf_dir: str, posts: DataFrame) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("post_id"),
        F.col("ts").alias("date"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user_name"),
    )
    return posts.join(events, "post_id")


def dated_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with the time and user of the event of the same id."""
    return _dated(spark, sf_dir, posts(spark, sf_dir))


def add_noise(df: DataFrame) -> DataFrame:
    """Mention, tag, link, address, digits, punctuation, CJK and an emoji around each text."""
    text = F.format_string(
        "RT @User_%d #%s http://Example.com/%d?k=1&v=a~b#frag %s me%d@ex.com  12 ok!? 日本 😀",
        F.col("post_id") % 7,
        "source_hashtag",
        "post_id",
        "text",
        "post_id",
    )
    return df.withColumn("text", text)


def noisy_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_noise(posts(spark, sf_dir))


def text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as text; some cannot be read and some are missing."""
    date = (
        F.when(F.col("lang") == "de", "not a date")
        .when(F.col("lang") == "es", F.lit(None))
        .otherwise(F.col("date").cast("string"))
    )
    return dated_posts(spark, sf_dir).select("post_id", date.alias("date"))


def scored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored before the join, so that texts need not go through it."""
    scored = score_sentiment(posts(spark, sf_dir), LEXICON, "text")
    sentiment = SENTIMENT_COLUMNS.values()
    return _dated(spark, sf_dir, scored).select(
        *POST_COLUMNS, "date", "user_name", *sentiment
    )


# The same views as SQL. Each is one WITH item.
POSTS = """posts AS (
  SELECT doc_id AS post_id, text, source AS source_hashtag, lang, n_chars % 97 AS likes, n_chars
  FROM documents)"""

DATED = """dated AS (
  SELECT p.*, e.ts AS date, concat('user', e.user_id) AS user_name
  FROM posts p JOIN events e ON p.post_id = e.event_id)"""

NOISE = """concat('RT @User_', post_id % 7, ' #', source_hashtag, ' http://Example.com/', post_id,
  '?k=1&v=a~b#frag ', text, ' me', post_id, '@ex.com  12 ok!? 日本 😀')"""

NOISY = f"noisy AS (SELECT * REPLACE ({NOISE} AS text) FROM posts)"

NOISY_DATED = f"noisy_dated AS (SELECT * REPLACE ({NOISE} AS text) FROM dated)"

TEXT_DATES = """text_dates AS (
  SELECT post_id, CASE lang WHEN 'de' THEN 'not a date' WHEN 'es' THEN NULL
                  ELSE CAST(date AS VARCHAR) END AS date FROM dated)"""
