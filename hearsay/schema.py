"""Record shapes and default parameters."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()
_L = T.LongType()

# Column names, defaults and parameters a post table is expected to have.
POST = T.StructType(
    [
        T.StructField("text", _S),
        T.StructField("date", _S),
        T.StructField("user", _S),
        T.StructField("username", _S),
        T.StructField("likes", _L),
        T.StructField("retweets", _L),
        T.StructField("replies", _L),
        T.StructField("source_hashtag", _S),
        T.StructField("url", _S),
    ]
)
RAW_POST = T.StructType(
    [
        T.StructField("text", _S),
        T.StructField("date", _S),
        T.StructField("user", T.StructType([T.StructField("name", _S), T.StructField("username", _S)])),
        T.StructField(
            "stats",
            T.StructType(
                [T.StructField("likes", _L), T.StructField("retweets", _L), T.StructField("replies", _L)]
            ),
        ),
        T.StructField("source_hashtag", _S),
        T.StructField("url", _S),
    ]
)
MODEL_OUTPUT = T.ArrayType(
    T.StructType([T.StructField("label", _S), T.StructField("score", T.DoubleType())])
)
REQUIRED_COLUMNS = ("text", "date", "user")
DEFAULT_HASHTAGS = ("layoffs", "jobcuts", "unemployment", "recession")
DEFAULT_MAX_POSTS = 1000
NUM_TOPICS = 5
MAX_FEATURES = 1000
MIN_DF = 2
MAX_DF = 0.8
RANDOM_SEED = 42
SENTIMENT_LABELS = ("POSITIVE", "NEGATIVE", "NEUTRAL")
