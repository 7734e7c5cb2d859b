"""Keywords by summed TF-IDF weight, over all terms in range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import MAX_DF, MIN_DF
from .scratch import store
from .termcounts import TERMS, count_terms
from .vectorize import Proportion, document_limit, english_stopwords

#: Terms in most posts, at most so many, that are sent to every task; counts of others are shuffled.
OFTEN = 20_000


def keyword_scores(
    df: DataFrame,
    text_column: str = "text_cleaned",
    ngram_range: tuple[int, int] = (1, 1),
    min_df: Proportion = MIN_DF,
    max_df: Proportion = MAX_DF,
    stopwords: Sequence[str] | None = None,
) -> DataFrame:
    """``(term, score)``: the weight of each term over all posts, posts scaled to length 1.

    Terms are those whose document frequency is in range, however many there are: counts and
    frequencies stay distributed, and no vocabulary reaches the driver. Texts are read once; what is
    kept of them is one row of term counts each. Most counts are of frequent terms, whose weights are
    broadcast; each of the others is in few posts, so they are joined as they are.
    """
    stop = tuple(english_stopwords() if stopwords is None else stopwords)
    numbered = df.select(F.monotonically_increasing_id().alias("_row"), text_column)
    posts = store(count_terms(numbered, text_column, ngram_range, stop, ["_row"]), "terms")
    n_docs = posts.count()
    counts = posts.select("_row", F.inline(TERMS).alias("term", "tf"))
    idf = F.log(F.lit(1 + n_docs).cast("double") / (1 + F.col("docs"))) + 1
    frequencies = store(
        counts.groupBy("term").agg(F.count("*").alias("docs")).withColumn("idf", idf), "idf"
    )
    in_range = (F.col("docs") >= document_limit(min_df, n_docs)) & (
        F.col("docs") <= document_limit(max_df, n_docs)
    )
    is_often = F.col("docs") >= _often(frequencies, OFTEN)
    often, rare = frequencies.where(is_often), frequencies.where(~is_often & in_range)
    weight = F.col("tf") * F.col("idf")

    def weighed(counts: DataFrame, *keep: str) -> DataFrame:
        near = counts.join(F.broadcast(often.where(in_range).select("term", "idf")), "term")
        far = counts.join(F.broadcast(often.select("term")), "term", "left_anti")
        # Files are far smaller than their rows, so Spark might broadcast too much by their size.
        far = far.join(rare.select("term", "idf").hint("merge"), "term")
        return near.unionByName(far).select(*keep, "term", weight.alias("w"))

    # Each task adds up the posts it reads; one number a post is shuffled. The terms of a post stay
    # together in its row when it gets its length.
    lengths = (
        weighed(counts, "_row")
        .groupBy("_row")
        .agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    )
    long = posts.join(lengths.hint("merge"), "_row").select(
        "_row", "length", F.inline(TERMS).alias("term", "tf")
    )
    return (
        weighed(long, "length").groupBy("term").agg(F.sum(F.col("w") / F.col("length")).alias("score"))
    )


def _often(frequencies: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` terms reach with their ``docs``."""
    bands = frequencies.groupBy(F.floor(F.log2("docs")).alias("band")).agg(F.count("*").alias("n"))
    least, held = 62, 0  # one row a power of two
    for band, n in sorted(map(tuple, bands.collect()), reverse=True):
        held += n
        if held > most:
            break
        least = band
    return 1 << least


def top_keywords(
    df: DataFrame, n: int = 20, text_column: str = "text_cleaned", **options
) -> DataFrame:
    scores = keyword_scores(df, text_column, **options)
    return scores.orderBy(F.desc("score"), "term").limit(n)
