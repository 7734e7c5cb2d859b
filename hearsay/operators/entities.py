"""Names of organisations and people: mentions of a name table, and capitalised runs as candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import as_column
from .joins import lookup_join
from .scratch import store


def _name_words(c: Column | str) -> Column:
    return F.coalesce(
        F.regexp_extract_all(as_column(c), F.lit(P.WORD_RUN), F.lit(0)),
        F.array().cast("array<string>"),
    )


def name_candidates(c: Column | str) -> Column:
    return F.regexp_extract_all(as_column(c), F.lit(P.NAME_RUN), F.lit(0))


def candidate_counts(df: DataFrame, text_column: str = "text_cleaned") -> DataFrame:
    exploded = df.select(F.explode(name_candidates(text_column)).alias("name"))
    return exploded.groupBy("name").agg(F.count("*").alias("count"))


def _first_words(known: DataFrame) -> DataFrame:
    """``(_first, _lengths)``: how many words the names that start with a word have. Lengths are as
    few as the longest name has words, however many names share a first word."""
    parts = F.split("_run", " ")
    lengths = known.select(parts[0].alias("_first"), F.size(parts).alias("_n")).distinct()
    return lengths.groupBy("_first").agg(F.sort_array(F.collect_set("_n")).alias("_lengths"))


def name_runs(posts: DataFrame, firsts: DataFrame, longest: int) -> DataFrame:
    """``(_row, _at, _n, _run)``: the runs of words that may be a name, from ``posts (_row, _w)``.

    Only positions whose word starts a name are kept, and only lengths that such names have are
    tried. A position carries the words that a name could have, not the whole text.
    """
    ahead = F.transform("_w", lambda _, i: F.slice("_w", i + 1, longest))
    starts = posts.select("_row", F.posexplode(ahead).alias("_at", "_ahead")).withColumn(
        "_first", F.get("_ahead", F.lit(0))
    )
    hits = lookup_join(starts, firsts, "_first", ["_row", "_at"], "inner")
    runs = hits.select("_row", "_at", F.explode("_lengths").alias("_n"), "_ahead")
    run = F.array_join(F.slice("_ahead", F.lit(1), F.col("_n")), " ").alias("_run")
    return runs.where(F.col("_n") <= F.size("_ahead")).select("_row", "_at", "_n", run)


def entity_mentions(
    df: DataFrame, gazetteer: DataFrame, text_column: str = "text_cleaned"
) -> DataFrame:
    """``(type, name)`` of every mention: runs of words that are a name of the table.

    Texts and names are compared as words, so punctuation and spacing do not matter, but case does.
    Where names overlap, the one that starts first and then the longest wins; a name may have
    several types. The table may have any size: it is joined, first by the first word of its names.
    """
    name_words = F.array_join(_name_words("name"), " ").alias("_run")
    known = gazetteer.select(name_words, "name", "type").where("_run != ''").distinct()
    known = known.groupBy("_run").agg(F.sort_array(F.collect_set(F.struct("type", "name"))).alias("_as"))
    known = store(known, "names")
    firsts = store(_first_words(known), "first_words")
    longest = firsts.agg(F.max(F.array_max("_lengths"))).first()[0] or 1
    posts = store(
        df.select(F.monotonically_increasing_id().alias("_row"), _name_words(text_column).alias("_w")),
        "words",
    )
    runs = name_runs(posts, firsts, longest)
    found = lookup_join(runs, known, "_run", ["_row", "_at"], "inner")
    # Along a text: a mention counts if it starts after the last one that counted.
    mention = F.struct("_at", (-F.col("_n")).alias("_longer"), "_as")
    start = F.struct(
        F.lit(0).alias("end"),
        F.array().cast("array<array<struct<type:string,name:string>>>").alias("kept"),
    )

    def step(state: Column, m: Column) -> Column:
        taken = F.struct(
            (m["_at"] - m["_longer"]).alias("end"),
            F.concat(state["kept"], F.array(m["_as"])).alias("kept"),
        )
        return F.when(m["_at"] >= state["end"], taken).otherwise(state)

    ordered = found.groupBy("_row").agg(F.sort_array(F.collect_list(mention)).alias("_all"))
    kept = F.aggregate("_all", start, step)["kept"]
    return ordered.select(F.inline(F.flatten(kept))).select("type", "name")


def entity_counts(
    df: DataFrame, gazetteer: DataFrame, text_column: str = "text_cleaned"
) -> DataFrame:
    """``(type, name, count)`` of the mentions."""
    return entity_mentions(df, gazetteer, text_column).groupBy("type", "name").agg(
        F.count("*").alias("count")
    )
