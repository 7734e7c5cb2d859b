"""Benchmark passages in documents, by a distributed positional inverted index.

Documents are stored once as words with a row number. Test items are cut into windows; the terms of
each window are ordered by their frequency in the documents. The stored postings (term, row,
position) of the rarest terms are intersected at their offsets: a posting of the rarest term gives
the start a window would have, and the next rarest term must stand at its own offset from there.
The few starts that are left are compared with the stored words.

Only DataFrame operations are used. Terms that no window needs for its lists get no postings, since
they could only confirm what the comparison of words confirms.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearsay.operators.joins import fits_broadcast, lookup_join
from hearsay.operators.scratch import store

from .common import FILE, ROW, with_row_id

WINDOW = 10
# Every ASCII character but letters and digits ends a word; all others are part of one.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the built-in serves where a text is ASCII throughout."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: str) -> Column:
    """The words of a text in order; none for null."""
    content = F.coalesce(F.col(text), F.lit(""))
    return F.array_remove(F.split(lower_ascii(content), SEPARATOR), "")


def stored_words(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """The index's own copy of the documents: row number ``rid``, words and the kept columns.

    The words of a row are one string with a blank, which no word holds, between them (see
    ``listed``): a column of word lists would take its writers and readers several times the memory.
    """
    found = docs.select(*keep, words(text).alias("words"))
    return store(
        found.withColumns(
            {
                "words": F.concat_ws(" ", "words"),
                "rid": F.monotonically_increasing_id(),
                "n_words": F.size("words").cast("bigint"),
            }
        ),
        "words",
    )


def listed(joined: str = "words") -> Column:
    """The words of a stored row in order. Generators take this itself: from a column of it Spark
    would make a filter too, and split every text twice."""
    none = F.array().cast("array<string>")
    return F.when(F.col(joined) != "", F.split(joined, " ")).otherwise(none)


def item_windows(items: DataFrame, size: int, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Stored ``(win, terms, n)`` of the different windows, and ``(win, item)``.

    Every run of ``size`` words of an item; an item of fewer words, but not none, is one window.
    """
    count = F.size("terms")
    last = F.greatest(count - size, F.lit(0))
    cut = (
        items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"),
                     words(text).alias("terms"))
        .where(count > 0)
        .select("item", "terms", F.explode(F.sequence(F.lit(0), last)).alias("at"))
        .select("item", F.slice("terms", F.col("at") + 1, size).alias("terms"))
    )
    cut = store(cut.distinct(), "cut")
    windows = store(
        cut.select("terms")
        .distinct()
        .withColumns({"win": F.monotonically_increasing_id(), "n": F.size("terms")}),
        "windows",
    )
    return windows, store(cut.join(windows, "terms").select("win", "item").distinct(), "items")


def rarest_first(windows: DataFrame, index: DataFrame) -> DataFrame:
    """Stored ``(win, n, first, first_at, second, second_at)``: the rarest and next rarest term of
    each window that can occur, with their offsets. A window with a term that no document has is
    left out; a window of one word has no second."""
    terms = windows.select("win", "n", F.posexplode("terms").alias("at", "term"))
    vocabulary = store(terms.select("term").distinct(), "vocabulary")
    tokens = index.select("rid", F.explode(listed()).alias("term"))
    counts = store(
        lookup_join(tokens, vocabulary, "term", ["rid"], "inner")
        .groupBy("term")
        .agg(F.count("*").alias("count")),
        "frequencies",
    )
    rank = F.struct("count", "term", "at")
    return store(
        terms.join(counts, "term")
        .groupBy("win", "n")
        .agg(F.sort_array(F.collect_list(rank)).alias("ranked"))
        .where(F.size("ranked") == F.col("n"))
        .select(
            "win",
            "n",
            F.col("ranked")[0]["term"].alias("first"),
            F.col("ranked")[0]["at"].alias("first_at"),
            F.when(F.col("n") > 1, F.get("ranked", 1)["term"]).alias("second"),
            F.when(F.col("n") > 1, F.get("ranked", 1)["at"]).alias("second_at"),
        ),
        "rarest",
    )


def postings(index: DataFrame, lists: DataFrame) -> DataFrame:
    """Stored ``(term, rid, pos)`` of every occurrence of the terms whose lists are needed."""
    needed = store(
        lists.select(F.col("first").alias("term"))
        .union(lists.where("second IS NOT NULL").select("second"))
        .distinct(),
        "needed",
    )
    tokens = index.select("rid", F.posexplode(listed()).alias("pos", "term"))
    return store(lookup_join(tokens, needed, "term", ["rid"], "inner"), "postings")


def occurrences(
    index: DataFrame,
    items: DataFrame,
    size: int = WINDOW,
    slop: int = 0,
    text: str = "text",
    key: str = "item_id",
) -> tuple[DataFrame, DataFrame]:
    """Stored ``(rid, win, start, n, kind)`` of every window found, and ``(win, item)``.

    kind ``phrase``: the window's words stand there one after another, from word ``start`` on. With
    ``slop`` above 0 also kind ``proximity``: all its words stand within ``slop`` words before and
    after the place that its two rarest words, at most ``slop`` words out of step, point to.
    """
    windows, of_items = item_windows(items, size, text, key)
    lists = rarest_first(windows, index)
    found = postings(index, lists)
    first = found.withColumnRenamed("term", "first")
    starts = lookup_join_many(first, lists, "first").select(
        "rid", "win", "n", "second", "second_at", (F.col("pos") - F.col("first_at")).alias("start")
    )
    # A text end may cut a near match, never an exact one.
    starts = starts.where(F.col("start") >= -slop)
    width = slop + 1
    expected = F.col("start") + F.col("second_at")
    cells = F.sequence(F.floor((expected - slop) / width), F.floor((expected + slop) / width))
    wanted = starts.where("second IS NOT NULL").withColumn("cell", F.explode(cells))
    second = found.select(
        F.col("term").alias("second"), "rid", F.col("pos").alias("second_pos"),
        F.floor(F.col("pos") / width).alias("cell"),
    )
    met = (
        wanted.join(second, ["rid", "second", "cell"])
        .where(F.abs(F.col("second_pos") - expected) <= slop)
        .select("rid", "win", "start")
        .union(starts.where("second IS NULL").select("rid", "win", "start"))
        .distinct()
    )
    met = store(met, "starts")
    rows = store(met.select("rid").distinct(), "rows")
    texts = index.select("rid", "words")
    if fits_broadcast(rows):
        texts = texts.join(F.broadcast(rows), "rid", "left_semi")
    placed = texts.join(met, "rid")
    compared = lookup_join(placed, windows, "win", ["rid", "start"], "inner")
    # Texts are joined as strings and split where they are compared.
    compared = compared.withColumn("words", listed())
    exact = (F.col("start") >= 0) & (
        F.slice("words", F.greatest("start", F.lit(0)) + 1, F.col("n")) == F.col("terms")
    )
    low = F.greatest(F.col("start") - slop, F.lit(0))
    around = F.slice("words", low + 1, F.col("start") + F.col("n") + slop - low)
    near = F.size(F.array_except("terms", around)) == 0
    kind = F.when(exact, "phrase").when(F.lit(slop > 0) & near, "proximity")
    result = compared.select("rid", "win", "start", "n", kind.alias("kind"))
    return store(result.where("kind IS NOT NULL"), "occurrences"), of_items


def lookup_join_many(df: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Equi-join to a table with any number of rows a key; broadcast only if measured as small."""
    return df.join(F.broadcast(table) if fits_broadcast(table) else table, on)


def coverage(found: DataFrame) -> DataFrame:
    """``(rid, n_hit)``: the words of each row that lie in any occurrence."""
    end = F.col("start") + F.col("n")
    before = (
        Window.partitionBy("rid").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        found.select("rid", "start", "n")
        .distinct()
        .withColumn("covered", F.coalesce(F.max(end).over(before), F.lit(0)))
        .groupBy("rid")
        .agg(
            F.sum(F.greatest(F.lit(0), end - F.greatest("start", "covered")))
            .cast("bigint")
            .alias("n_hit")
        )
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    size: int = WINDOW,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    item_text: str = "text",
    item_key: str = "item_id",
) -> DataFrame:
    """For every row of ``docs``: the kept columns, ``n_words``, ``n_hit`` (words inside any
    occurrence), ``n_items``, ``items_sha256`` (of the sorted, comma-joined item keys) and
    ``contaminated``.

    Null and empty texts have no words and are clean. Items that share a window are all reported;
    items with equal keys count as one and a null key is the empty string.
    """
    index = stored_words(docs, text, keep)
    found, of_items = occurrences(index, items, size, 0, item_text, item_key)
    named = (
        lookup_join_many(found.select("rid", "win").distinct(), of_items, "win")
        .groupBy("rid")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    hits = coverage(found).join(named, "rid")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return (
        index.select("rid", "n_words", *keep)
        .join(hits, "rid", "left")
        .select(
            *keep,
            "n_words",
            n_hit.alias("n_hit"),
            F.size(listed).cast("bigint").alias("n_items"),
            F.sha2(F.concat_ws(",", listed).cast("binary"), 256).alias("items_sha256"),
            (n_hit > 0).alias("contaminated"),
        )
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text",
    item_key: str = "item_id",
) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; columns and their order stay."""
    known = with_row_id(docs)
    judged = contamination(
        known, items, text=text, keep=(FILE, ROW), item_text=item_text, item_key=item_key
    )
    hit = store(judged.where("contaminated").select(FILE, ROW), "contaminated")
    if fits_broadcast(hit):
        hit = F.broadcast(hit)
    return known.join(hit, [FILE, ROW], "left_anti").select(*docs.columns)
