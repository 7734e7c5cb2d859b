"""Term counts of each text: its different n-grams with how often each occurs.

Texts are cut into tokens once, in the JVM. Token lists are then counted a batch at a time on integer
codes, so no string is compared and an n-gram is put together once a batch. What a row keeps are its
different terms; vocabularies, document frequencies and vectors all follow from them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.text import as_column
from .scratch import store

TERMS = "_terms"
ENTRY = T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.IntegerType())])
#: Tokens that are counted at a time; a longer text is counted alone.
SLICE_TOKENS = 1 << 18
#: Term counts that are worked on at a time; those of one text are never parted.
SLICE_ENTRIES = 1 << 18
#: Hash buckets that totals are first added up in, and how many of the fullest are tried for each
#: term wanted.
BUCKETS, TRIED = 1 << 18, 4

# Task code travels with the job, so executors need no copy of this module.
register_pickle_by_value(sys.modules[__name__])


def tokens(c: Column | str, stopwords: Sequence[str] = ()) -> Column:
    """Lower-cased runs of two or more word characters, less stop words; none for null."""
    found = F.regexp_extract_all(F.lower(as_column(c)), F.lit(P.TOKEN), F.lit(0))
    if stopwords:
        stop = sorted(set(stopwords))
        found = F.filter(found, lambda t: ~t.isin(stop))
    return F.coalesce(found, F.array().cast("array<string>"))


def count_ngrams(lists: pa.ListArray, low: int, high: int) -> pa.ListArray:
    """For each list of tokens its different n-grams of ``low`` to ``high`` tokens, with counts."""
    sizes = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    coded = lists.flatten().dictionary_encode()
    words, word = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    names, gram = words, word.copy()  # of the n-gram that starts at each token, if one does
    here = np.arange(len(word))
    found: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
    for n in range(1, high + 1):
        if n > 1:
            here = here[: np.searchsorted(here, len(word) - n + 1)]
            here = here[row[here] == row[here + n - 1]]
            longer = gram[here] * len(words) + word[here + n - 1]
            different, gram[here] = np.unique(longer, return_inverse=True)
            first, last = np.divmod(different, max(1, len(words)))
            names = pc.binary_join_element_wise(names.take(first), words.take(last), " ")
        if n >= low and len(here):
            held = row[here] * len(names) + gram[here]
            different, counts = np.unique(held, return_counts=True)
            of_row, name = np.divmod(different, len(names))
            found.append((of_row, names.take(pa.array(name)), counts))
    if not found:
        found = [(np.empty(0, np.int64), pa.array([], pa.string()), np.empty(0, np.int64))]
    rows, terms, counts = zip(*found)
    rows = np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    entries = pa.StructArray.from_arrays(
        [
            pa.concat_arrays([t.cast(pa.string()) for t in terms]).take(pa.array(order)),
            pa.array(np.concatenate(counts)[order].astype(np.int32)),
        ],
        names=ENTRY.names,
    )
    cuts = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(sizes)))))
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), entries)


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows whose ``sizes`` add up to at most ``most``, or of one row."""
    upto, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield start, stop
        start = stop


def small_parts(
    batches: Iterator[pa.RecordBatch], most: int = SLICE_ENTRIES
) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows, so that their last columns, lists, hold at most ``most`` entries.
    What a task holds beside a batch then does not grow with the batch."""
    for batch in batches:
        sizes = np.diff(batch.column(batch.num_columns - 1).offsets.to_numpy())
        for start, stop in slices(sizes, most):
            yield batch.slice(start, stop - start)


def count_terms(
    df: DataFrame,
    text_column: str = "text_cleaned",
    ngram_range: tuple[int, int] = (1, 1),
    stopwords: Sequence[str] = (),
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The ``keep`` columns (all) and ``_terms``, an array of ``(term, n)``. No shuffle. Null and
    empty texts have no terms. Store the result when it is read more than once."""
    low, high = ngram_range
    keep = df.columns if keep is None else list(keep)
    kept = df.select(*keep)
    schema = T.StructType([*kept.schema.fields, T.StructField(TERMS, T.ArrayType(ENTRY))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            for start, stop in slices(np.diff(lists.offsets.to_numpy()), SLICE_TOKENS):
                part = batch.slice(start, stop - start)
                counted = count_ngrams(part.column(part.num_columns - 1), low, high)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], counted], names=schema.names
                )

    cut = tokens(text_column, stopwords).alias("_tokens")
    return df.select(*keep, cut).mapInArrow(run, schema)


def term_totals(counted: DataFrame) -> DataFrame:
    """``(term, total, docs)``: occurrences of each term and documents that have it. A document has
    one row a term, so both are sums that each task begins by itself."""
    return _totals(counted.select(F.inline(TERMS)))


def _totals(entries: DataFrame) -> DataFrame:
    return entries.groupBy("term").agg(F.sum("n").alias("total"), F.count("*").alias("docs"))


def frequent_totals(
    counted: DataFrame, wanted: int, in_range: Column, buckets: int = BUCKETS
) -> DataFrame:
    """``term_totals`` of terms ``in_range`` (a test of ``docs``), at least of the ``wanted`` most
    frequent ones, without a shuffle of all terms.

    Occurrences are added up by a hash of the term first. The terms of the fullest buckets are
    counted; the ``wanted``-th largest total among them is one that any term sought must reach, and
    so must its bucket. Terms of all such buckets are counted, however many there are.
    """
    entries = counted.select(F.inline(TERMS)).withColumn(
        "bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    )
    held = store(entries.groupBy("bucket").agg(F.sum("n").alias("held")), "buckets")
    fullest = held.orderBy(F.desc("held"), "bucket").limit(TRIED * wanted)
    tried = _totals(entries.join(F.broadcast(fullest.select("bucket")), "bucket", "left_semi"))
    reached = tried.where(in_range).orderBy(F.desc("total")).limit(wanted)
    found = reached.agg(F.count("*").alias("n"), F.min("total").alias("least")).first()
    least = found["least"] if found["n"] == wanted else 0
    # At most ``buckets`` numbers.
    full = held.where(F.col("held") >= least).select("bucket")
    return _totals(entries.join(F.broadcast(full), "bucket", "left_semi")).where(in_range)
