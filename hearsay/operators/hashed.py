"""A scorer trained on hashed terms, its calibration, and the area under a score's ROC curve.

Terms become positions by hash, so no vocabulary reaches the driver and new texts have no unknown
term; what it holds is one weight a position. A fold that the weights have not seen turns margins
into probabilities.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import normalize_scores, sentiment_columns, unless_blank
from .scratch import cut_lineage, store
from .termcounts import TERMS, count_terms, small_parts
from .vectorize import sparse_vectors

BITS = 18
NGRAMS = (1, 2)
FOLDS = 5

# Task code travels with the job, so executors need no copy of this module.
register_pickle_by_value(sys.modules[__name__])


def hashed_entries(lists: pa.ListArray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and value of the terms' hashes: one plus the logarithm of a position's count,
    rows scaled to length 1, entries in order."""
    from pandas.util import hash_array

    entries = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    terms = np.array(entries.field("term").to_pylist(), dtype=object)
    # All terms at once; the hash of a term does not depend on the others.
    position = hash_array(terms, categorize=False) >> np.uint64(64 - bits) if len(terms) else terms
    place = (row << bits) + position.astype(np.int64)
    place, at = np.unique(place, return_inverse=True)
    row, position = place >> bits, place & ((1 << bits) - 1)
    value = 1 + np.log(np.bincount(at, entries.field("n").to_numpy(), minlength=1)[: len(place)])
    length = np.sqrt(np.bincount(row, value * value, minlength=max(1, len(lists))))
    return row, position, value / length[row]


def hashed_vectors(counted: DataFrame, bits: int, output: str) -> DataFrame:
    """The columns of ``counted`` with a sparse vector in place of its term counts."""
    others = [c for c in counted.columns if c != TERMS]
    fields = [counted.schema[c] for c in others]
    schema = T.StructType([*fields, T.StructField(output, VectorUDT())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches):
            row, position, value = hashed_entries(batch.column(batch.num_columns - 1), bits)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            found = sparse_vectors(1 << bits, cuts, position, value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=schema.names)

    return counted.select(*others, TERMS).mapInArrow(run, schema)


def margins(counted: DataFrame, weights: np.ndarray, intercept: float, bits: int) -> DataFrame:
    """The columns of ``counted`` with ``_margin`` in place of its term counts."""
    others = [c for c in counted.columns if c != TERMS]
    fields = [counted.schema[c] for c in others]
    schema = T.StructType([*fields, T.StructField("_margin", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches):
            row, position, value = hashed_entries(batch.column(batch.num_columns - 1), bits)
            total = np.bincount(row, value * weights[position], minlength=batch.num_rows)
            found = pa.array(total[: batch.num_rows].astype(float) + intercept)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=schema.names)

    return counted.select(*others, TERMS).mapInArrow(run, schema)


@dataclass(frozen=True)
class HashedScorer:
    """Weights by position, and the line that turns a margin into the logit of a probability."""

    weights: np.ndarray
    intercept: float
    slope: float
    shift: float
    bits: int
    ngram_range: tuple[int, int]

    def probability(self, margin: Column) -> Column:
        return 1 / (1 + F.exp(-(margin * self.slope + self.shift)))

    def transform(self, df: DataFrame, text_column: str = "text_cleaned") -> DataFrame:
        """Add the sentiment columns. No shuffle; blank texts get the default scores."""
        counted = count_terms(df, text_column, self.ngram_range)
        scored = margins(counted, self.weights, self.intercept, self.bits)
        positive = self.probability(F.col("_margin"))
        items = F.array(
            F.struct(F.lit("NEGATIVE").alias("label"), (1 - positive).alias("score")),
            F.struct(F.lit("POSITIVE").alias("label"), positive.alias("score")),
        )
        scores = unless_blank(text_column, normalize_scores(items))
        return scored.select(*df.columns, sentiment_columns(scores))


def train_hashed_scorer(
    df: DataFrame,
    label_column: str,
    text_column: str = "text_cleaned",
    bits: int = BITS,
    ngram_range: tuple[int, int] = NGRAMS,
    max_iter: int = 50,
    reg_param: float = 1e-4,
) -> HashedScorer:
    """Logistic regression on 0/1 labels over four fifths of the texts, calibrated on the rest.

    The fold is a hash of the text, so equal texts are never on both sides. Texts are cut once and
    their hashed vectors stored; each step of the fit reads those. Both classes must be in both
    parts. Rows without a label are left out.
    """
    labelled = df.where(F.col(label_column).isNotNull()).select(
        F.col(label_column).cast("double").alias("_label"),
        (F.pmod(F.xxhash64(text_column), F.lit(FOLDS)) == 0).alias("_held"),
        F.col(text_column).alias("_text"),
    )
    counted = count_terms(labelled, "_text", ngram_range, keep=["_label", "_held"])
    stored = store(counted, "hashed")
    learned = hashed_vectors(stored.where("NOT _held"), bits, "_features")
    options = {"labelCol": "_label", "maxIter": max_iter}
    # Scaled positions would undo the length of rows and fill every position.
    fitted = LogisticRegression(
        featuresCol="_features", regParam=reg_param, standardization=False, **options
    ).fit(store(learned, "vectors"))
    weights = fitted.coefficients.toArray()
    held = margins(stored.where("_held"), weights, fitted.intercept, bits)
    line = LogisticRegression(featuresCol="_point", **options).fit(
        held.select("_label", array_to_vector(F.array("_margin")).alias("_point"))
    )
    return HashedScorer(
        weights, fitted.intercept, float(line.coefficients[0]), line.intercept, bits, ngram_range
    )


def auc(df: DataFrame, score_column: str, label_column: str) -> DataFrame:
    """One row ``positives, negatives, auc``: the share of pairs of a positive and a negative row in
    which the positive one has the higher score, ties counting half; null without such pairs.

    Scores are counted, the counts sorted across the cluster, and the negatives below a score are
    those before it in its partition and in the partitions before that. Rows with a null label or a
    null or NaN score are left out.
    """
    label, score = F.col(label_column), F.col(score_column).cast("double")
    known = label.isNotNull() & score.isNotNull() & ~F.isnan(score)
    counts = (
        df.where(known)
        .groupBy(score.alias("s"))
        .agg(F.count_if(label == 1).alias("p"), F.count_if(label != 1).alias("n"))
        .orderBy("s")
        .withColumn("part", F.spark_partition_id())
    )
    counts = cut_lineage(counts)
    # One row a partition.
    parts = counts.groupBy("part").agg(F.sum("n").alias("held"))
    before = F.sum("held").over(Window.orderBy("part")) - F.col("held")
    starts = F.broadcast(parts.select("part", before.alias("before")))
    below = F.sum("n").over(Window.partitionBy("part").orderBy("s")) - F.col("n")
    ranked = counts.withColumn("below", below).join(starts, "part")
    won = F.sum(F.col("p") * (F.col("before") + F.col("below") + F.col("n") / 2))
    whole = ranked.agg(
        F.coalesce(F.sum("p"), F.lit(0).cast("bigint")).alias("positives"),
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("negatives"),
        won.alias("won"),
    )
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return whole.select("positives", "negatives", (F.col("won") / F.nullif(pairs, F.lit(0.0))).alias("auc"))
