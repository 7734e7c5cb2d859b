"""Count and TF-IDF features over a bounded vocabulary.

Term counts of a document are found once (``count_terms``); fitting is one aggregation over them,
and the vectors follow from the same counts where they are read, without a shuffle.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.ml.feature import StopWordsRemover, VectorAssembler, VectorSizeHint
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import TEXT_STATS, TIME_FEATURES
from ..schema import MAX_DF, MAX_FEATURES, MIN_DF
from .features import add_text_features, add_time_features
from .quantiles import exact_quantiles
from .scratch import store
from .termcounts import (
    SLICE_TOKENS,
    TERMS,
    count_ngrams,
    count_terms,
    frequent_totals,
    slices,
    small_parts,
    term_totals,
    tokens,
)

Proportion = int | float
#: Numbers of a dense matrix that a task holds at a time.
DENSE_NUMBERS = 1 << 20

# Task code travels with the job, so executors need no copy of this module.
register_pickle_by_value(sys.modules[__name__])


def english_stopwords() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def sparse_vectors(size: int, cuts: np.ndarray, index: np.ndarray, value: np.ndarray) -> pa.Array:
    """Sparse vectors of ``size`` positions in the layout of ``VectorUDT``; ``cuts`` are where each
    row's entries begin, and their end."""
    n, offsets = len(cuts) - 1, pa.array(cuts, pa.int32())
    return pa.StructArray.from_arrays(
        [
            pa.array(np.zeros(n, np.int8)),
            pa.array(np.full(n, size, np.int32)),
            pa.ListArray.from_arrays(offsets, pa.array(index.astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(value.astype(float))),
        ],
        names=["type", "size", "indices", "values"],
    )


def dense_vectors(rows: np.ndarray) -> pa.Array:
    n, size = rows.shape
    offsets = pa.array(np.arange(n + 1) * size, pa.int32())
    return pa.StructArray.from_arrays(
        [
            pa.array(np.ones(n, np.int8)),
            pa.nulls(n, pa.int32()),
            pa.nulls(n, pa.list_(pa.int32())),
            pa.ListArray.from_arrays(offsets, pa.array(rows.ravel())),
        ],
        names=["type", "size", "indices", "values"],
    )


@dataclass(frozen=True)
class TermModel:
    """A fitted vocabulary, sorted by term, with document frequencies."""

    vocabulary: tuple[str, ...]
    doc_freq: tuple[int, ...]
    n_docs: int
    tfidf: bool
    ngram_range: tuple[int, int]
    stopwords: tuple[str, ...]

    @property
    def idf(self) -> list[float]:
        return [math.log((1 + self.n_docs) / (1 + df)) + 1 for df in self.doc_freq]

    def _weigher(self) -> Callable[[pa.ListArray], pa.StructArray]:
        """Task code that turns term counts of some rows into their sparse vectors."""
        vocabulary, size = self.vocabulary, len(self.vocabulary)
        weights = np.array(self.idf) if self.tfidf else None

        def weigh(lists: pa.ListArray) -> pa.StructArray:
            entries = lists.flatten()
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            known = pa.array(vocabulary, pa.string())
            index = pc.fill_null(pc.index_in(entries.field("term"), known), -1).to_numpy()
            kept = np.flatnonzero(index >= 0)
            kept = kept[np.lexsort((index[kept], row[kept]))]
            row, index = row[kept], index[kept]
            value = entries.field("n").to_numpy()[kept].astype(float)
            if weights is not None:
                value *= weights[index]
                length = np.sqrt(np.bincount(row, value * value, minlength=len(lists)))
                value /= length[row]
            cuts = np.searchsorted(row, np.arange(len(lists) + 1))
            return sparse_vectors(size, cuts, index, value)

        return weigh

    def vectors(self, counted: DataFrame, output: str = "features") -> DataFrame:
        """The columns of ``counted`` with a sparse vector in place of its term counts."""
        others = [c for c in counted.columns if c != TERMS]
        fields = [counted.schema[c] for c in others]
        schema, weigh = T.StructType([*fields, T.StructField(output, VectorUDT())]), self._weigher()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_parts(batches):
                found = weigh(batch.column(batch.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=schema.names)

        return counted.select(*others, TERMS).mapInArrow(run, schema)

    def transform(
        self,
        df: DataFrame,
        text_column: str = "text_cleaned",
        output: str = "features",
        keep: Sequence[str] | None = None,
    ) -> DataFrame:
        """The ``keep`` columns (all) of ``df`` with a sparse vector. Terms are counted and weighed by
        the same Python worker, a slice at a time, so no term leaves it."""
        keep = df.columns if keep is None else list(keep)
        schema = T.StructType([*df.select(*keep).schema, T.StructField(output, VectorUDT())])
        weigh, (low, high) = self._weigher(), self.ngram_range

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in small_parts(batches, SLICE_TOKENS):
                found = weigh(count_ngrams(part.column(part.num_columns - 1), low, high))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], names=schema.names)

        cut = tokens(text_column, self.stopwords).alias("_tokens")
        return df.select(*keep, cut).mapInArrow(run, schema)

    def entries(
        self, vectors: DataFrame, keys: Sequence[str], column: str = "features"
    ) -> DataFrame:
        """``(*keys, term, value)`` for the terms each document has."""
        stored = explode_vector(vectors, keys, column)
        return name_entries(stored, self.vocabulary, "term").select(*keys, "term", "value")

    def long_form(
        self, df: DataFrame, keys: Sequence[str], text_column: str = "text_cleaned"
    ) -> DataFrame:
        """The same for texts that were not fitted."""
        return self.entries(self.transform(df, text_column, keep=keys), keys)


def name_entries(entries: DataFrame, names: Sequence[str], output: str) -> DataFrame:
    """Add the name at each ``index``.

    The table of names is broadcast: it has as many rows as the vectors have positions, which
    ``max_features`` bounds, and comes from the driver anyway.
    """
    table = name_table(entries.sparkSession, names, output)
    return entries.join(F.broadcast(table), "index")


def name_table(spark: SparkSession, names: Sequence[str], output: str) -> DataFrame:
    """``(index, output)`` of a vocabulary."""
    return spark.createDataFrame(list(enumerate(names)), f"index int, {output} string")


def explode_vector(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``(*keys, index, value)`` for the stored entries of a sparse vector column."""
    parts = F.unwrap_udt(column)
    entries = F.arrays_zip(parts["indices"].alias("index"), parts["values"].alias("value"))
    return df.select(*keys, F.inline(entries).alias("index", "value"))


def document_limit(limit: Proportion, n_docs: int) -> float:
    return limit * n_docs if isinstance(limit, float) else limit


def fit_counted(
    counted: DataFrame,
    max_features: int,
    min_df: Proportion,
    max_df: Proportion,
    tfidf: bool,
    ngram_range: tuple[int, int],
    stopwords: tuple[str, ...],
) -> TermModel:
    """Choose the ``max_features`` most frequent terms whose document frequency is in range. Only
    the chosen vocabulary reaches the driver. Of longer n-grams, which are nearly as many as the
    words of all texts, only those are shuffled that may be chosen."""
    n_docs = counted.count()
    in_range = (F.col("docs") >= document_limit(min_df, n_docs)) & (
        F.col("docs") <= document_limit(max_df, n_docs)
    )
    if ngram_range[1] > 1:
        chosen = frequent_totals(counted, max_features, in_range)
    else:
        chosen = term_totals(counted).where(in_range)
    chosen = chosen.orderBy(F.desc("total"), "term").limit(max_features)
    rows = sorted((r["term"], r["docs"]) for r in chosen.collect())
    if not rows:
        raise ValueError("No terms remain: lower min_df or raise max_df")
    return TermModel(
        tuple(t for t, _ in rows), tuple(d for _, d in rows), n_docs, tfidf, ngram_range, stopwords
    )


def fit_transform(
    df: DataFrame,
    text_column: str = "text_cleaned",
    output: str = "features",
    keep: Sequence[str] | None = None,
    max_features: int = MAX_FEATURES,
    min_df: Proportion = MIN_DF,
    max_df: Proportion = MAX_DF,
    ngram_range: tuple[int, int] = (1, 2),
    stopwords: Sequence[str] | None = None,
    tfidf: bool = True,
) -> tuple[TermModel, DataFrame]:
    """A fitted vocabulary, and the ``keep`` columns (all) of ``df`` with its vectors.

    ``df`` is read once: each row is stored with its term counts, from which all else comes.
    """
    stop = tuple(english_stopwords() if stopwords is None else stopwords)
    counted = store(count_terms(df, text_column, ngram_range, stop, keep), "terms")
    model = fit_counted(counted, max_features, min_df, max_df, tfidf, ngram_range, stop)
    return model, model.vectors(counted, output)


def fit_terms(
    df: DataFrame, text_column: str = "text_cleaned", **options
) -> TermModel:
    """The vocabulary alone, with the options of ``fit_transform``."""
    return fit_transform(df, text_column, keep=(), **options)[0]


# The options of the ready-made vectorisers.
TFIDF = {"tfidf": True}
COUNTS = {"tfidf": False, "ngram_range": (1, 1)}
BASIC_TFIDF = {"tfidf": True, "max_features": 500, "ngram_range": (1, 1)}
ADVANCED_TFIDF = {"tfidf": True, "max_features": 2000, "ngram_range": (1, 3)}
fit_tfidf = partial(fit_terms, **TFIDF)
fit_counts = partial(fit_terms, **COUNTS)
fit_basic_tfidf = partial(fit_terms, **BASIC_TFIDF)
fit_advanced_tfidf = partial(fit_terms, **ADVANCED_TFIDF)


@dataclass(frozen=True)
class FeatureMatrix:
    """A frame with one sparse ``features`` column, and what its positions mean."""

    frame: DataFrame
    names: tuple[str, ...]
    terms: TermModel

    @property
    def metadata(self) -> dict[str, int]:
        text = len(self.terms.vocabulary)
        return {
            "n_samples": self.terms.n_docs,
            "n_features": len(self.names),
            "text_feature_count": text,
            "other_feature_count": len(self.names) - text,
        }

    def long_form(self, keys: Sequence[str]) -> DataFrame:
        """``(*keys, feature, value)`` for the entries that are not zero."""
        vectors = self.frame.select(*keys, _sparse_parts("features").alias("_parts"))
        entries = F.arrays_zip(
            F.col("_parts.indices").alias("index"), F.col("_parts.values").alias("value")
        )
        stored = vectors.select(*keys, F.inline(entries).alias("index", "value"))
        named = name_entries(stored.where(F.col("value") != 0), self.names, "feature")
        return named.select(*keys, "feature", "value")


def _sparse_parts(column: str) -> Column:
    """Indices and values of a vector; one stored densely lists every position."""
    parts = F.unwrap_udt(column)
    dense = parts["indices"].isNull()
    positions = F.transform(parts["values"], lambda _, i: i)
    return F.struct(
        F.when(dense, positions).otherwise(parts["indices"]).alias("indices"),
        parts["values"].alias("values"),
    )


def feature_matrix(
    df: DataFrame,
    text_column: str = "text_cleaned",
    include_text_stats: bool = True,
    include_temporal: bool = True,
    vectorizer_type: str = "tfidf",
    **vectorizer_options,
) -> FeatureMatrix:
    """Text statistics, calendar fields and term weights in one vector.

    Any ``vectorizer_type`` other than ``'tfidf'`` means counts. ``df`` is read once: its rows are
    stored with their statistics, fields and term counts.
    """
    keep, names = df.columns, []
    if include_text_stats:
        df = add_text_features(df, text_column)
        names += [f"text_{s}" for s in TEXT_STATS]
    if include_temporal and "date" in df.columns:
        df = add_time_features(df)
        names += TIME_FEATURES
    options = {**(TFIDF if vectorizer_type == "tfidf" else COUNTS), **vectorizer_options}
    model, vectors = fit_transform(df, text_column, "_text_features", **options)
    sized = VectorSizeHint(
        inputCol="_text_features", size=len(model.vocabulary), handleInvalid="optimistic"
    )
    assembled = VectorAssembler(
        inputCols=[*names, "_text_features"], outputCol="features", handleInvalid="keep"
    ).transform(sized.transform(vectors))
    frame = assembled.select(*keep, "features")
    return FeatureMatrix(frame, (*names, *model.vocabulary), model)


sentiment_features = partial(feature_matrix, include_temporal=False, vectorizer_type="tfidf")
topic_features = partial(
    feature_matrix, include_text_stats=False, include_temporal=False, vectorizer_type="count"
)


@dataclass(frozen=True)
class MatrixScaler:
    """Centre and width of every position of a feature matrix.

    An entry that is not stored is 0; once scaled it is ``zeros[position]``, so a scaled matrix needs
    no dense rows.
    """

    names: tuple[str, ...]
    centers: tuple[float, ...]
    widths: tuple[float, ...]

    @property
    def zeros(self) -> tuple[float, ...]:
        return tuple(-c / w for c, w in zip(self.centers, self.widths))

    def long_form(self, matrix: FeatureMatrix, keys: Sequence[str]) -> DataFrame:
        """``(*keys, feature, value)``, scaled, for the entries that were not zero."""
        table = matrix.frame.sparkSession.createDataFrame(
            list(zip(self.names, self.centers, self.widths)), "feature string, c double, w double"
        )
        # One row a position, as in name_entries.
        scaled = ((F.col("value") - F.col("c")) / F.col("w")).alias("value")
        entries = matrix.long_form(keys).join(F.broadcast(table), "feature")
        return entries.select(*keys, "feature", scaled)

    def transform(self, matrix: FeatureMatrix, output: str = "scaled") -> ScaledMatrix:
        """The scaled matrix: sparse vectors of value over width, and ``zeros`` to be added to
        every row. Rows stay as sparse as they were."""
        widths = np.array(self.widths)
        parts = _sparse_parts("features")

        def scale(index: np.ndarray, value: np.ndarray) -> np.ndarray:
            return value / widths[index]

        frame = _mapped(matrix.frame, parts, output, len(self.names), scale, None)
        return ScaledMatrix(frame, self.names, self.zeros, output)


def _mapped(frame, parts, output, size, scale, offset) -> DataFrame:
    """``frame`` with one more vector column: the entries in ``parts``, scaled, in sparse rows; or
    added to ``offset`` in dense ones."""
    schema = T.StructType([*frame.schema.fields, T.StructField(output, VectorUDT())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(np.full(batch.num_rows, size), DENSE_NUMBERS):
                part = batch.slice(start, stop - start)
                index, value = part.column(part.num_columns - 1).flatten()
                cuts = index.offsets.to_numpy() - index.offsets[0].as_py()
                index, value = index.flatten().to_numpy(), value.flatten().to_numpy()
                kept = value != 0
                row = np.repeat(np.arange(part.num_rows), np.diff(cuts))[kept]
                index, value = index[kept], scale(index[kept], value[kept])
                if offset is None:
                    cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                    found = sparse_vectors(size, cuts, index, value)
                else:
                    rows = np.tile(offset, (part.num_rows, 1))
                    rows[row, index] += value
                    found = dense_vectors(rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], names=schema.names)

    return frame.select("*", parts.alias("_parts")).mapInArrow(run, schema)


@dataclass(frozen=True)
class ScaledMatrix:
    """Sparse vectors in ``column`` of ``frame``; a row's scaled values are its vector plus
    ``offset``. A linear model may use both as they are; others read ``dense``."""

    frame: DataFrame
    names: tuple[str, ...]
    offset: tuple[float, ...]
    column: str

    def dense(self, output: str = "dense") -> DataFrame:
        """``frame`` with the whole scaled vectors, for estimators of ``pyspark.ml``. A task holds
        a bounded number of them at a time."""
        same = lambda index, value: value
        offset = np.array(self.offset)
        return _mapped(
            self.frame, _sparse_parts(self.column), output, len(self.names), same, offset
        )

    def long_form(self, keys: Sequence[str]) -> DataFrame:
        """``(*keys, feature, value)`` for every position of every row, zeros of the matrix too."""
        values = F.unwrap_udt("_dense")["values"]
        every = self.dense("_dense").select(*keys, F.posexplode(values).alias("index", "value"))
        return name_entries(every, self.names, "feature").select(*keys, "feature", "value")


def fit_matrix_scaler(matrix: FeatureMatrix, method: str = "standard") -> MatrixScaler:
    """Standard, minmax or robust scaling of every position, zeros counted, NaN left out.

    Statistics come from the stored entries; what reaches the driver is one row a position.
    """
    entries = store(
        matrix.frame.select(_sparse_parts("features").alias("_parts"))
        .select(
            F.inline(
                F.arrays_zip(
                    F.col("_parts.indices").alias("index"), F.col("_parts.values").alias("value")
                )
            )
        )
        .where("value != 0"),
        "entries",
    )
    total = matrix.frame.count()
    number = F.nanvl("value", F.lit(None).cast("double"))
    stats = {
        r["index"]: r
        for r in entries.groupBy("index")
        .agg(
            F.count(number).alias("n"),
            F.count_if(F.isnan("value")).alias("nan"),
            F.sum(number).alias("sum"),
            F.avg(number).alias("avg"),
            F.var_pop(number).alias("var"),
            F.min(number).alias("min"),
            F.max(number).alias("max"),
        )
        .collect()
    }
    zeros = {i: total - r["n"] - r["nan"] for i, r in stats.items()}
    centers, widths = [0.0] * len(matrix.names), [0.0] * len(matrix.names)
    if method == "robust":
        rest = entries.sparkSession.createDataFrame(
            [(i, 0.0, n) for i, n in zeros.items()], "index int, value double, times bigint"
        )
        weighed = entries.withColumn("times", F.lit(1).cast("bigint")).unionByName(rest)
        found = exact_quantiles(
            weighed, {"v": "value"}, (0.25, 0.5, 0.75), by=("index",), weight="times"
        )
        quantiles = {(r["index"], r["prob"]): r["value"] for r in found.collect()}
        for i in {i for i, _ in quantiles}:
            centers[i] = quantiles[i, 0.5]
            widths[i] = quantiles[i, 0.75] - quantiles[i, 0.25]
    elif method in ("standard", "minmax"):
        for i, r in stats.items():
            n = r["n"] + zeros[i]
            if not r["n"]:
                continue
            if method == "standard":
                share = r["n"] / n
                centers[i] = r["sum"] / n
                # Spread of the stored entries, and that between them and the zeros.
                widths[i] = math.sqrt(share * (r["var"] + (1 - share) * r["avg"] ** 2))
            else:
                ends = [r["min"], r["max"], *([0.0] if zeros[i] else [])]
                centers[i], widths[i] = min(ends), max(ends) - min(ends)
    else:
        raise ValueError(f"no such scaling: {method!r} (standard, minmax or robust)")
    return MatrixScaler(matrix.names, tuple(centers), tuple(w or 1.0 for w in widths))
