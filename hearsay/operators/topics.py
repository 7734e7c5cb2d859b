"""LDA topics, their words, their distribution and clusters of posts."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import NUM_TOPICS, RANDOM_SEED
from .features import label_codes
from .scratch import store
from .termcounts import TERMS, small_parts
from .vectorize import COUNTS, TermModel, fit_transform, name_table

# Task code travels with the job, so executors need no copy of this module.
register_pickle_by_value(sys.modules[__name__])

#: Step sizes of fitting: each iteration reads all texts, so early ones may count in full.
LEARNING_OFFSET, LEARNING_DECAY = 1.0, 0.51


@dataclass(frozen=True)
class TopicModel:
    terms: TermModel
    lda: LDAModel

    def transform(self, df: DataFrame, text_column: str = "text_cleaned") -> DataFrame:
        """Add ``topic_weights`` (a vector) and ``topic``, the heaviest one."""
        return self.assign(self.terms.transform(df, text_column, "_features"))

    def assign(self, vectors: DataFrame) -> DataFrame:
        """The same for texts whose vectors are known (``_features``, dropped)."""
        weighted = self.lda.transform(vectors).drop("_features")
        weights = vector_to_array("topic_weights")
        heaviest = F.array_position(weights, F.array_max(weights)) - 1
        return weighted.withColumn("topic", heaviest.cast("int"))

    def top_words(self, n: int = 10) -> DataFrame:
        """``(topic, rank, term, weight)``."""
        described = self.lda.describeTopics(n)
        names = F.array(*[F.lit(t) for t in self.terms.vocabulary])
        pairs = F.arrays_zip(
            F.col("termIndices").alias("index"), F.col("termWeights").alias("weight")
        )
        return described.select("topic", F.posexplode(pairs).alias("rank", "pair")).select(
            "topic",
            (F.col("rank") + 1).alias("rank"),
            F.get(names, F.col("pair.index")).alias("term"),
            F.col("pair.weight").alias("weight"),
        )


def fit_topics(
    df: DataFrame,
    text_column: str = "text_cleaned",
    k: int = NUM_TOPICS,
    max_iter: int = 20,
    seed: int = RANDOM_SEED,
    subsampling_rate: float = 1.0,
    **term_options,
) -> TopicModel:
    """Every iteration reads all texts; a lower ``subsampling_rate`` reads that share, drawn anew
    each time, which is faster and may miss texts altogether."""
    options = {**term_options, "k": k, "max_iter": max_iter, "seed": seed}
    return fit_assign(df, text_column, (), subsampling_rate=subsampling_rate, **options)[0]


def fit_assign(
    df: DataFrame,
    text_column: str = "text_cleaned",
    keep: Sequence[str] | None = None,
    k: int = NUM_TOPICS,
    max_iter: int = 20,
    seed: int = RANDOM_SEED,
    subsampling_rate: float = 1.0,
    **term_options,
) -> tuple[TopicModel, DataFrame]:
    """``fit_topics``, and the ``keep`` columns (all) of ``df`` with ``topic_weights`` and ``topic``.

    Texts are read once. Their vectors are stored: every iteration reads them, topics are found for
    them, and a block lost from memory is read again rather than counted again.
    """
    options = {**COUNTS, **term_options}
    terms, vectors = fit_transform(df, text_column, "_features", keep=keep, **options)
    lda = LDA(
        k=k,
        seed=seed,
        maxIter=max_iter,
        subsamplingRate=subsampling_rate,
        learningOffset=LEARNING_OFFSET,
        learningDecay=LEARNING_DECAY,
        featuresCol="_features",
        topicDistributionCol="topic_weights",
    )
    vectors = store(vectors, "vectors")
    learned = vectors.select("_features").persist()
    try:
        model = TopicModel(terms, lda.fit(learned))
    finally:
        learned.unpersist()
    return model, model.assign(vectors)


def topic_weights(model: TopicModel) -> DataFrame:
    """``(topic, term, weight)`` of every term of the vocabulary; a topic's weights add up to 1."""
    table = model.lda.topicsMatrix().toArray()
    table = table / table.sum(axis=0)
    rows = [
        (int(topic), term, float(table[i, topic]))
        for i, term in enumerate(model.terms.vocabulary)
        for topic in range(table.shape[1])
    ]
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "topic int, term string, weight double")


def class_weights(
    counted: DataFrame, class_column: str, vocabulary: Sequence[str], smoothing: float = 0.01
) -> DataFrame:
    """``(topic, class, term, weight)``: a topic for each class of posts, with the shares that the
    terms of the vocabulary have of its words. Topics are numbered by class; null classes have none."""
    classed = counted.where(F.col(class_column).isNotNull())
    seen = classed.select(F.col(class_column).cast("string").alias("class"), F.inline(TERMS))
    listed = name_table(counted.sparkSession, vocabulary, "term").select("term")
    seen = seen.join(F.broadcast(listed), "term", "left_semi")
    # One row a class and a term: bounded by classes and vocabulary, not by the posts.
    totals = store(seen.groupBy("class", "term").agg(F.sum("n").alias("n")), "class_terms")
    sizes = totals.groupBy("class").agg(F.sum("n").alias("words"))
    codes = label_codes(totals, "class").withColumnsRenamed({"value": "class", "code": "topic"})
    every = sizes.join(codes, "class").select("*", F.explode(F.lit(list(vocabulary))).alias("term"))
    share = (F.coalesce("n", F.lit(0)) + smoothing) / (F.col("words") + smoothing * len(vocabulary))
    return every.join(totals, ["class", "term"], "left").select(
        F.col("topic").cast("int").alias("topic"), "class", "term", share.alias("weight")
    )


def fold_in(
    counted: DataFrame, weights: DataFrame, iterations: int = 10, output: str = "topic_weights"
) -> DataFrame:
    """The columns of ``counted``, and of each post its shares of the topics (``output``), its words
    that the topics know (``words``) and their log-likelihood under these shares.

    Shares start equal and are improved ``iterations`` times by expectation and maximisation, with
    the topics fixed. A post without a known word keeps equal shares. ``weights`` has one row for
    each topic and term and is sent to every task: the vocabulary bounds it.
    """
    rows = weights.select("topic", "term", "weight").collect()
    k = 1 + max((r["topic"] for r in rows), default=0)
    vocabulary = sorted({r["term"] for r in rows})
    place = {t: i for i, t in enumerate(vocabulary)}
    table = np.zeros((len(vocabulary), k))
    for r in rows:
        table[place[r["term"]], r["topic"]] = r["weight"]
    others = [c for c in counted.columns if c != TERMS]
    schema = T.StructType(
        [
            *(counted.schema[c] for c in others),
            T.StructField(output, T.ArrayType(T.DoubleType())),
            T.StructField("words", T.LongType()),
            T.StructField("log_likelihood", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.string())
        for batch in small_parts(batches):
            lists = batch.column(batch.num_columns - 1)
            entries, n = lists.flatten(), len(lists)
            row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            index = pc.fill_null(pc.index_in(entries.field("term"), known), -1).to_numpy()
            kept = index >= 0
            row, index = row[kept], index[kept]
            times = entries.field("n").to_numpy()[kept].astype(float)
            words = np.bincount(row, times, minlength=n)
            shares, given = np.full((n, k), 1 / k), table[index]
            for _ in range(iterations):
                joint = given * shares[row]
                joint *= (times / joint.sum(axis=1))[:, None]
                found = [np.bincount(row, joint[:, t], minlength=n) for t in range(k)]
                some = words > 0
                shares[some] = (np.array(found).T[some].T / words[some]).T
            likelihood = np.bincount(
                row, times * np.log((given * shares[row]).sum(axis=1)), minlength=n
            )
            offsets = pa.array(np.arange(n + 1) * k, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.ListArray.from_arrays(offsets, pa.array(shares.ravel())),
                    pa.array(words.astype(np.int64)),
                    pa.array(likelihood.astype(float)),  # of no entries at all, it is of integers
                ],
                names=schema.names,
            )

    return counted.select(*others, TERMS).mapInArrow(run, schema)


def perplexity(folded: DataFrame) -> DataFrame:
    """One row: posts, words and perplexity of ``folded`` posts, null when they have no word."""
    words = F.sum("words")
    return folded.agg(
        F.count("*").alias("posts"),
        F.coalesce(words, F.lit(0).cast("bigint")).alias("words"),
        F.when(words > 0, F.exp(-F.sum("log_likelihood") / words)).alias("perplexity"),
    )


def match_topics(found: DataFrame, wanted: DataFrame) -> list[tuple[int, int, float]]:
    """``(topic, wanted topic, cosine)``: pairs of most alike topics of two weight tables, the best
    pair first, each topic in one pair. The tables are joined by term; topics are few."""
    square = lambda df: df.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("length"))
    dot = (
        found.select(F.col("topic").alias("a"), "term", F.col("weight").alias("u"))
        .join(wanted.select(F.col("topic").alias("b"), "term", F.col("weight").alias("v")), "term")
        .groupBy("a", "b")
        .agg(F.sum(F.col("u") * F.col("v")).alias("dot"))
    )
    lengths = [{r["topic"]: r["length"] for r in square(df).collect()} for df in (found, wanted)]
    pairs = sorted(
        ((r["dot"] / (lengths[0][r["a"]] * lengths[1][r["b"]]), r["a"], r["b"]) for r in dot.collect()),
        reverse=True,
    )
    out: list[tuple[int, int, float]] = []
    for cosine, a, b in pairs:
        if all(a != x and b != y for x, y, _ in out):
            out.append((a, b, cosine))
    return out


def topic_distribution(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("topic").agg(F.count("*").alias("count"))


def principal_axes(df: DataFrame, column: str, size: int, axes: int = 2) -> np.ndarray:
    """The first ``axes`` directions of most variance of an array column, as columns.

    The moments are sums of one aggregation; only they reach the driver. Each axis has its largest
    component (the first, if several are) above zero, so the same posts give the same axes.
    """
    at = [F.get(F.col(column), F.lit(i)) for i in range(size)]
    means = [F.avg(x) for x in at]
    covariances = [F.covar_pop(at[i], at[j]) for i in range(size) for j in range(i + 1)]
    row = df.agg(*means, *covariances).first()
    matrix, k = np.zeros((size, size)), size
    for i in range(size):
        for j in range(i + 1):
            matrix[i, j] = matrix[j, i] = row[k] or 0.0
            k += 1
    values, vectors = np.linalg.eigh(matrix)
    vectors = vectors[:, np.argsort(-values, kind="stable")[:axes]]
    largest = np.argmax(np.round(np.abs(vectors), 9), axis=0)
    return vectors * np.where(vectors[largest, range(vectors.shape[1])] < 0, -1, 1)


def topic_points(
    assigned: DataFrame, column: str = "topic_weights", size: int = NUM_TOPICS
) -> DataFrame:
    """Add ``x`` and ``y``: the weights of an array column along its two principal axes."""
    axes = principal_axes(assigned, column, size)
    along = lambda axis: sum(
        (F.get(F.col(column), F.lit(i)) * float(w) for i, w in enumerate(axis)), F.lit(0.0)
    )
    second = along(axes[:, 1]) if axes.shape[1] > 1 else F.lit(0.0)
    return assigned.withColumns({"x": along(axes[:, 0]), "y": second})


def _distance(x: float, y: float) -> Column:
    return (F.col("x") - x) ** 2 + (F.col("y") - y) ** 2


def farthest_points(points: DataFrame, k: int) -> list[tuple[float, float]]:
    """Up to ``k`` different points: the one farthest from the mean, then each time the one farthest
    from those chosen. Among equally far ones, the least ``x`` and ``y``."""
    mean = points.agg(F.avg("x"), F.avg("y")).first()
    if mean[0] is None:
        return []
    chosen: list[tuple[float, float]] = []
    near = _distance(*mean)
    while len(chosen) < k:
        far = points.agg(F.max(F.struct(near, -F.col("x"), -F.col("y")))).first()[0]
        if chosen and far[0] == 0:
            break
        chosen.append((-far[1], -far[2]))
        near = reduce(F.least, (_distance(*c) for c in chosen)) if len(chosen) > 1 else _distance(*chosen[0])
    return chosen


def nearest_centre(centres: list[tuple[float, float]]) -> Column:
    """Number of the nearest of the centres, the first of equally near ones."""
    ranked = [F.struct(_distance(*c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]
    return F.least(*ranked)["i"] if len(ranked) > 1 else F.lit(0)


def cluster_points(
    points: DataFrame, k: int = NUM_TOPICS, max_iter: int = 50
) -> tuple[DataFrame, list[tuple[float, float]]]:
    """``points`` with the ``cluster`` of each, and the centres.

    Lloyd's steps from ``farthest_points``: each is one aggregation by cluster, until the centres
    stay, at most ``max_iter`` times. Store the points first; every step reads them.
    """
    centres = farthest_points(points, k)
    if not centres:
        return points.withColumn("cluster", F.lit(None).cast("int")), []
    for _ in range(max_iter):
        found = points.groupBy(nearest_centre(centres).alias("c")).agg(
            F.avg("x").alias("x"), F.avg("y").alias("y")
        )
        means = {r["c"]: (r["x"], r["y"]) for r in found.collect()}
        moved = [means.get(i, c) for i, c in enumerate(centres)]
        if np.allclose(moved, centres, rtol=0, atol=1e-12):
            break
        centres = moved
    return points.withColumn("cluster", nearest_centre(centres)), centres


def topic_clusters(assigned: DataFrame, k: int = NUM_TOPICS) -> DataFrame:
    """Two coordinates per post along the principal axes of its topic weights (a vector column), and
    a k-means cluster of those. The posts are stored, for every step reads them."""
    stored = store(assigned.withColumn("_weights", vector_to_array("topic_weights")), "weights")
    size = stored.agg(F.max(F.size("_weights"))).first()[0] or 0
    if not size:
        none = F.lit(None).cast("double")
        return assigned.withColumns({"x": none, "y": none, "cluster": F.lit(None).cast("int")})
    points = topic_points(stored, "_weights", size).drop("_weights")
    return cluster_points(points, k)[0]
