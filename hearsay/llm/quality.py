"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1; the unlabelled web text is rows without a label. The share
of positives among the unlabelled is estimated from the data, and a small neural network minimises
the non-negative unbiased risk (Kiryo et al., 2017) with the logistic loss, whose minimiser is the
probability of being positive. Labels of 0 are never used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.operators.scratch import store

from .common import utf8, worker_cache

#: Rows of each kind that the classifier is fitted on, the first by hash of their key and text.
MAX_FIT_ROWS = 20_000
CUTOFF = 0.7
HIDDEN = 24

# Classes of code points, see _classes.
LOWER, UPPER, OTHER_LETTER, DIGIT, BLANK, BREAK, POINT, SYMBOL = range(8)
FEATURES = (
    "log_chars log_words word_length word_spread long_words upper other_letter digit blank breaks "
    "point symbol symbol_pairs shouted_words symbol_words bare_words distinct_words repeated_pairs "
    "distinct_lines log_line top_word log_top_word_count empty"
).split()


def _classes() -> np.ndarray:
    """The class of each code point of the basic plane; later ones count as symbols."""
    table = np.full(1 << 16, SYMBOL, dtype=np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c.islower():
            table[i] = LOWER
        elif c.isupper():
            table[i] = UPPER
        elif c.isalpha():
            table[i] = OTHER_LETTER
        elif c.isdigit():
            table[i] = DIGIT
        elif c == "\n":
            table[i] = BREAK
        elif c.isspace():
            table[i] = BLANK
        elif c in ".,;:?'\"()-":
            table[i] = POINT
    return table


def describe(text: bytes, classes: np.ndarray) -> np.ndarray:
    """The features of one text; an empty text has a mark of its own and zeros."""
    values = np.zeros(len(FEATURES))
    string = text.decode("utf-8", "replace")
    words = string.split()
    if not words:
        values[-1] = 1.0
        return values
    codes = np.frombuffer(string.encode("utf-32-le"), dtype="<u4")
    kinds = classes[np.minimum(codes, 0xFFFF)]
    kinds[codes > 0xFFFF] = SYMBOL
    shares = np.bincount(kinds, minlength=8) / len(kinds)
    visible = max(1e-9, 1 - shares[BLANK] - shares[BREAK])
    inked = (kinds != BLANK) & (kinds != BREAK)
    starts = np.flatnonzero(inked & ~np.concatenate(([False], inked[:-1])))
    ends = np.flatnonzero(inked & ~np.concatenate((inked[1:], [False]))) + 1
    lengths = ends - starts
    n = len(starts)

    def inside(kind: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.append(kind, False).astype(np.int32), starts)

    letters = inside(kinds <= OTHER_LETTER)
    capitals = inside(kinds == UPPER)
    symbols = kinds == SYMBOL
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in string.split("\n") if x.strip()]
    top = max(counts.values())
    values[:] = (
        np.log1p(len(codes)),
        np.log1p(n),
        lengths.mean(),
        lengths.std(),
        (lengths > 20).mean(),
        shares[UPPER] / visible,
        shares[OTHER_LETTER] / visible,
        shares[DIGIT] / visible,
        shares[BLANK],
        shares[BREAK],
        shares[POINT] / visible,
        shares[SYMBOL] / visible,
        (symbols[1:] & symbols[:-1]).sum() / len(kinds) / visible,
        ((capitals == letters) & (letters > 1)).mean(),
        (inside(symbols) > 0).mean(),
        (letters == 0).mean(),
        len(counts) / len(words),
        1 - pairs / max(1, len(words) - 1),
        len(set(lines)) / len(lines),
        np.log1p(len(codes) / len(lines)),
        top / len(words),
        np.log1p(top),
        0.0,
    )
    return values


def described(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """The ``keep`` columns and ``features`` of every row; whole texts, no shuffle."""
    schema = T.StructType(
        [docs.schema[c] for c in keep] + [T.StructField("features", T.ArrayType(T.DoubleType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = worker_cache("classes", _classes)
        for batch in batches:
            rows = [describe(x.as_py(), classes) for x in batch.column(batch.num_columns - 1)]
            features = pa.array(rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], features], names=schema.names
            )

    return docs.select(*keep, utf8(text).alias("_llm_text")).mapInArrow(run, schema)


class Network:
    """One hidden layer; trained by Adam on a gradient of the scores."""

    def __init__(self, inputs: int, rng: np.random.Generator, hidden: int = HIDDEN) -> None:
        self.weights = [
            rng.standard_normal((inputs, hidden)) / np.sqrt(inputs),
            np.zeros(hidden),
            rng.standard_normal(hidden) / np.sqrt(hidden),
            np.zeros(1),
        ]
        self.moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        self.steps = 0

    def scores(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(x @ a + b) @ c + d[0]

    def step(self, x: np.ndarray, gradient: np.ndarray, rate: float, decay: float) -> None:
        a, b, c, _ = self.weights
        hidden = np.tanh(x @ a + b)
        back = gradient[:, None] * c * (1 - hidden**2)
        gradients = [x.T @ back, back.sum(0), hidden.T @ gradient, gradient.sum(keepdims=True)]
        self.steps += 1
        for w, g, (m, v) in zip(self.weights, gradients, self.moments):
            g = g + decay * w
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            scale = np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
            w -= rate * scale * m / (np.sqrt(v) + 1e-8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _batches(rng: np.random.Generator, p: int, u: int, size: int, epochs: int):
    for _ in range(epochs):
        a, b = rng.permutation(p), rng.permutation(u)
        parts = max(1, max(p, u) // size)
        for i in range(parts):
            # The smaller side is gone through again, so both are seen whole.
            yield (
                np.take(a, range(i * p // parts, max(i * p // parts + 1, (i + 1) * p // parts)),
                        mode="wrap"),
                np.take(b, range(i * u // parts, max(i * u // parts + 1, (i + 1) * u // parts)),
                        mode="wrap"),
            )


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int) -> float:
    """Share of positives among the unlabelled, by the best bin: a classifier of positive against
    unlabelled is fitted on one half; on the other, the ratio of the two rates above any threshold
    is at least the share, and nearly equal to it at the purest one. An allowance for the sampling
    error keeps small bins from deciding."""
    rng = np.random.default_rng(seed)
    fit_p, fit_u = positive[::2], unlabelled[::2]
    net = Network(positive.shape[1], rng)
    for i, j in _batches(rng, len(fit_p), len(fit_u), 256, 12):
        x = np.concatenate((fit_p[i], fit_u[j]))
        s = net.scores(x)
        y = np.concatenate((np.ones(len(i)), np.zeros(len(j))))
        weight = np.concatenate((np.full(len(i), 0.5 / len(i)), np.full(len(j), 0.5 / len(j))))
        net.step(x, weight * (_sigmoid(s) - y), 0.005, 1e-4)
    held_p, held_u = np.sort(net.scores(positive[1::2])), np.sort(net.scores(unlabelled[1::2]))
    at = np.quantile(held_p, np.linspace(0, 0.95, 96))
    rate_p = 1 - np.searchsorted(held_p, at) / len(held_p)
    rate_u = 1 - np.searchsorted(held_u, at) / len(held_u)
    slack = np.sqrt(np.log(200) / 2) * (1 / np.sqrt(len(held_p)) + 1 / np.sqrt(len(held_u)))
    best = np.argmin((rate_u + slack) / rate_p)
    return float(np.clip(rate_u[best] / rate_p[best], 0.02, 0.98))


class QualityModel:
    def __init__(self, centre, scale, weights, prior) -> None:
        self.centre, self.scale, self.weights, self.prior = centre, scale, weights, prior

    def probability(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), 0.5)
        a, b, c, d = self.weights
        x = np.clip((features - self.centre) / self.scale, -8, 8)
        return _sigmoid(np.tanh(x @ a + b) @ c + d[0])


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 42) -> QualityModel:
    """Non-negative risk: prior * l(f(p)) + max(0, l(-f(u)) - prior * l(-f(p))). Where the second
    part goes below 0 on a batch, its gradient is reversed, which undoes the overfitting.

    With fewer than 20 rows of either kind nothing is learned and every probability is 0.5.
    """
    if min(len(positive), len(unlabelled)) < 20:
        return QualityModel(None, None, None, 0.5)
    both = np.concatenate((positive, unlabelled))
    centre, scale = both.mean(0), both.std(0) + 1e-6
    p = np.clip((positive - centre) / scale, -8, 8)
    u = np.clip((unlabelled - centre) / scale, -8, 8)
    prior = estimate_prior(p, u, seed)
    rng = np.random.default_rng(seed)
    net = Network(p.shape[1], rng)
    for i, j in _batches(rng, len(p), len(u), 512, 60):
        sp, su = net.scores(p[i]), net.scores(u[j])
        negative = _softplus(su).mean() - prior * _softplus(sp).mean()
        grad_up = _sigmoid(su) / len(j)
        grad_down = -prior * _sigmoid(sp) / len(i)
        grad_pos = -prior * _sigmoid(-sp) / len(i)
        if negative >= 0:
            gradient = np.concatenate((grad_pos + grad_down, grad_up))
        else:
            gradient = np.concatenate((-grad_down, -grad_up))
        net.step(np.concatenate((p[i], u[j])), gradient, 0.003, 1e-4)
    return QualityModel(centre, scale, net.weights, prior)


def _sample(rows: DataFrame, order: Column, limit: int) -> np.ndarray:
    """At most ``limit`` feature rows, the first in ``order``; each task sends no more than that."""
    got = rows.select("features", order.alias("o")).orderBy("o").limit(limit).toArrow()
    if not got.num_rows:
        return np.zeros((0, len(FEATURES)))
    return np.array(got.column("features").to_pylist())


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    text: str = "text",
    key: str = "doc_id",
    label: str = "quality",
    keep: tuple[str, ...] = (),
    max_fit_rows: int = MAX_FIT_ROWS,
    cutoff: float = CUTOFF,
) -> DataFrame:
    """The key, the ``keep`` columns, ``score`` (probability of label 1) and ``predicted``.

    Scores come from the text alone. Learning takes rows where ``learn`` holds: those with a label 1
    as positives, those with a null label or none as unlabelled. Null and empty texts get the score
    of the empty text. A key with several labels counts as positive if any is 1.
    """
    table = store(
        described(docs.withColumn("_learn", learn), text, (key, *keep, "_learn")), "features"
    )
    marks = labels.groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_label"))
    rows = table.where("_learn").join(marks, F.col(key) == F.col("_key"), "left")
    order = F.xxhash64(key, "features")
    model = fit(
        _sample(rows.where("_label = 1"), order, max_fit_rows),
        _sample(rows.where("_label IS NULL"), order, max_fit_rows),
    )
    parts = (model.centre, model.scale, model.weights, model.prior)
    schema = T.StructType(
        [table.schema[c] for c in (key, *keep)]
        + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = QualityModel(*parts)
        for batch in batches:
            features = batch.column(batch.num_columns - 1).flatten().to_numpy(False)
            score = scorer.probability(features.reshape(batch.num_rows, -1))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(score),
                    pa.array((score >= cutoff).astype(np.int32)),
                ],
                names=schema.names,
            )

    return table.select(key, *keep, "features").mapInArrow(run, schema)
