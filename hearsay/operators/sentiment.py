"""Scoring text: word lists, a caller's model, or a trained classifier."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark import Accumulator
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.scores import (
    default_scores,
    hit_scores,
    normalize_scores,
    sentiment_columns,
    truncate,
    unless_blank,
)
from ..functions.text import bind, is_not_blank, once
from ..schema import MODEL_OUTPUT
from .joins import check_inline, check_match, inline_rows, lookup_join
from .scratch import store
from .vectorize import TermModel, fit_transform

Lexicon = DataFrame | Iterable[tuple[str, object]]


def _rows(lexicon: Lexicon, names: Sequence[str]) -> list[tuple]:
    """The rows of a lexicon that is to be matched inline, lower-cased, without null words."""
    if isinstance(lexicon, DataFrame):
        rows = inline_rows(lexicon, names)
    else:
        rows = list(lexicon)
        check_inline(rows)
    return [(w.lower(), x) for w, x in rows if w is not None and x is not None]


def _as_table(df: DataFrame, lexicon: Lexicon, schema: str) -> DataFrame:
    table = lexicon
    if not isinstance(table, DataFrame):
        table = df.sparkSession.createDataFrame(list(table), schema)
    return table.withColumn("word", F.lower("word")).dropna()


def _scored_words(text_column: str, max_chars: int | None) -> Column:
    """Lower-cased runs of word characters, so punctuation beside a word does not hide it."""
    text = F.col(text_column) if max_chars is None else truncate(text_column, max_chars)
    return F.regexp_extract_all(F.lower(text), F.lit(P.WORD_RUN), F.lit(0))


def _known_words(tokens: Column, rows: list[tuple]) -> Column:
    """The few tokens that are in the word list at all; classes are counted among these."""
    return F.filter(tokens, lambda w: w.isin(sorted({w for w, _ in rows})))


def _hits(tokens: Column, vocabulary: Iterable[str]) -> Column:
    wanted = sorted(set(vocabulary))
    if not wanted:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(tokens, lambda w: w.isin(wanted))), F.lit(0))


def _numbered(df: DataFrame, **more: Column) -> DataFrame:
    """The rows stored with a number of their own, so that keys may repeat, be null or be absent."""
    return store(df.withColumns({"_row": F.monotonically_increasing_id(), **more}), "rows")


def _matched_words(df: DataFrame, tokens: Column, table: DataFrame) -> DataFrame:
    """``_row`` and the columns of the table for each word that it has. Words meet the table before
    they are counted, so the others are in no shuffle if the table is small."""
    words = df.select("_row", F.explode(tokens).alias("word"))
    return lookup_join(words, table, "word", ["_row"], "inner")


def score_sentiment(
    df: DataFrame,
    lexicon: Lexicon,
    text_column: str = "text_cleaned",
    max_chars: int | None = None,
    match: str = "inline",
) -> DataFrame:
    """Score by a word list ``(word, polarity)``: shares of positive and negative words.

    Whole texts are scored; ``max_chars`` sets the input limit of a fixed-length classifier. Case
    does not matter, null words are left out. ``match="inline"`` tests words inside each row, with
    no shuffle, for lists of up to MAX_INLINE_WORDS (more is an error); ``match="join"`` takes lists
    of any size: rows are stored with a number, words are joined, and only the sums of those
    found meet the rows again. Both give the same scores for any rows.
    """
    check_match(match)
    if text_column not in df.columns:
        return df
    tokens = _scored_words(text_column, max_chars)
    if match == "inline":
        rows = _rows(lexicon, ("word", "polarity"))
        positive, negative = [w for w, p in rows if p > 0], [w for w, p in rows if p < 0]
        scores = bind(
            _known_words(tokens, rows),
            lambda t: hit_scores(_hits(t, positive), _hits(t, negative)),
        )
        counted = df
    else:
        # Blank texts are marked here, so no text need meet the sums.
        numbered = _numbered(df, _blank=~is_not_blank(text_column))
        table = _as_table(df, lexicon, "word string, polarity int")
        table = table.groupBy("word").agg(
            F.count_if(F.col("polarity") > 0).cast("boolean").cast("int").alias("p"),
            F.count_if(F.col("polarity") < 0).cast("boolean").cast("int").alias("q"),
        )
        hits = _matched_words(numbered, tokens, table).groupBy("_row").agg(
            F.sum("p").alias("_positive"), F.sum("q").alias("_negative")
        )
        counted = numbered.join(hits, "_row", "left").fillna(0, ["_positive", "_negative"])
        found = hit_scores(F.col("_positive"), F.col("_negative"))
        scores = F.when(F.col("_blank"), default_scores()).otherwise(found)
        return counted.select(*df.columns, sentiment_columns(scores))
    return counted.select(*df.columns, sentiment_columns(unless_blank(text_column, scores)))


def score_emotion(
    df: DataFrame,
    lexicon: Lexicon,
    text_column: str = "text_cleaned",
    output: str = "emotion",
    default: str = "NEUTRAL",
    max_chars: int | None = None,
    match: str = "inline",
) -> DataFrame:
    """The emotion with most words in the text, ties by name; ``default`` when there is none.

    ``match`` as for ``score_sentiment``.
    """
    check_match(match)
    tokens = _scored_words(text_column, max_chars)
    if match == "inline":
        rows = _rows(lexicon, ("word", "emotion"))
        # Most hits first, then the name: the least of (-hits, name).
        classes = sorted({e for _, e in rows}) or [default]

        def ranked(t: Column) -> Column:
            return F.array(
                *[
                    F.struct(
                        (-_hits(t, (w for w, e in rows if e == name))).alias("rank"),
                        F.lit(name).alias("emotion"),
                    )
                    for name in classes
                ]
            )

        best, counted = F.array_min(bind(_known_words(tokens, rows), ranked)), df
    else:
        numbered = _numbered(df)
        table = _as_table(df, lexicon, "word string, emotion string").distinct()
        table = table.groupBy("word").agg(F.collect_list("emotion").alias("emotions"))
        matched = _matched_words(numbered, tokens, table)
        per_class = matched.select("_row", F.explode("emotions").alias("emotion"))
        per_class = per_class.groupBy("_row", "emotion").agg((-F.count("*")).alias("rank"))
        top = per_class.groupBy("_row").agg(F.min(F.struct("rank", "emotion")).alias("_best"))
        best, counted = F.col("_best"), numbered.join(top, "_row", "left")
    label = bind(best, lambda b: F.when(b["rank"] < 0, b["emotion"]).otherwise(F.lit(default)))
    return counted.select(*df.columns, once(F.struct(label.alias(output))).alias(output))


Model = Callable[[list[str]], list[list[dict]]]


def score_with_model(
    df: DataFrame,
    model_factory: Callable[[], Model],
    text_column: str = "text_cleaned",
    batch_size: int = 32,
    max_chars: int | None = None,
    adapt: Callable[[Column], Column] = lambda items: items,
    failures: Accumulator | None = None,
) -> DataFrame:
    """Score with any model that maps texts to lists of ``{label, score}``, one for each text.

    ``model_factory`` runs once per Python worker. Whole texts are scored unless ``max_chars`` is
    given. ``adapt`` may rewrite the raw output, as ``star_scores`` does for five-star labels. A text
    on which the model fails gets the default scores and adds 1 to ``failures``; a model that
    returns another number of results than it got texts is an error.
    """
    if text_column not in df.columns:
        return df
    model_id = uuid.uuid4().hex

    # Everything a worker needs is nested here, so the function travels without the package.
    def loaded() -> Model:
        import sys
        import types

        kept = sys.modules.setdefault("_hearsay_models", types.ModuleType("_hearsay_models"))
        if model_id not in kept.__dict__:
            setattr(kept, model_id, model_factory())
        return getattr(kept, model_id)

    def score_batch(model: Model, texts: list[str]) -> list[list[dict] | None]:
        """A batch that fails is retried text by text; a text that fails has no score."""
        try:
            results = list(model(texts))
        except Exception:
            if len(texts) > 1:
                return [score_batch(model, [t])[0] for t in texts]
            if failures is not None:
                failures.add(1)
            return [None]
        if len(results) != len(texts):
            raise ValueError(f"the model gave {len(results)} results for {len(texts)} texts")
        return results

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded()
        for texts in batches:
            found = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            filled = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            for at in range(0, len(filled), batch_size):
                chosen = filled[at : at + batch_size]
                results = score_batch(model, [texts.iloc[i] for i in chosen])
                for i, result in zip(chosen, results):
                    found.iat[i] = result
            yield found

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    model_scores = F.pandas_udf(score, MODEL_OUTPUT)
    text = F.col(text_column) if max_chars is None else truncate(text_column, max_chars)
    raw = df.withColumn("_raw", model_scores(text))
    scores = F.coalesce(normalize_scores(adapt(F.col("_raw"))), default_scores())
    return raw.select(*df.columns, sentiment_columns(unless_blank(text_column, scores)))


class TrainedScorer:
    """TF-IDF terms and logistic regression fitted on 0/1 labels."""

    def __init__(self, terms: TermModel, classifier: LogisticRegressionModel):
        self.terms = terms
        self.classifier = classifier

    def transform(self, df: DataFrame, text_column: str = "text_cleaned") -> DataFrame:
        vectors = self.terms.transform(df, text_column, "_features")
        predicted = PipelineModel([self.classifier]).transform(vectors)
        share = vector_to_array("_probability")
        items = F.array(
            F.struct(F.lit("NEGATIVE").alias("label"), share[0].alias("score")),
            F.struct(F.lit("POSITIVE").alias("label"), share[1].alias("score")),
        )
        scores = unless_blank(text_column, normalize_scores(items))
        return predicted.select(*df.columns, sentiment_columns(scores))


def train_scorer(
    df: DataFrame,
    label_column: str,
    text_column: str = "text_cleaned",
    max_iter: int = 20,
    reg_param: float = 0.01,
    **term_options,
) -> TrainedScorer:
    labelled = df.where(F.col(label_column).isNotNull())
    model, vectors = fit_transform(
        labelled, text_column, "_features", keep=[label_column], **term_options
    )
    classifier = LogisticRegression(
        featuresCol="_features",
        labelCol=label_column,
        probabilityCol="_probability",
        rawPredictionCol="_raw_prediction",
        predictionCol="_prediction",
        maxIter=max_iter,
        regParam=reg_param,
    ).fit(vectors)
    return TrainedScorer(model, classifier)
