"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to 3 characters of every learned text into buckets, by language; the
matrix of log-probabilities (languages x buckets) is broadcast, and texts are scored in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, utf8, worker_cache

BUCKET_BITS = 16
ORDERS = 3
SMOOTHING = 0.5
MAX_LANGUAGES = 512
CHUNK = 1 << 16
UNKNOWN = "und"
#: A text that fits its language by less than this share of what learned texts do is of none. Other
#: scripts and strings of keys are at -0.9 to 0.12 (sf0.01 and larger), the given documents at 0.57
#: and above.
LEAST_FIT = 0.25
LEAST_GAIN = 1e-9


def _letters() -> np.ndarray:
    """For each code point whether it is a letter (surrogates are not)."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def character_codes(text: bytes, letters: np.ndarray) -> tuple[np.ndarray, bool]:
    """Lower-cased code points with one blank for each run of other than letters and at both ends,
    and whether there is any letter."""
    lowered = text.decode("utf-8", "replace").lower()
    codes = np.frombuffer(lowered.encode("utf-32-le"), dtype="<u4")
    is_letter = letters[codes]
    codes = np.concatenate(([32], np.where(is_letter, codes, 32), [32])).astype(np.uint32)
    blank = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return codes[keep], bool(is_letter.any())


def buckets(codes: np.ndarray, bits: int = BUCKET_BITS) -> Iterator[np.ndarray]:
    """Hash buckets of all n-grams, in pieces of bounded size."""
    for start in range(0, len(codes), CHUNK):
        piece = codes[start : start + CHUNK + ORDERS - 1]
        whole = len(piece) <= CHUNK
        rolled = np.zeros(len(piece), dtype=np.uint32)
        for order in range(1, ORDERS + 1):
            if len(piece) < order:
                break
            rolled = (
                rolled[: len(piece) - order + 1] * np.uint32(0x01000193)
                + piece[order - 1 :]
                + np.uint32(order * 0x9E37)
            )
            # n-grams that start in the next piece are counted there.
            own = rolled if whole else rolled[:CHUNK]
            mixed = (own ^ (own >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            yield mixed >> np.uint32(32 - bits)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray
    log_likelihood: np.ndarray  # buckets x languages, float32: 256 kB a language
    typical: np.ndarray  # mean of an n-gram of each language over that of noise


def train(
    docs: DataFrame, text: str, lang: str, learn: Column, bits: int = BUCKET_BITS
) -> LanguageModel:
    """Count over all rows where ``learn`` holds and ``lang`` is not null.

    What reaches the driver is one count for each language and bucket; more than MAX_LANGUAGES
    distinct values (the bound that makes the matrix small enough to broadcast) is an error.
    """
    rows = docs.where(learn & F.col(lang).isNotNull())
    known = rows.groupBy(F.col(lang).alias("lang")).count().limit(MAX_LANGUAGES + 1).collect()
    if len(known) > MAX_LANGUAGES:
        raise ValueError(f"{lang} has more than {MAX_LANGUAGES} values")
    languages = sorted(r["lang"] for r in known)
    n_docs = np.array([{r["lang"]: r["count"] for r in known}[x] for x in languages], float)
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = worker_cache("letters", _letters)
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes, _ = character_codes(x.as_py(), letters)
                total = counts.setdefault(language, np.zeros(size, np.int64))
                for piece in buckets(codes, bits):
                    total += np.bincount(piece, minlength=size)
        for language, total in counts.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(at)), pa.array(at, pa.int32()), pa.array(total[at])],
                names=["lang", "bucket", "n"],
            )

    counted = (
        rows.select(lang, utf8(text).alias("_llm_text"))
        .mapInArrow(run, "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    table = np.zeros((size, len(languages)))
    index = {x: i for i, x in enumerate(languages)}
    column = np.array([index[x] for x in counted.column("lang").to_pylist()], dtype=int)
    table[counted.column("bucket").to_numpy(), column] = counted.column("n").to_numpy()
    likelihood = np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * size))
    prior = np.log(n_docs / n_docs.sum()) if len(n_docs) else n_docs
    typical = (table * likelihood).sum(axis=0) / table.sum(axis=0) + bits * np.log(2)
    return LanguageModel(languages, prior, likelihood.astype(np.float32), typical)


def predict(
    docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """The ``keep`` columns, ``lang_pred``, ``score`` (posterior of that language) and ``fit`` of
    each row.

    ``fit`` is the mean log-likelihood of the text's n-grams in that language, on a scale where all
    that was learned of the language has 1 and noise, with every bucket as likely as any other,
    has 0. It does not grow with the text.
    ``und`` with score 0 and fit null where the text is null or has no letter, or nothing was
    learned. Ties go to the language first by code point. Whole texts, no shuffle.
    """
    schema = T.StructType(
        [docs.schema[c] for c in keep]
        + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
        + [T.StructField("fit", T.DoubleType())]
    )
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.languages, model.log_prior, model.log_likelihood, model.typical)
    )
    bits = int(model.log_likelihood.shape[0]).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = worker_cache("letters", _letters)
        languages, prior, likelihood, typical = shared.value
        for batch in batches:
            names, scores, fits = [], [], []
            for x in batch.column(batch.num_columns - 1):
                codes, any_letter = character_codes(x.as_py(), letters)
                if not any_letter or not languages:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    fits.append(None)
                    continue
                total, n = prior.copy(), 0
                for piece in buckets(codes, bits):
                    total += likelihood[piece].sum(axis=0, dtype=np.float64)
                    n += len(piece)
                best = int(total.argmax())
                names.append(languages[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
                gain = (total[best] - prior[best]) / n + bits * np.log(2)
                fits.append(float(gain / max(typical[best], LEAST_GAIN)))
            judged = [pa.array(names, pa.string()), pa.array(scores), pa.array(fits, pa.float64())]
            columns = [*batch.columns[:-1], *judged]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*keep, utf8(text).alias("_llm_text")).mapInArrow(run, schema)


def keep_known(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
    least: float = 0.5, least_fit: float = LEAST_FIT,
) -> DataFrame:
    """``docs`` without texts that have no letter, no language with a posterior of ``least``, or
    no language that they fit by ``least_fit`` at least.

    The posterior is near 1 for almost any text of some length, so it rejects only very short ones;
    ``fit`` rejects other scripts and strings of keys, whatever their length. Learns as the query
    does, from folds of the key other than 2. If nothing can be learned, only texts without a
    letter go. Columns of any name stay as they are.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_llm_row"), F.col(text))
    model = train(docs, text, lang, fold(key, 4) != 2)
    if not model.languages:
        return docs.where(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    known = predict(rows, model, text, ("_llm_row",))
    return known.where(
        (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least) & (F.col("fit") >= least_fit)
    ).select("_llm_row.*")
