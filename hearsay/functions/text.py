"""Text cleaners: each is a ``Column -> Column`` function, so a chain is one projection."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

Cleaner = Callable[[Column], Column]

# The short stop-word list.
BASIC_STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by",
)


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(c: Column | str, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``c`` once per row and hand it to ``fn``, which may use it many times.

    A lambda variable is never inlined, unlike a column alias that the optimizer may copy into
    every place it is used.
    """
    return F.get(F.transform(F.array(as_column(c)), fn), F.lit(0))


def once(fields: Column) -> Column:
    """The fields of a struct as columns for ``select``, computed once per row.

    They pass through a generator. A filter on them stays above it, where on a plain projection it
    would be pushed down and compute them again.
    """
    return F.inline(F.array(fields))


def words(c: Column | str) -> Column:
    """Whitespace-separated words; empty pieces left out."""
    return F.filter(F.split(as_column(c), P.SPACES), lambda w: w != "")


def strip(c: Column | str) -> Column:
    return F.btrim(as_column(c), F.lit(P.SPACE_CHARS))


def is_not_blank(c: Column | str) -> Column:
    """True when some character is not whitespace; null text counts as blank."""
    return F.coalesce(as_column(c).rlike(P.NON_SPACE), F.lit(False))


def remove_pattern(c: Column | str, pattern: str, replacement: str = " ") -> Column:
    return F.regexp_replace(as_column(c), F.lit(pattern), F.lit(replacement))


def remove_mentions(c: Column | str) -> Column:
    return remove_pattern(c, P.MENTION)


def remove_hashtags(c: Column | str) -> Column:
    return remove_pattern(c, P.HASHTAG)


def remove_urls(c: Column | str) -> Column:
    return remove_pattern(c, P.URL)


def remove_emails(c: Column | str) -> Column:
    return bind(
        c, lambda x: F.when(F.contains(x, F.lit("@")), remove_pattern(x, P.EMAIL)).otherwise(x)
    )


def remove_numbers(c: Column | str) -> Column:
    return remove_pattern(c, P.NUMBER)


def remove_emojis(c: Column | str, strict: bool = False) -> Column:
    """The default class is wide and also covers CJK, kana and Hangul; ``strict`` leaves those."""
    return remove_pattern(c, P.STRICT_EMOJI if strict else P.EMOJI)


def remove_punctuation(c: Column | str) -> Column:
    return remove_pattern(c, P.PUNCTUATION)


def normalize_whitespace(c: Column | str) -> Column:
    return F.trim(remove_pattern(c, P.SPACES))


def to_lowercase(c: Column | str) -> Column:
    return F.lower(as_column(c))


def remove_short_words(c: Column | str, min_length: int = 2) -> Column:
    shortest = max(min_length, 1)
    pieces = F.split(as_column(c), P.SPACES)
    return F.array_join(F.filter(pieces, lambda w: F.length(w) >= shortest), " ")


def remove_stopwords(c: Column | str, stopwords: Iterable[str] | None = None) -> Column:
    stop = sorted(set(BASIC_STOPWORDS if stopwords is None else stopwords))
    kept = F.filter(words(c), lambda w: ~F.lower(w).isin(stop))
    return F.array_join(kept, " ")


def compose(*cleaners: Cleaner) -> Cleaner:
    """Right to left: the last cleaner listed runs first."""
    return chain(*reversed(cleaners))


def chain(*cleaners: Cleaner) -> Cleaner:
    """Left to right: the first cleaner listed runs first."""

    def cleaner(c: Column | str) -> Column:
        return reduce(lambda acc, step: step(acc), cleaners, as_column(c))

    return cleaner


create_custom_cleaner = compose

_drop_one_letter = partial(remove_short_words, min_length=2)
_drop_two_letter = partial(remove_short_words, min_length=3)

# The steps of each ready-made chain, in the order they run.
CHAINS: dict[str, tuple[Cleaner, ...]] = {
    "basic": (remove_emails, remove_mentions, remove_urls, to_lowercase, normalize_whitespace),
    "moderate": (
        to_lowercase,
        remove_emails,
        remove_mentions,
        remove_urls,
        _drop_one_letter,
        normalize_whitespace,
    ),
    "aggressive": (
        to_lowercase,
        remove_emails,
        remove_mentions,
        remove_urls,
        remove_hashtags,
        remove_emojis,
        remove_numbers,
        remove_punctuation,
        remove_stopwords,
        _drop_two_letter,
        normalize_whitespace,
    ),
    "sentiment": (to_lowercase, remove_emails, remove_mentions, remove_urls, normalize_whitespace),
    "topic": (
        to_lowercase,
        remove_emails,
        remove_mentions,
        remove_urls,
        remove_numbers,
        remove_punctuation,
        remove_stopwords,
        _drop_two_letter,
        normalize_whitespace,
    ),
    "ner": (remove_emails, remove_urls, normalize_whitespace),
}

basic_clean = chain(*CHAINS["basic"])
moderate_clean = chain(*CHAINS["moderate"])
aggressive_clean = chain(*CHAINS["aggressive"])
sentiment_clean = chain(*CHAINS["sentiment"])
topic_clean = chain(*CHAINS["topic"])
ner_clean = chain(*CHAINS["ner"])


def python_cleaner(fn: Callable[[str], str]) -> Cleaner:
    """Wrap a plain ``str -> str`` callable; batches cross to Python as Arrow, nulls stay null.

    A few texts at a time are made Python strings, for those take up to four bytes a character.
    """
    # Set by hand: postponed annotations would hide the Arrow types from Spark.
    import pyarrow as pa

    def apply(batch):
        parts = [pa.array([], pa.string())]
        for start in range(0, len(batch), 64):
            texts = batch.slice(start, 64).to_pylist()
            parts.append(pa.array([None if t is None else fn(t) for t in texts], pa.string()))
        return pa.concat_arrays(parts)

    apply.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    wrapped = F.arrow_udf(apply, "string")

    def cleaner(c: Column | str) -> Column:
        return wrapped(as_column(c))

    return cleaner


def flatten_lists(c: Column | str) -> Column:
    return F.flatten(as_column(c))


def drop_nulls(c: Column | str) -> Column:
    return F.array_compact(as_column(c))
