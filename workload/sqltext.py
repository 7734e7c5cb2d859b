"""SQL twins of the text functions, for an engine with RE2 regexes and list lambdas."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from hearsay.functions.patterns import SPACE_CHARS
from hearsay.functions.text import BASIC_STOPWORDS

# RE2 has neither the White_Space property nor look-behind nor possessive repeats, so the checking
# engine gets plain patterns. They are fixed values, like EMOJI and CHAINS below.
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORD = r"\p{L}\p{N}_"
SPACES = f"[{SPACE}]+"
NON_SPACE = f"[^{SPACE}]"
EMAIL = f"{NON_SPACE}+@{NON_SPACE}+"
MENTION = f"@[{WORD}]+"
HASHTAG = f"#[{WORD}]+"
TAG_WORD = f"#([{WORD}]+)"
NUMBER = r"\p{Nd}+"
PUNCTUATION = f"[^{WORD}{SPACE}]"
# In the URL class the range from the dollar sign to the underscore holds all but a-z and "!".
URL = r"https?://[a-z!$-_]+"
# Decimal digits, and the superscripts; the given tables hold no other kind.
DIGIT = r"[\p{Nd}\x{b2}\x{b3}\x{b9}]"
EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
    r"\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
)
TOKEN = f"[{WORD}]{{2,}}"
SPECIAL = rf"[^\p{{L}}\p{{N}}{SPACE}]"
NAME_RUN = r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def string_list(items: Iterable[str]) -> str:
    return "[" + ", ".join(quote(i) for i in items) + "]"


def replaced(x: str, pattern: str, by: str = " ") -> str:
    return f"regexp_replace({x}, {quote(pattern)}, {quote(by)}, 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {quote(SPACES)}), lambda w: w <> '')"


def tokens(x: str) -> str:
    """Runs of word characters."""
    return f"regexp_extract_all({x}, '[{WORD}]+')"


def is_not_blank(x: str) -> str:
    return f"regexp_matches({x}, {quote(NON_SPACE)})"


def emails(x: str) -> str:
    return replaced(x, EMAIL)


def mentions(x: str) -> str:
    return replaced(x, MENTION)


def urls(x: str) -> str:
    return replaced(x, URL)


def hashtags(x: str) -> str:
    return replaced(x, HASHTAG)


def emojis(x: str) -> str:
    return replaced(x, EMOJI)


def numbers(x: str) -> str:
    return replaced(x, NUMBER)


def punctuation(x: str) -> str:
    return replaced(x, PUNCTUATION)


def lower(x: str) -> str:
    return f"lower({x})"


def whitespace(x: str) -> str:
    return f"trim({replaced(x, SPACES)}, ' ')"


def short(n: int) -> Callable[[str], str]:
    def step(x: str) -> str:
        return f"array_to_string(list_filter({words(x)}, lambda w: length(w) >= {n}), ' ')"

    return step


def stopwords(x: str) -> str:
    stop = string_list(BASIC_STOPWORDS)
    kept = f"list_filter({words(x)}, lambda w: NOT list_contains({stop}, lower(w)))"
    return f"array_to_string({kept}, ' ')"


CHAINS: dict[str, tuple[Callable[[str], str], ...]] = {
    "basic": (emails, mentions, urls, lower, whitespace),
    "moderate": (lower, emails, mentions, urls, short(2), whitespace),
    "aggressive": (
        lower, emails, mentions, urls, hashtags, emojis, numbers, punctuation, stopwords, short(3),
        whitespace,
    ),
    "sentiment": (lower, emails, mentions, urls, whitespace),
    "topic": (lower, emails, mentions, urls, numbers, punctuation, stopwords, short(3), whitespace),
    "ner": (emails, urls, whitespace),
}


def clean(x: str, chain: str) -> str:
    for step in CHAINS[chain]:
        x = step(x)
    return x


def hits(tokens: str, vocabulary: Iterable[str]) -> str:
    return f"len(list_filter({tokens}, lambda w: list_contains({string_list(vocabulary)}, w)))"


def scored(source: str, lexicon, text: str = "text", max_chars: int | None = None) -> str:
    """WITH items ending in ``scored``: ``source`` plus the five sentiment columns."""
    used = text if max_chars is None else f"left({text}, {max_chars})"
    tokens = f"regexp_extract_all(lower({used}), '[{WORD}]+')"
    positive = hits("tokens", sorted({w for w, p in lexicon if p > 0}))
    negative = hits("tokens", sorted({w for w, p in lexicon if p < 0}))
    return f"""tokenized AS (SELECT *, {tokens} AS tokens FROM {source}),
counted AS (SELECT * EXCLUDE (tokens), {positive} AS p, {negative} AS n FROM tokenized),
scored AS (SELECT * EXCLUDE (p, n),
  CASE WHEN p + n = 0 THEN 'NEUTRAL' WHEN p > n THEN 'POSITIVE' ELSE 'NEGATIVE' END AS sentiment_label,
  CASE WHEN p + n = 0 THEN 0.0::DOUBLE ELSE greatest(p, n)::DOUBLE / (p + n) END AS sentiment_score,
  CASE WHEN p + n = 0 THEN 0.33::DOUBLE ELSE p::DOUBLE / (p + n) END AS sentiment_positive,
  CASE WHEN p + n = 0 THEN 0.33::DOUBLE ELSE n::DOUBLE / (p + n) END AS sentiment_negative,
  CASE WHEN p + n = 0 THEN 0.34::DOUBLE ELSE 0.0::DOUBLE END AS sentiment_neutral
  FROM counted)"""


def text_statistics(x: str) -> dict[str, str]:
    def count(pattern: str) -> str:
        return f"len(regexp_extract_all({x}, {quote(pattern)}))"

    letters = f"list_sum(list_transform({words(x)}, lambda w: length(w)))"
    sentences = f"list_filter(string_split({x}, '.'), lambda s: {is_not_blank('s')})"
    return {
        "text_char_count": f"length({x})",
        "text_word_count": f"len({words(x)})",
        "text_sentence_count": f"len({sentences})",
        "text_avg_word_length": f"coalesce({letters}::DOUBLE / nullif(len({words(x)}), 0), 0)",
        "text_exclamation_count": f"length({x}) - length(replace({x}, '!', ''))",
        "text_question_count": f"length({x}) - length(replace({x}, '?', ''))",
        "text_uppercase_ratio": rf"coalesce({count(r'\p{Lu}')}::DOUBLE / nullif(length({x}), 0), 0)",
        "text_digit_count": count(DIGIT),
        "text_special_char_count": count(SPECIAL),
    }


TIME_FEATURES = {
    "year": "year(date)",
    "month": "month(date)",
    "day": "day(date)",
    "hour": "hour(date)",
    "day_of_week": "isodow(date) - 1",
    "is_weekend": "CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END",
    "quarter": "quarter(date)",
}


def term_weights(
    source: str,
    text: str = "text",
    ngrams: tuple[int, int] = (1, 2),
    max_features: int | None = 1000,
    min_df: int = 2,
    max_df: float = 0.8,
    stop: Iterable[str] = BASIC_STOPWORDS,
    tfidf: bool = True,
) -> str:
    """WITH items ending in ``weights(post_id, term, value)``."""
    tokens = (
        f"list_filter(regexp_extract_all(lower({text}), {quote(TOKEN)}), "
        f"lambda t: NOT list_contains({string_list(sorted(stop))}, t))"
    )
    grams = " UNION ALL ".join(
        "SELECT post_id, unnest(list_transform(range(1, len(toks) - {k} + 1), "
        "lambda i: array_to_string(toks[i : i + {k} - 1], ' '))) AS term FROM toks".format(k=k)
        for k in range(ngrams[0], ngrams[1] + 1)
    ).replace("range(1, len(toks) - ", "range(1, 1 + len(toks) - ")
    most = f"ORDER BY total DESC, term LIMIT {max_features}" if max_features else ""
    value = "w / sqrt(sum(w * w) OVER (PARTITION BY post_id))" if tfidf else "w"
    weight = "tf * (ln((1 + n)::DOUBLE / (1 + docs)) + 1)" if tfidf else "tf::DOUBLE"
    return f"""toks AS (SELECT post_id, {tokens} AS toks FROM {source}),
grams AS ({grams}),
tf AS (SELECT post_id, term, count(*) AS tf FROM grams GROUP BY ALL),
size AS (SELECT count(*) AS n FROM {source}),
vocab AS (SELECT term, count(*) AS docs, sum(tf) AS total FROM tf GROUP BY term
  HAVING count(*) >= {min_df} AND count(*) <= {max_df} * (SELECT n FROM size)
  {most}),
raw AS (SELECT post_id, term, {weight} AS w FROM tf JOIN vocab USING (term), size),
weights AS (SELECT post_id, term, {value} AS value FROM raw)"""
