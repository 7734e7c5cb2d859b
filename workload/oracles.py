"""SQL twin of each query that SQL can express."""

from __future__ import annotations

from hearsay.functions.patterns import SPACE_CHARS
from hearsay.functions.text import BASIC_STOPWORDS
from hearsay.schema import POST

from . import sqltext as Q
from . import views as V

ORACLES: dict[str, str] = {}
TAG_LIST = "('src0', 'src1', 'src2', 'src3')"
FLAT = ", ".join(f'"{c}"' for c in POST.fieldNames())
SENTIMENT = (
    "sentiment_label, round(sentiment_score, 6) AS sentiment_score, "
    "round(sentiment_positive, 6) AS sentiment_positive, "
    "round(sentiment_negative, 6) AS sentiment_negative, "
    "round(sentiment_neutral, 6) AS sentiment_neutral"
)


def register(name: str, select: str, *items: str) -> None:
    """``items`` are WITH items; every query may read ``posts``."""
    ORACLES[name] = f"WITH {', '.join([V.POSTS, *items])}\n{select}"


# Sources and sinks ---------------------------------------------------------------------------

FLAT_NOISY = """flat AS (
  SELECT post_id, text, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, user_name AS "user",
         lower(user_name) AS username, likes, CAST(length(lang) AS BIGINT) AS retweets,
         CAST(0 AS BIGINT) AS replies, source_hashtag,
         concat('http://example.com/', post_id) AS url, lang
  FROM noisy_dated)"""
RAW = """raw AS (
  SELECT post_id, text, date, CASE WHEN lang = 'fr' THEN '' ELSE "user" END AS "user",
         CASE WHEN lang = 'fr' THEN '' ELSE username END AS username,
         CASE WHEN lang = 'de' THEN 0 ELSE likes END AS likes,
         CASE WHEN lang = 'de' THEN 0 ELSE retweets END AS retweets, replies,
         source_hashtag, url
  FROM flat)"""
FLAT_ITEMS = (V.DATED, V.NOISY_DATED, FLAT_NOISY)

for name in ("csv_roundtrip", "json_roundtrip", "load_or_create"):
    register(name, f"SELECT {FLAT} FROM flat", *FLAT_ITEMS)
register(
    "csv_reordered",
    """SELECT text, date, "user", NULL::VARCHAR AS username, likes, NULL::BIGINT AS retweets,
      NULL::BIGINT AS replies, NULL::VARCHAR AS source_hashtag, url FROM flat""",
    *FLAT_ITEMS,
)
register(
    "csv_extra_columns", f"SELECT {FLAT}, lower(text) AS text_cleaned FROM flat", *FLAT_ITEMS
)
register("flatten_posts", f"SELECT {FLAT} FROM raw", *FLAT_ITEMS, RAW)
register(
    "collect_raw",
    f"""SELECT post_id, {FLAT} FROM raw WHERE {Q.is_not_blank('text')}
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY post_id) = 1""",
    *FLAT_ITEMS,
    RAW,
)
TAGS_OF = f"regexp_extract_all(lower(text), {Q.quote(Q.TAG_WORD)}, 1)"
register(
    "union_by_tag",
    f"""SELECT post_id, text, tag AS source_hashtag
    FROM noisy JOIN (VALUES ('src0'), ('src1'), ('src2'), ('src3')) AS t(tag)
    ON list_contains({TAGS_OF}, tag)""",
    V.NOISY,
)
register(
    "stack_by_tag",
    """SELECT post_id, text, 'documents' AS source_hashtag FROM posts
    UNION ALL SELECT event_id, event_type, 'events' FROM events""",
)
register(
    "select_by_hashtag",
    f"SELECT post_id, text FROM noisy WHERE list_contains({TAGS_OF}, 'src3')",
    V.NOISY,
)
register(
    "select_by_keyword", "SELECT post_id, text FROM posts WHERE contains(lower(text), 'ation')"
)
register(
    "hashtag_quota",
    f"""SELECT post_id, source_hashtag, date FROM dated WHERE source_hashtag IN {TAG_LIST}
    QUALIFY row_number() OVER (PARTITION BY source_hashtag ORDER BY date DESC, post_id) <= 25""",
    V.DATED,
)


register(
    "preset_posts",
    """SELECT post_id, date, CASE source_hashtag WHEN 'src0' THEN 'layoffs' WHEN 'src1' THEN 'jobcuts'
      ELSE 'recession' END AS source_hashtag
    FROM dated WHERE source_hashtag IN ('src0', 'src1', 'src2')
    QUALIFY row_number() OVER (PARTITION BY source_hashtag ORDER BY date DESC, post_id) <= 20""",
    V.DATED,
)
register(
    "hashtag_quota_large",
    f"""SELECT post_id, source_hashtag, date FROM dated WHERE source_hashtag IN {TAG_LIST}
    QUALIFY row_number() OVER (PARTITION BY source_hashtag ORDER BY date DESC, post_id) <= 5000""",
    V.DATED,
)


def collected(tags: tuple[str, ...], per_tag: int) -> str:
    """WITH item ``collected``: quota per tag, then the first row of each text."""
    values = ", ".join(f"('{t}', {i})" for i, t in enumerate(tags))
    return f"""tagged AS (SELECT post_id, text, date, tag, place
  FROM noisy_dated JOIN (VALUES {values}) AS t(tag, place) ON list_contains({TAGS_OF}, tag)
  QUALIFY row_number() OVER (PARTITION BY tag ORDER BY date DESC, post_id) <= {per_tag}),
collected AS (SELECT post_id, text, date, tag AS source_hashtag FROM tagged
  WHERE {Q.is_not_blank('text')}
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY place, post_id) = 1)"""


register(
    "collect_by_tags",
    "SELECT * FROM collected",
    V.DATED,
    V.NOISY_DATED,
    collected(("src1", "src2", "src5"), 30),
)

# Filters, dedup, samples ---------------------------------------------------------------------

register(
    "dedup_posts",
    f"""SELECT * FROM posts WHERE {Q.is_not_blank('text')}
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY post_id) = 1""",
)
register(
    "dedup_newest",
    f"""SELECT post_id, text, date FROM dated WHERE {Q.is_not_blank('text')}
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY date DESC, post_id) = 1""",
    V.DATED,
)
register(
    "sample_posts",
    "SELECT post_id, text FROM posts ORDER BY md5(concat(post_id, '42')), post_id LIMIT 100",
)
PARSED = "parsed AS (SELECT post_id, TRY_CAST(date AS TIMESTAMP) AS date FROM text_dates)"
register("coerce_dates", "SELECT * FROM parsed", V.DATED, V.TEXT_DATES, PARSED)
register(
    "coerce_dates_mixed",
    """SELECT post_id, CASE lang
      WHEN 'en' THEN date_trunc('day', date)
      WHEN 'fr' THEN date_trunc('day', date)
      WHEN 'de' THEN date_trunc('second', date) - INTERVAL 2 HOUR
      ELSE date_trunc('second', date) + INTERVAL 8 HOUR END AS date FROM dated""",
    V.DATED,
)
register(
    "coerce_dates_shapes",
    """SELECT post_id, CASE WHEN post_id % 10 IN (1, 2, 4, 8) THEN date_trunc('day', date)
      ELSE date_trunc('second', date) END AS date FROM dated""",
    V.DATED,
)
register(
    "filter_by_date",
    """SELECT * FROM parsed
    WHERE date >= TIMESTAMP '2024-01-02' AND date <= TIMESTAMP '2024-01-03 12:00:00'""",
    V.DATED,
    V.TEXT_DATES,
    PARSED,
)
register(
    "preprocess_posts",
    f"""SELECT * FROM (SELECT post_id, {Q.clean('text', 'moderate')} AS text_cleaned FROM noisy)
    WHERE length(text_cleaned) > 10""",
    V.NOISY,
)


def valid(n: int) -> str:
    return (
        f"length(trim(text, {Q.quote(SPACE_CHARS)})) >= {n} AND len({Q.words('text')}) >= 2"
    )


register("valid_text_flag", f"SELECT post_id, {valid(10)} AS is_valid FROM posts")
register("filter_valid_posts", f"SELECT post_id, text FROM posts WHERE {valid(40)}")
register(
    "validate_posts",
    f"""SELECT count(*) AS total_rows, count(*) FILTER (text IS NULL) AS null_texts,
      count(*) FILTER (NOT {Q.is_not_blank('text')}) AS blank_texts, '' AS missing_columns,
      count(*) > 0 AND count(*) FILTER (text IS NULL) <> count(*)
        AND count(*) FILTER (NOT {Q.is_not_blank('text')}) <> count(*) AS is_valid
    FROM dated""",
    V.DATED,
)
SCORED = (V.DATED, Q.scored("dated", V.LEXICON))
for name, label, least in (
    ("filter_by_sentiment", "NEGATIVE", 0.6),
    ("positive_posts", "POSITIVE", 0.5),
    ("negative_posts", "NEGATIVE", 0.5),
    ("neutral_posts", "NEUTRAL", 0.0),
    ("high_confidence_positive", "POSITIVE", 0.8),
    ("high_confidence_negative", "NEGATIVE", 0.8),
):
    register(
        name,
        f"""SELECT post_id, sentiment_label, round(sentiment_score, 6) AS sentiment_score
        FROM scored WHERE sentiment_label = '{label}' AND sentiment_score >= {least}""",
        *SCORED,
    )

# Text functions ------------------------------------------------------------------------------

CLEANED = {
    "remove_pattern": Q.replaced("text", "[aeiou]+", "*"),
    "remove_mentions": Q.mentions("text"),
    "remove_hashtags": Q.hashtags("text"),
    "remove_urls": Q.urls("text"),
    "remove_emails": Q.emails("text"),
    "remove_numbers": Q.numbers("text"),
    "remove_emojis": Q.emojis("text"),
    "remove_punctuation": Q.punctuation("text"),
    "normalize_whitespace": Q.whitespace("text"),
    "to_lowercase": Q.lower("text"),
    "remove_short_words": Q.short(4)("text"),
    "remove_stopwords": Q.stopwords("text"),
    "custom_clean": Q.lower(Q.mentions(Q.urls("text"))),
    **{f"clean_{chain}": Q.clean("text", chain) for chain in Q.CHAINS},
}
for name, expression in CLEANED.items():
    register(name, f"SELECT post_id, {expression} AS text_cleaned FROM noisy", V.NOISY)
register(
    "clean_posts",
    f"""SELECT * FROM (SELECT post_id, text, {Q.clean('text', 'moderate')} AS text_cleaned
    FROM noisy) WHERE {Q.is_not_blank('text_cleaned')}""",
    V.NOISY,
)
register(
    "clean_posts_overwrite",
    f"""SELECT * FROM (SELECT post_id, {Q.clean('text', 'aggressive')} AS text FROM noisy)
    WHERE {Q.is_not_blank('text')}""",
    V.NOISY,
)
register(
    "clean_with_udf",
    f"SELECT post_id, lower({Q.replaced('text', Q.NUMBER, '#')}) AS text_cleaned FROM noisy",
    V.NOISY,
)
register(
    "array_flatten",
    f"""SELECT post_id, array_to_string(flatten(list_transform(string_split(text, '.'),
    lambda s: {Q.words('s')})), '|') AS tokens FROM posts""",
)
register(
    "array_compact",
    f"""SELECT post_id, array_to_string(list_filter({Q.words('text')},
    lambda w: length(w) > 3), '|') AS tokens FROM posts""",
)
register("truncate_text", "SELECT post_id, left(text, 512) AS text_truncated FROM posts")

# Features ------------------------------------------------------------------------------------

ROUNDED_STATS = ("text_avg_word_length", "text_uppercase_ratio")
stats = ", ".join(
    f"round({x}, 6) AS {n}" if n in ROUNDED_STATS else f"CAST({x} AS INTEGER) AS {n}"
    for n, x in Q.text_statistics("text").items()
)
register("text_features", f"SELECT post_id, {stats} FROM noisy", V.NOISY)
fields = ", ".join(f"CAST({x} AS INTEGER) AS {n}" for n, x in Q.TIME_FEATURES.items())
register(
    "temporal_features",
    f"""SELECT *, {fields}, CASE WHEN hour(date) <= 6 THEN 'Night' WHEN hour(date) <= 12
    THEN 'Morning' WHEN hour(date) <= 18 THEN 'Afternoon' WHEN hour(date) <= 23 THEN 'Evening'
    END AS time_period FROM parsed""",
    V.DATED,
    V.TEXT_DATES,
    PARSED,
)
register(
    "label_encode",
    """SELECT post_id, source_hashtag, lang,
    dense_rank() OVER (ORDER BY source_hashtag) - 1 AS source_hashtag_encoded,
    dense_rank() OVER (ORDER BY lang) - 1 AS lang_encoded FROM posts""",
)
register(
    "label_encode_apply",
    """SELECT post_id, p.lang, p.tag, CAST(coalesce(t.code, -1) AS BIGINT) AS tag_encoded,
      CAST(coalesce(l.code, -1) AS BIGINT) AS lang_encoded, t.tag AS tag_decoded, l.lang AS lang_decoded
    FROM tagged p LEFT JOIN tags t ON p.tag = t.tag LEFT JOIN langs l ON p.lang = l.lang""",
    "tagged AS (SELECT post_id, lang, concat_ws('-', source_hashtag, n_chars % 7) AS tag FROM posts)",
    """tags AS (SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS code
      FROM (SELECT DISTINCT tag FROM tagged WHERE post_id % 4 = 1))""",
    """langs AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS code
      FROM (SELECT DISTINCT lang FROM tagged WHERE post_id % 4 = 1))""",
)
for method, center, width in (
    ("standard", "avg({c})", "stddev_pop({c})"),
    ("minmax", "min({c})", "max({c}) - min({c})"),
    (
        "robust",
        "quantile_cont({c}, 0.5)",
        "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)",
    ),
):
    fit = ", ".join(
        f"{center.format(c=c)} AS m_{c}, {width.format(c=c)} AS w_{c}" for c in ("likes", "n_chars")
    )
    scaled = ", ".join(
        f"round((CAST({c} AS DOUBLE) - m_{c}) / w_{c}, 6) AS {c}_scaled" for c in ("likes", "n_chars")
    )
    register(
        f"scale_{method}",
        f"SELECT post_id, likes, n_chars, {scaled} FROM posts, fit",
        f"fit AS (SELECT {fit} FROM posts)",
    )

WEIGHTS = "SELECT post_id, term, round(value, 6) AS value FROM weights"
register("tfidf_terms", WEIGHTS, Q.term_weights("posts"))
register("count_terms", WEIGHTS, Q.term_weights("posts", ngrams=(1, 1), tfidf=False))
register("tfidf_basic", WEIGHTS, Q.term_weights("posts", ngrams=(1, 1), max_features=500))
register("tfidf_advanced", WEIGHTS, Q.term_weights("posts", ngrams=(1, 3), max_features=2000))

MATRIX_POSTS = f"""matrix_posts AS (SELECT * FROM
  (SELECT post_id, date, {Q.clean('text', 'moderate')} AS text_cleaned FROM dated)
  WHERE {Q.is_not_blank('text_cleaned')})"""


def matrix(*parts: dict[str, str]) -> str:
    singles = [
        f"SELECT post_id, '{n}' AS feature, CAST({x} AS DOUBLE) AS value FROM matrix_posts"
        for part in parts
        for n, x in part.items()
    ]
    entries = " UNION ALL ".join(
        [*singles, "SELECT post_id, term AS feature, value FROM weights"]
    )
    return f"SELECT post_id, feature, round(value, 6) AS value FROM ({entries}) WHERE value <> 0"


matrix_tfidf = Q.term_weights("matrix_posts", "text_cleaned")
matrix_counts = Q.term_weights("matrix_posts", "text_cleaned", (1, 1), tfidf=False)
matrix_stats = Q.text_statistics("text_cleaned")
register(
    "feature_matrix",
    matrix(matrix_stats, Q.TIME_FEATURES),
    V.DATED,
    MATRIX_POSTS,
    matrix_tfidf,
)
register("sentiment_features", matrix(matrix_stats), V.DATED, MATRIX_POSTS, matrix_tfidf)
register("topic_features", matrix(), V.DATED, MATRIX_POSTS, matrix_counts)

# Absent entries of the matrix are zeros and count in every statistic.
for method, center, width in (
    ("standard", "s / n", "sqrt(greatest(q / n - (s / n) * (s / n), 0))"),
    ("minmax", "least(low, z)", "greatest(high, z) - least(low, z)"),
    ("robust", "q2", "q3 - q1"),
):
    register(
        f"scale_matrix_{method}",
        f"""SELECT post_id, feature, round((value - {center}) / (CASE WHEN abs({width}) < 1e-12
          THEN 1 ELSE {width} END), 6) AS value FROM entries JOIN fitted USING (feature)""",
        f"""matrix_posts AS (SELECT * FROM
  (SELECT post_id, {Q.clean('text', 'moderate')} AS text_cleaned FROM posts)
  WHERE {Q.is_not_blank('text_cleaned')})""",
        matrix_tfidf,
        "entries AS (SELECT post_id, feature, value FROM ("
        + " UNION ALL ".join(
            [
                *(
                    f"SELECT post_id, '{n}' AS feature, CAST({x} AS DOUBLE) AS value FROM matrix_posts"
                    for n, x in matrix_stats.items()
                ),
                "SELECT post_id, term AS feature, value FROM weights",
            ]
        )
        + ") WHERE value <> 0)",
        """n_posts AS (SELECT count(*) AS n FROM matrix_posts),
names AS (SELECT DISTINCT feature FROM entries),
filled AS (SELECT names.feature, coalesce(value, 0) AS value
  FROM names CROSS JOIN matrix_posts LEFT JOIN entries USING (feature, post_id)),
fitted AS (SELECT feature, sum(value) AS s, sum(value * value) AS q, min(value) AS low,
  max(value) AS high, count(*)::DOUBLE AS n, min(value) AS z,
  quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
  quantile_cont(value, 0.75) AS q3 FROM filled GROUP BY feature)""",
    )

stat_rows = " UNION ALL ".join(
    f"SELECT post_id, '{n}' AS feature, CAST({x} AS DOUBLE) AS value FROM matrix_posts"
    for n, x in matrix_stats.items()
)
register(
    "scale_matrix_full",
    """SELECT post_id, feature, round((value - avg(value) OVER same)
      / coalesce(nullif(stddev_pop(value) OVER same, 0), 1), 6) AS value
    FROM filled WINDOW same AS (PARTITION BY feature)""",
    f"""matrix_posts AS (SELECT * FROM
      (SELECT post_id, {Q.clean('text', 'moderate')} AS text_cleaned FROM posts)
      WHERE {Q.is_not_blank('text_cleaned')})""",
    Q.term_weights("matrix_posts", "text_cleaned", max_features=100),
    f"entries AS ({stat_rows} UNION ALL SELECT post_id, term, value FROM weights)",
    """filled AS (SELECT post_id, feature, coalesce(value, 0) AS value
      FROM (SELECT DISTINCT feature FROM entries) CROSS JOIN (SELECT post_id FROM matrix_posts)
      LEFT JOIN entries USING (feature, post_id))""",
)

# Scoring -------------------------------------------------------------------------------------

PREPROCESSED = f"""preprocessed AS (SELECT * FROM
  (SELECT post_id, {Q.clean('text', 'moderate')} AS text_cleaned FROM noisy)
  WHERE length(text_cleaned) > 10)"""
SCORES = f"SELECT post_id, {SENTIMENT} FROM scored"
register(
    "score_sentiment",
    SCORES,
    V.NOISY,
    PREPROCESSED,
    Q.scored("preprocessed", V.LEXICON, "text_cleaned"),
)
ORACLES["score_sentiment_joined"] = ORACLES["score_sentiment"]
register(
    "score_sentiment_trained_checks",
    "SELECT doc_id AS post_id, TRUE AS known_label, TRUE AS adds_up, TRUE AS is_largest FROM documents",
)
register("score_sentiment_truncated", SCORES, Q.scored("posts", V.LEXICON, "text", 512))
# The model of this query splits on blanks and calls a text without known words a tie, which is
# negative.
register(
    "score_sentiment_udf",
    """SELECT post_id, CASE WHEN p > n THEN 'POSITIVE' ELSE 'NEGATIVE' END AS sentiment_label,
      round(greatest(pos, neg), 6) AS sentiment_score, round(pos, 6) AS sentiment_positive,
      round(neg, 6) AS sentiment_negative, 0.0::DOUBLE AS sentiment_neutral
    FROM shares""",
    f"""udf_words AS (SELECT post_id, {Q.words('lower(text)')} AS tokens FROM posts),
udf_hits AS (SELECT post_id, {Q.hits('tokens', [w for w, p in V.LEXICON if p > 0])} AS p,
  {Q.hits('tokens', [w for w, p in V.LEXICON if p < 0])} AS n FROM udf_words),
shares AS (SELECT *, CASE WHEN p + n = 0 THEN 0.5 ELSE p::DOUBLE / (p + n) END AS pos,
  CASE WHEN p + n = 0 THEN 0.5 ELSE n::DOUBLE / (p + n) END AS neg FROM udf_hits)""",
)
register(
    "normalize_scores",
    """SELECT post_id,
      CASE lang WHEN 'fr' THEN '2' WHEN 'de' THEN '5 STARS' ELSE
        CASE WHEN sentiment_positive > sentiment_negative THEN 'POSITIVE' ELSE 'NEGATIVE' END
      END AS sentiment_label,
      round(CASE lang WHEN 'fr' THEN sentiment_neutral WHEN 'de' THEN sentiment_score
        ELSE greatest(sentiment_positive, sentiment_negative) END, 6) AS sentiment_score,
      round(CASE lang WHEN 'de' THEN 0 ELSE sentiment_positive END, 6) AS sentiment_positive,
      round(CASE WHEN lang IN ('fr', 'de') THEN 0 ELSE sentiment_negative END, 6)
        AS sentiment_negative,
      round(CASE WHEN lang IN ('en', 'fr') THEN sentiment_neutral ELSE 0 END, 6)
        AS sentiment_neutral
    FROM scored""",
    *SCORED,
)


def emotions() -> str:
    names = sorted({e for _, e in V.EMOTIONS})
    tokens = f"regexp_extract_all(lower(text), '[{Q.WORD}]+')"
    counts = ", ".join(
        f"{Q.hits('tokens', [w for w, e in V.EMOTIONS if e == n])} AS {n}" for n in names
    )
    most = f"greatest({', '.join(names)})"
    cases = " ".join(f"WHEN {n} = {most} THEN '{n}'" for n in names)
    return f"""emotion_words AS (SELECT post_id, {tokens} AS tokens FROM posts),
emotion_counts AS (SELECT post_id, {counts} FROM emotion_words),
emotions AS (SELECT post_id, CASE WHEN {most} = 0 THEN 'NEUTRAL' {cases} END AS emotion
  FROM emotion_counts)"""


register("emotion_labels", "SELECT * FROM emotions", emotions())
ORACLES["emotion_labels_joined"] = ORACLES["emotion_labels"]
register(
    "emotion_distribution",
    """SELECT emotion, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share
    FROM emotions GROUP BY emotion""",
    emotions(),
)

# Summaries -----------------------------------------------------------------------------------

PROFILED = ("post_id", "text", "source_hashtag", "lang", "likes", "n_chars", "date", "user_name")
nulls = ", ".join(f"count(*) FILTER ({c} IS NULL) AS nulls_{c}" for c in PROFILED)
register(
    "dataset_profile",
    f"""SELECT count(*) AS total_posts, count(DISTINCT user_name) AS unique_users,
    min(date) AS date_start, max(date) AS date_end, {nulls}, '{','.join(PROFILED)}' AS columns
    FROM dated""",
    V.DATED,
)
register(
    "hashtag_distribution",
    "SELECT source_hashtag, count(*) AS count FROM posts GROUP BY source_hashtag",
)
register(
    "sentiment_distribution",
    """SELECT sentiment_label, count(*) AS count,
    round(count(*) / sum(count(*)) OVER (), 6) AS share FROM scored GROUP BY sentiment_label""",
    *SCORED,
)
register("distinct_labels", "SELECT DISTINCT sentiment_label FROM scored", *SCORED)
register(
    "sentiment_statistics",
    """SELECT count(*) AS total_posts, round(avg(sentiment_positive), 6) AS avg_positive,
      round(avg(sentiment_negative), 6) AS avg_negative,
      round(avg(sentiment_neutral), 6) AS avg_neutral,
      round(avg(sentiment_score), 6) AS mean_confidence,
      round(quantile_cont(sentiment_score, 0.5), 6) AS median_confidence,
      round(stddev_samp(sentiment_score), 6) AS std_confidence FROM scored""",
    *SCORED,
)
register(
    "confidence_boxstats",
    """SELECT sentiment_label, round(min(sentiment_score), 6) AS "min",
      round(quantile_cont(sentiment_score, 0.25), 6) AS q1,
      round(quantile_cont(sentiment_score, 0.5), 6) AS "median",
      round(quantile_cont(sentiment_score, 0.75), 6) AS q3,
      round(max(sentiment_score), 6) AS "max", count(*) AS "count"
    FROM scored GROUP BY sentiment_label""",
    *SCORED,
)
LABELS = ("POSITIVE", "NEGATIVE", "NEUTRAL")
percents = ", ".join(
    f"round(count(*) FILTER (sentiment_label = '{n}') / count(*) * 100, 6) AS {n}" for n in LABELS
)
for name, bucket in (
    ("day", "CAST(date AS DATE)"),
    ("week", "CAST(date_trunc('week', date) AS DATE) + 6"),
    ("month", "last_day(date)"),
):
    register(
        f"sentiment_trends_{name}",
        f"SELECT {bucket} AS bucket, {percents} FROM scored GROUP BY ALL",
        *SCORED,
    )
SUNDAYS = """sundays AS (SELECT *, CAST(date_trunc('week', date) AS DATE) + 6 AS sunday,
  min(CAST(date_trunc('week', date) AS DATE) + 6) OVER () AS first FROM scored)"""
register(
    "sentiment_trends_2w",
    f"""SELECT first + CAST(14 * ceil((sunday - first) / 14) AS INTEGER) AS bucket, {percents}
    FROM sundays GROUP BY ALL""",
    *SCORED,
    SUNDAYS,
)
register(
    "sentiment_trends_6h",
    f"""SELECT time_bucket(INTERVAL 6 HOUR, date, TIMESTAMP '2000-01-01') AS bucket, {percents}
    FROM scored GROUP BY ALL""",
    *SCORED,
)
CUBE = ", ".join(
    f"count({c}) AS {m}_n, round(sum({c}), 6) AS {m}_sum, round(sum({c} * {c}), 6) AS {m}_squares, "
    f"round(min({c}), 6) AS {m}_min, round(max({c}), 6) AS {m}_max"
    for m, c in (
        ("confidence", "sentiment_score"), ("positive", "sentiment_positive"),
        ("negative", "sentiment_negative"), ("neutral", "sentiment_neutral"),
    )
)
register(
    "report_cube",
    f"""SELECT CAST(date AS DATE) AS day, sentiment_label, count(*) AS posts, {CUBE}
    FROM scored GROUP BY ALL""",
    *SCORED,
)


def unpivoted(report: str, key: str, table: str, **measures: str) -> str:
    """Rows ``(report, key, measure, value)`` of the grouped ``table``."""
    columns = ", ".join(f'CAST({x} AS DOUBLE) AS "{m}"' for m, x in measures.items())
    group = "GROUP BY key" if key != "'all'" else ""
    return f"""SELECT '{report}' AS report, key, measure, round(value, 6) AS value FROM (
      UNPIVOT (SELECT {key} AS key, {columns} FROM {table} {group})
      ON {", ".join(f'"{m}"' for m in measures)} INTO NAME measure VALUE value)"""


REPORTS = (
    unpivoted("distribution", "sentiment_label", "scored", count="count(*)",
              share="count(*) / (SELECT count(*) FROM scored)"),
    unpivoted("range", "sentiment_label", "scored", min="min(sentiment_score)",
              max="max(sentiment_score)", count="count(*)"),
    unpivoted("statistics", "'all'", "scored", total_posts="count(*)",
              avg_positive="avg(sentiment_positive)", avg_negative="avg(sentiment_negative)",
              mean_confidence="avg(sentiment_score)", std_confidence="stddev_samp(sentiment_score)"),
    unpivoted("timeline", "concat(CAST(date AS DATE), ' ', sentiment_label)", "scored",
              count="count(*)"),
    unpivoted("trends", "CAST(CAST(date_trunc('week', date) AS DATE) + 6 AS VARCHAR)", "scored",
              **{n: f"count(*) FILTER (sentiment_label = '{n}') / count(*) * 100" for n in LABELS}),
)
register("report_cube_tables", " UNION ALL ".join(REPORTS), *SCORED)
register(
    "sentiment_timeline",
    """SELECT CAST(date AS DATE) AS bucket, sentiment_label, count(*) AS count
    FROM scored GROUP BY ALL""",
    *SCORED,
)
counts = ", ".join(f"count(*) FILTER (sentiment_label = '{n}') AS {n}" for n in LABELS)
register(
    "sentiment_timeline_wide",
    f"SELECT CAST(date AS DATE) AS bucket, {counts} FROM scored GROUP BY ALL",
    *SCORED,
)
register(
    "top_words",
    f"""SELECT word, count(*) AS count
    FROM (SELECT unnest({Q.tokens('lower(text_cleaned)')}) AS word FROM preprocessed)
    WHERE NOT list_contains({Q.string_list(BASIC_STOPWORDS)}, word)
    GROUP BY word ORDER BY count DESC, word LIMIT 100""",
    V.NOISY,
    PREPROCESSED,
)
register(
    "top_words_negative",
    f"""SELECT word, count(*) AS count
    FROM (SELECT unnest({Q.tokens('lower(text)')}) AS word FROM scored
          WHERE sentiment_label = 'NEGATIVE')
    GROUP BY word ORDER BY count DESC, word LIMIT 100""",
    *SCORED,
)
register(
    "top_words_by_sentiment",
    f"""SELECT sentiment_label, word, count(*) AS count, CAST(row_number() OVER (
        PARTITION BY sentiment_label ORDER BY count(*) DESC, word) AS INTEGER) AS rank
    FROM (SELECT sentiment_label, unnest({Q.tokens('lower(text)')}) AS word FROM scored)
    GROUP BY sentiment_label, word QUALIFY rank <= 100""",
    *SCORED,
)
CLEANED_NOISY = f"""cleaned AS (SELECT * FROM
  (SELECT post_id, {Q.clean('text', 'moderate')} AS text_cleaned FROM noisy)
  WHERE {Q.is_not_blank('text_cleaned')})"""
register(
    "quick_start",
    """SELECT sentiment_label, count(*) AS count,
    round(count(*) / sum(count(*)) OVER (), 6) AS share
    FROM scored WHERE sentiment_score > 0.6 GROUP BY sentiment_label""",
    V.NOISY,
    CLEANED_NOISY,
    Q.scored("cleaned", V.LEXICON, "text_cleaned"),
)
FULL_CLEANED = f"""full_cleaned AS (SELECT * FROM
  (SELECT *, {Q.clean('text', 'moderate')} AS text_cleaned FROM collected)
  WHERE length(text_cleaned) > 10)"""
register(
    "full_flow",
    f"SELECT post_id, source_hashtag, {SENTIMENT} FROM scored",
    V.DATED,
    V.NOISY_DATED,
    collected(("src0", "src1", "src2", "src3"), 25),
    FULL_CLEANED,
    Q.scored("full_cleaned", V.LEXICON, "text_cleaned"),
)

# Keywords, entities --------------------------------------------------------------------------

KEYWORDS = Q.term_weights("posts", ngrams=(1, 1), max_features=None)
register(
    "keyword_scores",
    "SELECT term, round(sum(value), 6) AS score FROM weights GROUP BY term",
    KEYWORDS,
)
register(
    "top_keywords",
    """SELECT term, round(sum(value), 6) AS score FROM weights GROUP BY term
    ORDER BY sum(value) DESC, term LIMIT 20""",
    KEYWORDS,
)
gazetteer = ", ".join(f"({Q.quote(n)}, {Q.quote(t)})" for n, t in V.GAZETTEER)
register(
    "entity_counts",
    # No name of the table holds another or meets it, so every occurrence counts.
    f"""SELECT type, name, count(*) AS count FROM runs
    JOIN (VALUES {gazetteer}) AS g(name, type) USING (name) GROUP BY type, name""",
    V.NOISY,
    f"""name_words AS (SELECT {Q.clean('text', 'ner')} AS t FROM noisy),
word_lists AS (SELECT regexp_extract_all(t, '[{Q.WORD}]+') AS w FROM name_words),
runs AS (SELECT array_to_string(w[i + 1:i + n], ' ') AS name
  FROM word_lists, (VALUES (1), (2), (3)) AS sizes(n), unnest(range(0, len(w) - n + 1)) AS r(i))""",
)
register(
    "entity_candidates",
    f"""SELECT name, count(*) AS count
    FROM (SELECT unnest(regexp_extract_all(text, {Q.quote(Q.NAME_RUN)})) AS name FROM posts)
    GROUP BY name""",
)

TOPIC_POSTS = f"""topic_posts AS (SELECT * FROM
  (SELECT post_id, {Q.clean('text', 'topic')} AS text_cleaned FROM posts)
  WHERE {Q.is_not_blank('text_cleaned')})"""
register(
    "lda_topic_checks",
    "SELECT post_id, TRUE AS in_range, TRUE AS adds_up, TRUE AS is_heaviest FROM topic_posts",
    TOPIC_POSTS,
)
register(
    "topic_top_words_checks",
    "SELECT t::INTEGER AS topic, 10 AS terms, TRUE AS falls FROM range(5) AS r(t)",
)
register(
    "topic_distribution_checks",
    "SELECT count(*) AS posts, TRUE AS few_topics FROM topic_posts",
    TOPIC_POSTS,
)
register(
    "topic_cluster_checks",
    "SELECT post_id, TRUE AS in_range, TRUE AS placed FROM topic_posts",
    TOPIC_POSTS,
)
register(
    "dashboard",
    f"""SELECT 'distribution' AS report, count(DISTINCT sentiment_label) AS "rows", count(*) AS posts
      FROM scored
    UNION ALL SELECT 'statistics', 1, NULL
    UNION ALL SELECT 'confidence', count(DISTINCT sentiment_label), count(*) FROM scored
    UNION ALL SELECT 'timeline', count(DISTINCT (CAST(date AS DATE), sentiment_label)), count(*)
      FROM scored
    UNION ALL SELECT 'timeline_wide', count(DISTINCT CAST(date AS DATE)), NULL FROM scored
    UNION ALL SELECT 'trends', count(DISTINCT CAST(date AS DATE)), NULL FROM scored
    UNION ALL SELECT 'words', least(100, count(DISTINCT word)), NULL FROM dashboard_words
    UNION ALL SELECT 'words_by_label', sum(least(100, n)), NULL FROM
      (SELECT count(DISTINCT word) AS n FROM dashboard_words GROUP BY sentiment_label)""",
    *SCORED,
    f"""dashboard_words AS (
  SELECT sentiment_label, unnest({Q.tokens('lower(text)')}) AS word FROM scored)""",
)

# Topics by language ----------------------------------------------------------------------------

FOLD_STEPS = 5


def language_topics() -> list[str]:
    """WITH items up to ``weights(topic, class, term, weight)`` and ``known``, all posts' terms."""
    counted = Q.term_weights("learned", ngrams=(1, 1), tfidf=False).split("raw AS (")[0].rstrip(",\n")
    every = Q.term_weights("posts", ngrams=(1, 1), tfidf=False).split("size AS (")[0].rstrip(",\n")
    for name in ("toks", "grams", "tf"):
        every = every.replace(f"{name} AS (", f"all_{name} AS (").replace(f"FROM {name}", f"FROM all_{name}")
    return [
        "learned AS (SELECT * FROM posts WHERE post_id % 5 <> 0)",
        counted,
        every,
        """seen AS (SELECT lang AS class, term, sum(tf) AS n
          FROM tf JOIN vocab USING (term) JOIN posts USING (post_id) GROUP BY ALL)""",
        """classes AS (SELECT class, sum(n) AS words, row_number() OVER (ORDER BY class) - 1 AS topic
          FROM seen GROUP BY class)""",
        """weights AS (SELECT CAST(topic AS INTEGER) AS topic, class, v.term,
            (coalesce(n, 0) + 0.01::DOUBLE) / (words + 0.01::DOUBLE * (SELECT count(*) FROM vocab)) AS weight
          FROM classes CROSS JOIN vocab v LEFT JOIN seen USING (class, term))""",
        """known AS MATERIALIZED (SELECT post_id, term, topic, tf, weight,
            sum(tf) OVER (PARTITION BY post_id, topic) AS words
          FROM all_tf JOIN weights USING (term))""",
        "shares0 AS MATERIALIZED (SELECT post_id, topic, 1.0::DOUBLE / (SELECT count(*) FROM classes)"
        " AS share FROM posts CROSS JOIN classes)",
        *(
            f"""shares{i + 1} AS MATERIALIZED (SELECT post_id, topic, coalesce(found.share, old.share) AS share
          FROM shares{i} old LEFT JOIN (
            SELECT post_id, topic, sum(tf * joint / z) / any_value(words) AS share FROM (
              SELECT k.*, weight * share AS joint, sum(weight * share) OVER (PARTITION BY post_id, term) AS z
              FROM known k JOIN shares{i} USING (post_id, topic)) GROUP BY ALL) found
          USING (post_id, topic))"""
            for i in range(FOLD_STEPS)
        ),
        f"shares AS MATERIALIZED (SELECT * FROM shares{FOLD_STEPS})",
        """likely AS (SELECT post_id, sum(tf * ln(z)) AS ll, sum(tf) AS words FROM (
            SELECT post_id, term, tf, sum(weight * share) AS z
            FROM known JOIN shares USING (post_id, topic) GROUP BY ALL) GROUP BY post_id)""",
    ]


register(
    "topic_class_weights",
    "SELECT topic, class, term, round(weight, 9) AS weight FROM weights",
    *language_topics(),
)
register(
    "topic_perplexity",
    """SELECT count(*) AS posts, CAST(coalesce(sum(words), 0) AS BIGINT) AS words,
      round(exp(-sum(ll) / sum(words)), 4) AS perplexity
    FROM posts LEFT JOIN likely USING (post_id) WHERE post_id % 5 = 0""",
    *language_topics(),
)
register(
    "topic_shares",
    """SELECT post_id, CAST(coalesce(words, 0) AS BIGINT) AS words, CAST(topic AS INTEGER) AS topic,
      round(share, 6) AS share FROM shares LEFT JOIN likely USING (post_id)""",
    *language_topics(),
)
TURNED = "list_transform({m}, lambda r: list_dot_product(r, v))"


def axis(name: str, m: str) -> list[str]:
    """WITH items ending in ``{name}(v, size)``: the main axis of matrix ``m`` by repeated products."""
    turned = TURNED.format(m="m")
    length = f"sqrt(list_dot_product({turned}, {turned}))"
    return [
        f"""{name}_steps AS (
          SELECT 0 AS step, [1.0, 0.5, 0.25, 0.125]::DOUBLE[] AS v, 0.0::DOUBLE AS size
          UNION ALL SELECT step + 1, list_transform({turned}, lambda u: u / {length}), {length}
          FROM {name}_steps, {m} WHERE step < 600)""",
        f"""{name} AS MATERIALIZED (SELECT list_transform(v, lambda u: u * sign(v[list_position(
            list_transform(v, lambda w: round(abs(w), 9)), list_max(list_transform(v, lambda w: round(abs(w), 9))))])) AS v, size
          FROM {name}_steps WHERE step = 600)""",
    ]


POINTS = [
    *language_topics(),
    """wide AS MATERIALIZED (SELECT post_id, list(share ORDER BY topic) AS w FROM shares GROUP BY post_id)""",
    """m1 AS MATERIALIZED (SELECT list(line ORDER BY i) AS m FROM (
        SELECT i, list(c ORDER BY j) AS line FROM (
          SELECT i, j, covar_pop(w[i], w[j]) AS c FROM wide, range(1, 5) AS a(i), range(1, 5) AS b(j)
          GROUP BY i, j) GROUP BY i))""",
    *axis("first", "m1"),
    """m2 AS MATERIALIZED (SELECT list_transform(range(1, 5), lambda i: list_transform(range(1, 5),
        lambda j: m[i][j] - size * v[i] * v[j])) AS m FROM m1, first)""",
    *axis("second", "m2"),
    """points AS MATERIALIZED (SELECT post_id, list_dot_product(w, first.v) AS x,
        list_dot_product(w, second.v) AS y FROM wide, first, second)""",
]


def register_recursive(name: str, select: str, *items: str) -> None:
    register(name, select, *items)
    ORACLES[name] = ORACLES[name].replace("WITH ", "WITH RECURSIVE ", 1)


register_recursive("topic_points", "SELECT post_id, round(x, 6) AS x, round(y, 6) AS y FROM points", *POINTS)


def clusters(k: int, steps: int) -> list[str]:
    """WITH items ending in ``clustered(x, y, c)``: the farthest points, then Lloyd's steps."""
    distance = "(p.x - c.x) ** 2 + (p.y - c.y) ** 2"
    items = [
        "p AS MATERIALIZED (SELECT round(x, 4) AS x, round(y, 4) AS y FROM points)",
        "c0 AS MATERIALIZED (SELECT -1 AS i, avg(x) AS x, avg(y) AS y FROM p)",
    ]
    for n in range(1, k + 1):
        from_ = f"c{n - 1}" if n > 1 else "c0"
        kept = f"SELECT * FROM c{n - 1} UNION ALL" if n > 1 else ""
        items.append(
            f"""c{n} AS MATERIALIZED ({kept} (SELECT {n - 1} AS i, x, y FROM (
              SELECT p.x, p.y, min({distance}) AS d FROM p, {from_} c GROUP BY p.x, p.y)
              ORDER BY d DESC, x, y LIMIT 1))"""
        )
    last = f"c{k}"
    for n in range(steps):
        items += [
            f"""a{n} AS MATERIALIZED (SELECT p.x, p.y, arg_min(c.i, {distance}) AS i FROM p, {last} c
              GROUP BY p.x, p.y)""",
            f"""l{n} AS MATERIALIZED (SELECT i, avg(x) AS x, avg(y) AS y FROM p JOIN a{n} USING (x, y) GROUP BY i)""",
        ]
        last = f"l{n}"
    return items


register_recursive(
    "topic_point_clusters",
    "SELECT i AS cluster, count(*) AS posts, round(avg(x), 6) AS x, round(avg(y), 6) AS y"
    " FROM p JOIN a24 USING (x, y) GROUP BY i",
    *POINTS,
    *clusters(4, 25),
)


# Stop lists and areas under the curve --------------------------------------------------------------

register(
    "remove_stopwords_joined",
    f"""SELECT post_id, array_to_string(list_transform(list_filter(list_transform({Q.words('text')},
        lambda w: {{'w': w, 'k': lower(w)}}), lambda x: NOT list_contains(stop, x.k)), lambda x: x.w), ' ')
      AS text_cleaned FROM noisy, listed""",
    V.NOISY,
    f"""listed AS (SELECT list(DISTINCT word) AS stop FROM (
      SELECT lower(unnest(string_split(p_name, ' '))) AS word FROM part
      UNION SELECT unnest({Q.string_list(BASIC_STOPWORDS)})))""",
)
# Pairs of a good and a bad post, from counts by score.
AUC = """judged AS (SELECT score, quality FROM scores JOIN labels ON post_id = doc_id
    WHERE quality IS NOT NULL),
by_score AS (SELECT score, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS n
  FROM judged GROUP BY score),
below AS (SELECT p, n, sum(n) OVER (ORDER BY score) - n AS lower FROM by_score)"""
PAIRS = """SELECT CAST(coalesce(sum(p), 0) AS BIGINT) AS positives, CAST(coalesce(sum(n), 0) AS BIGINT) AS negatives,
  round(sum(p * (lower + n / 2)) / (sum(p)::DOUBLE * sum(n)), 6) AS auc FROM below"""
register(
    "sentiment_auc",
    PAIRS,
    *SCORED,
    "scores AS (SELECT post_id, sentiment_positive AS score FROM scored)",
    AUC,
)
register(
    "trained_auc",
    PAIRS,
    "judged_posts AS (SELECT p.*, quality::VARCHAR AS class FROM posts p JOIN labels ON post_id = doc_id)",
    "learned AS (SELECT * FROM judged_posts WHERE post_id % 5 <> 0)",
    Q.term_weights("learned", ngrams=(1, 1), tfidf=False, stop=()).split("raw AS (")[0].rstrip(",\n"),
    """held AS (SELECT post_id, term, count(*) AS tf FROM (
      SELECT post_id, unnest(regexp_extract_all(lower(text), '""" + Q.TOKEN + """')) AS term
      FROM judged_posts WHERE post_id % 5 = 0) JOIN vocab USING (term) GROUP BY ALL)""",
    """seen AS (SELECT class, term, sum(tf) AS n FROM tf JOIN vocab USING (term)
      JOIN judged_posts USING (post_id) GROUP BY ALL)""",
    "sizes AS (SELECT class, sum(n) AS words FROM seen GROUP BY class)",
    """shares AS (SELECT class, v.term, ln((coalesce(n, 0) + 0.01::DOUBLE)
        / (words + 0.01::DOUBLE * (SELECT count(*) FROM vocab))) AS l
      FROM sizes CROSS JOIN vocab v LEFT JOIN seen USING (class, term))""",
    """scores AS (SELECT post_id, round((sum(tf * l) FILTER (class = '1') - sum(tf * l) FILTER (class = '0'))
        / (sum(tf) FILTER (class = '1')), 9) AS score
      FROM held JOIN shares USING (term) GROUP BY post_id)""",
    AUC,
)
