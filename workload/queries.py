"""Every registered query: ``(spark, sf_dir) -> DataFrame`` over the whole given tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache, reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearsay.functions import scores as S
from hearsay.functions import text as X
from hearsay.functions.text import BASIC_STOPWORDS
from hearsay.operators import (
    cube,
    dedup,
    entities,
    features,
    filters,
    hashed,
    keywords,
    summary,
    topics,
)
from hearsay.operators import sentiment as sent
from hearsay.operators import vectorize as vec
from hearsay.operators.scratch import new_path, store
from hearsay.operators.termcounts import count_terms
from hearsay.operators.topn import sample_rows
from hearsay.plans import flows
from hearsay.schema import MAX_DF, MAX_FEATURES, MIN_DF, POST
from hearsay.sources import files
from hearsay.sources import posts as src

from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TAGS = ("src0", "src1", "src2", "src3")
SENTIMENT = tuple(S.SENTIMENT_COLUMNS.values())
#: Posts that topics and classes are not learned from.
HELD_OUT = "post_id % 5 = 0"
FLAT = tuple(POST.fieldNames())


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Sources and sinks ---------------------------------------------------------------------------


def _flat_noisy(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Noisy posts in the flat post columns, dates as text."""
    noisy = V.add_noise(V.dated_posts(spark, sf_dir))
    return noisy.select(
        *more,
        "post_id",
        "text",
        F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"),
        F.col("user_name").alias("user"),
        F.lower("user_name").alias("username"),
        "likes",
        F.length("lang").cast("bigint").alias("retweets"),
        F.lit(0).cast("bigint").alias("replies"),
        "source_hashtag",
        F.concat(F.lit("http://example.com/"), F.col("post_id").cast("string")).alias("url"),
    )


def _nested(flat: DataFrame) -> DataFrame:
    """Flat posts as raw records; German posts lack their counters and French ones their user."""
    stats = F.when(F.col("post_lang") != "de", F.struct("likes", "retweets", "replies"))
    user = F.when(F.col("post_lang") != "fr", F.struct(F.col("user").alias("name"), "username"))
    return flat.select(
        "post_id",
        "text",
        "date",
        user.alias("user"),
        stats.alias("stats"),
        "source_hashtag",
        "url",
    )


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(_flat_noisy(spark, sf_dir, F.col("lang").alias("post_lang")))


@query
def csv_roundtrip(spark, sf_dir):
    path = new_path(spark, "csv")
    files.write_csv(_flat_noisy(spark, sf_dir).select(*FLAT), path)
    return files.read_csv(spark, path)


@query
def csv_reordered(spark, sf_dir):
    """A file whose columns stand in another order, some missing."""
    path = new_path(spark, "csv")
    files.write_csv(_flat_noisy(spark, sf_dir).select("url", "text", "date", "user", "likes"), path)
    return files.read_csv(spark, path)


@query
def csv_extra_columns(spark, sf_dir):
    """A processed table read again, with its columns beyond those of a post."""
    path = new_path(spark, "csv")
    more = _flat_noisy(spark, sf_dir).withColumn("text_cleaned", F.lower("text"))
    files.write_csv(more.select("text_cleaned", *FLAT), path)
    return files.read_csv(spark, path)


@query
def json_roundtrip(spark, sf_dir):
    path = new_path(spark, "json")
    files.write_json(_flat_noisy(spark, sf_dir).select(*FLAT), path)
    return files.read_json(spark, path)


@query
def load_or_create(spark, sf_dir):
    path = new_path(spark, "posts")
    files.load_or_create(spark, path, lambda: _flat_noisy(spark, sf_dir).select(*FLAT))
    return files.load_or_create(spark, path)


@query
def flatten_posts(spark, sf_dir):
    path = new_path(spark, "raw")
    files.write_json(_raw(spark, sf_dir).drop("post_id"), path)
    return src.flatten_posts(src.read_raw(spark, path))


@query
def collect_raw(spark, sf_dir):
    return src.collect_posts(_raw(spark, sf_dir), ["post_id"], keep=["post_id"])


@query
def union_by_tag(spark, sf_dir):
    """Posts stamped with each wanted tag they carry, found in one pass."""
    return src.tag_posts(V.noisy_posts(spark, sf_dir).select("post_id", "text"), TAGS)


@query
def stack_by_tag(spark, sf_dir):
    """Frames collected apart for each tag, stacked; here two tables of their own."""
    posts = V.posts(spark, sf_dir).select("post_id", "text")
    events = V.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("post_id"), F.col("event_type").alias("text")
    )
    return src.union_by_tag({"documents": posts, "events": events})


@query
def select_by_hashtag(spark, sf_dir):
    noisy = V.noisy_posts(spark, sf_dir).select("post_id", "text")
    return src.post_selector("hashtag")(noisy, "SRC3")


@query
def select_by_keyword(spark, sf_dir):
    return src.post_selector("keyword")(V.posts(spark, sf_dir).select("post_id", "text"), "Ation")


@query
def hashtag_quota(spark, sf_dir):
    dated = V.dated_posts(spark, sf_dir).select("post_id", "source_hashtag", "date")
    return src.hashtag_quota(dated, [F.desc("date"), F.col("post_id")], 100, TAGS)


@query
def preset_posts(spark, sf_dir):
    """The three ready-made selections, over posts whose sources stand for their tags."""
    names = {"src0": "layoffs", "src1": "jobcuts", "src2": "recession"}
    tag = F.col("source_hashtag")
    for source, name in names.items():
        tag = F.when(F.col("source_hashtag") == source, name).otherwise(tag)
    posts = V.dated_posts(spark, sf_dir).select("post_id", "date", tag.alias("source_hashtag"))
    order = [F.desc("date"), F.col("post_id")]
    presets = (src.layoff_posts, src.jobcut_posts, src.recession_posts)
    return reduce(DataFrame.unionByName, (p(posts, order, 20) for p in presets))


@query
def hashtag_quota_large(spark, sf_dir):
    dated = V.dated_posts(spark, sf_dir).select("post_id", "source_hashtag", "date")
    return src.hashtag_quota(dated, [F.desc("date"), F.col("post_id")], 20_000, TAGS)


@query
def collect_by_tags(spark, sf_dir):
    noisy = V.add_noise(V.dated_posts(spark, sf_dir)).select("post_id", "text", "date")
    return flows.collect(noisy, ("SRC1", "src2", "src5"), 90, [F.desc("date")])


# Filters, dedup, samples ---------------------------------------------------------------------


@query
def dedup_posts(spark, sf_dir):
    posts = V.posts(spark, sf_dir)
    return dedup.dedup_posts(posts, ["post_id"]).where(X.is_not_blank("text"))


@query
def dedup_newest(spark, sf_dir):
    posts = V.dated_posts(spark, sf_dir).select("post_id", "text", "date")
    return dedup.dedup_posts(posts, [F.desc("date")]).where(X.is_not_blank("text"))


@query
def sample_posts(spark, sf_dir):
    return sample_rows(V.posts(spark, sf_dir).select("post_id", "text"), "post_id", 100, 42)


@query
def filter_by_date(spark, sf_dir):
    return filters.filter_by_date(V.text_dates(spark, sf_dir), "2024-01-02", "2024-01-03 12:00:00")


@query
def coerce_dates(spark, sf_dir):
    return filters.coerce_dates(V.text_dates(spark, sf_dir))


@query
def coerce_dates_mixed(spark, sf_dir):
    """Dates as people and feeds write them, one form for each language."""
    dated = V.dated_posts(spark, sf_dir)
    forms = {"en": "MMM d, yyyy", "fr": "MM/dd/yyyy", "de": "EEE, dd MMM yyyy HH:mm:ss"}
    text = F.concat(F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-08:00"))
    for lang, form in forms.items():
        zone = F.lit(" +0200" if lang == "de" else "")
        written = F.concat(F.date_format("date", form), zone)
        text = F.when(F.col("lang") == lang, written).otherwise(text)
    return filters.coerce_dates(dated.select("post_id", text.alias("date")))


#: Forms of a date by post_id modulo ten; half of them drop the time of day.
DATE_SHAPES = (
    "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "yyyyMMdd", "yyyyMMdd'T'HHmmss", "d MMMM yyyy",
    "MMMM d, yyyy h:mm:ss a", "dd.MM.yyyy HH:mm:ss", "EEE MMM dd HH:mm:ss '+0000' yyyy", "MM/dd/yyyy",
)


@query
def coerce_dates_shapes(spark, sf_dir):
    """Ten forms of a date, one parse each; the tenth is epoch seconds."""
    text = F.unix_timestamp("date").cast("string")
    for i, form in enumerate(DATE_SHAPES):
        text = F.when(F.col("post_id") % 10 == i, F.date_format("date", form)).otherwise(text)
    dated = V.dated_posts(spark, sf_dir).select("post_id", text.alias("date"))
    return filters.coerce_dates(dated)


@query
def preprocess_posts(spark, sf_dir):
    posts = V.noisy_posts(spark, sf_dir).select("post_id", "text")
    return flows.preprocess(posts).select("post_id", "text_cleaned")


@query
def valid_text_flag(spark, sf_dir):
    posts = V.posts(spark, sf_dir)
    return posts.select("post_id", filters.is_valid_text("text").alias("is_valid"))


@query
def filter_valid_posts(spark, sf_dir):
    posts = V.posts(spark, sf_dir).select("post_id", "text")
    return filters.filter_valid_posts(posts, "text", 40)


@query
def validate_posts(spark, sf_dir):
    dated = V.dated_posts(spark, sf_dir).withColumnRenamed("user_name", "user")
    return filters.validate_posts(dated)


def _by_sentiment(keep) -> Query:
    def run(spark, sf_dir):
        scored = keep(V.scored_posts(spark, sf_dir))
        return rounded(
            scored.select("post_id", "sentiment_label", "sentiment_score"), "sentiment_score"
        )

    return run


QUERIES["filter_by_sentiment"] = _by_sentiment(
    lambda df: filters.filter_by_sentiment(df, "negative", 0.6)
)
QUERIES["positive_posts"] = _by_sentiment(filters.positive_posts)
QUERIES["negative_posts"] = _by_sentiment(filters.negative_posts)
QUERIES["neutral_posts"] = _by_sentiment(
    lambda df: filters.neutral_posts(df, min_confidence=0.0)
)
QUERIES["high_confidence_positive"] = _by_sentiment(filters.high_confidence_positive)
QUERIES["high_confidence_negative"] = _by_sentiment(filters.high_confidence_negative)


# Text functions ------------------------------------------------------------------------------


def _cleaned(cleaner: Callable[[Column], Column]) -> Query:
    def run(spark, sf_dir):
        noisy = V.noisy_posts(spark, sf_dir)
        return noisy.select("post_id", cleaner(F.col("text")).alias("text_cleaned"))

    return run


CLEANERS: dict[str, Callable[[Column], Column]] = {
    "remove_pattern": lambda c: X.remove_pattern(c, "[aeiou]+", "*"),
    "remove_mentions": X.remove_mentions,
    "remove_hashtags": X.remove_hashtags,
    "remove_urls": X.remove_urls,
    "remove_emails": X.remove_emails,
    "remove_numbers": X.remove_numbers,
    "remove_emojis": X.remove_emojis,
    "remove_punctuation": X.remove_punctuation,
    "normalize_whitespace": X.normalize_whitespace,
    "to_lowercase": X.to_lowercase,
    "remove_short_words": lambda c: X.remove_short_words(c, 4),
    "remove_stopwords": X.remove_stopwords,
    "custom_clean": X.create_custom_cleaner(X.to_lowercase, X.remove_mentions, X.remove_urls),
    **{f"clean_{name}": X.chain(*steps) for name, steps in X.CHAINS.items()},
}
QUERIES.update({name: _cleaned(cleaner) for name, cleaner in CLEANERS.items()})


@query
def clean_posts(spark, sf_dir):
    return filters.clean_posts(V.noisy_posts(spark, sf_dir).select("post_id", "text"))


@query
def clean_posts_overwrite(spark, sf_dir):
    noisy = V.noisy_posts(spark, sf_dir).select("post_id", "text")
    return filters.clean_posts(noisy, cleaner=X.aggressive_clean, create_new_column=False)


@query
def clean_with_udf(spark, sf_dir):
    digits = re.compile(r"\d+")
    masked = X.python_cleaner(lambda s: digits.sub("#", s).lower())
    return filters.clean_posts(
        V.noisy_posts(spark, sf_dir).select("post_id", "text"), cleaner=masked
    ).select("post_id", "text_cleaned")


@query
def remove_stopwords_joined(spark, sf_dir):
    """A stop list of any size: here all names of parts' words and the short list."""
    short = spark.createDataFrame([(w,) for w in BASIC_STOPWORDS], "word string")
    names = V.table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    noisy = V.noisy_posts(spark, sf_dir).select("post_id", "text")
    return filters.remove_listed_words(noisy, short.union(names)).select("post_id", "text_cleaned")


@query
def array_flatten(spark, sf_dir):
    sentences = F.transform(F.split("text", r"\."), lambda s: X.words(s))
    posts = V.posts(spark, sf_dir)
    flat = posts.select("post_id", X.flatten_lists(sentences).alias("tokens"))
    return flat.select("post_id", F.array_join("tokens", "|").alias("tokens"))


@query
def array_compact(spark, sf_dir):
    holes = F.transform(X.words("text"), lambda w: F.when(F.length(w) > 3, w))
    full = V.posts(spark, sf_dir).select("post_id", X.drop_nulls(holes).alias("tokens"))
    return full.select("post_id", F.array_join("tokens", "|").alias("tokens"))


@query
def truncate_text(spark, sf_dir):
    posts = V.posts(spark, sf_dir)
    return posts.select("post_id", S.truncate("text").alias("text_truncated"))


# Features ------------------------------------------------------------------------------------


@query
def text_features(spark, sf_dir):
    noisy = V.noisy_posts(spark, sf_dir).select("post_id", "text")
    stats = features.add_text_features(noisy, "text").drop("text")
    return rounded(stats, "text_avg_word_length", "text_uppercase_ratio")


@query
def temporal_features(spark, sf_dir):
    return features.add_time_features(V.text_dates(spark, sf_dir))


@query
def label_encode(spark, sf_dir):
    posts = V.posts(spark, sf_dir).select("post_id", "source_hashtag", "lang")
    return features.encode_labels(posts, ["source_hashtag", "lang", "no_such_column"])[0]


@query
def label_encode_apply(spark, sf_dir):
    """Codes learned from half of the posts, given to all and read back; new values get -1."""
    tag = F.concat_ws("-", "source_hashtag", F.col("n_chars") % 7)
    posts = V.posts(spark, sf_dir).select("post_id", "lang", tag.alias("tag"))
    tables = features.encode_labels(posts.where("post_id % 4 = 1"), ["tag", "lang"])[1]
    coded = features.apply_label_codes(posts, tables, unseen=-1)
    return features.decode_labels(coded, tables)


def _scaled(method: str) -> Query:
    def run(spark, sf_dir):
        posts = V.posts(spark, sf_dir).select("post_id", "likes", "n_chars")
        scaled = features.fit_scaler(posts, ["likes", "n_chars"], method).transform(posts)
        return rounded(scaled, "likes_scaled", "n_chars_scaled")

    return run


QUERIES["scale_standard"] = _scaled("standard")
QUERIES["scale_minmax"] = _scaled("minmax")
QUERIES["scale_robust"] = _scaled("robust")


def _terms(options: dict) -> Query:
    def run(spark, sf_dir):
        posts = V.posts(spark, sf_dir)
        model, vectors = vec.fit_transform(
            posts, "text", keep=["post_id"], stopwords=BASIC_STOPWORDS, **options
        )
        return rounded(model.entries(vectors, ["post_id"]), "value")

    return run


QUERIES["tfidf_terms"] = _terms(vec.TFIDF)
QUERIES["count_terms"] = _terms(vec.COUNTS)
QUERIES["tfidf_basic"] = _terms(vec.BASIC_TFIDF)
QUERIES["tfidf_advanced"] = _terms(vec.ADVANCED_TFIDF)


def _matrix(build) -> Query:
    def run(spark, sf_dir):
        posts = V.dated_posts(spark, sf_dir).select("post_id", "text", "date")
        matrix = build(filters.clean_posts(posts).drop("text"), stopwords=BASIC_STOPWORDS)
        return rounded(matrix.long_form(["post_id"]), "value")

    return run


QUERIES["feature_matrix"] = _matrix(vec.feature_matrix)
QUERIES["sentiment_features"] = _matrix(vec.sentiment_features)
QUERIES["topic_features"] = _matrix(vec.topic_features)


def _scaled_matrix(method: str) -> Query:
    def run(spark, sf_dir):
        posts = V.posts(spark, sf_dir).select("post_id", "text")
        cleaned = store(filters.clean_posts(posts).drop("text"), "cleaned")
        matrix = vec.sentiment_features(cleaned, stopwords=BASIC_STOPWORDS)
        return rounded(vec.fit_matrix_scaler(matrix, method).long_form(matrix, ["post_id"]), "value")

    return run


QUERIES["scale_matrix_standard"] = _scaled_matrix("standard")
QUERIES["scale_matrix_minmax"] = _scaled_matrix("minmax")
QUERIES["scale_matrix_robust"] = _scaled_matrix("robust")


@query
def scale_matrix_full(spark, sf_dir):
    """Every position of every row of a scaled matrix, zeros of the matrix too."""
    posts = V.posts(spark, sf_dir).select("post_id", "text")
    cleaned = store(filters.clean_posts(posts).drop("text"), "cleaned")
    matrix = vec.sentiment_features(cleaned, stopwords=BASIC_STOPWORDS, max_features=100)
    scaled = vec.fit_matrix_scaler(matrix, "standard").transform(matrix)
    return rounded(scaled.long_form(["post_id"]), "value")


# Scoring -------------------------------------------------------------------------------------


def _scores(df: DataFrame) -> DataFrame:
    return rounded(df.select("post_id", *SENTIMENT), *SENTIMENT[1:])


@query
def score_sentiment(spark, sf_dir):
    cleaned = flows.preprocess(V.noisy_posts(spark, sf_dir).select("post_id", "text"))
    return _scores(sent.score_sentiment(cleaned, V.LEXICON))


@query
def score_sentiment_truncated(spark, sf_dir):
    posts = V.posts(spark, sf_dir).select("post_id", "text")
    return _scores(sent.score_sentiment(posts, V.LEXICON, "text", S.MODEL_MAX_CHARS))


@query
def score_sentiment_udf(spark, sf_dir):
    positive = {w for w, p in V.LEXICON if p > 0}
    negative = {w for w, p in V.LEXICON if p < 0}

    def word_list_model():
        def score(texts):
            results = []
            for t in texts:
                found = t.lower().split()
                p, n = sum(w in positive for w in found), sum(w in negative for w in found)
                share = (lambda k: k / (p + n)) if p + n else (lambda k: 0.5)
                results.append(
                    [{"label": "pos", "score": share(p)}, {"label": "neg", "score": share(n)}]
                )
            return results

        return score

    posts = V.posts(spark, sf_dir).select("post_id", "text")
    return _scores(sent.score_with_model(posts, word_list_model, "text"))


@query
def score_sentiment_trained(spark, sf_dir):
    labels = V.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("post_id"), "quality")
    posts = V.posts(spark, sf_dir).select("post_id", "text")
    scorer = sent.train_scorer(posts.join(labels, "post_id"), "quality", "text")
    return _scores(scorer.transform(posts, "text"))


@query
def score_sentiment_hashed(spark, sf_dir):
    labels = V.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("post_id"), "quality")
    posts = V.posts(spark, sf_dir).select("post_id", "text")
    scorer = hashed.train_hashed_scorer(posts.join(labels, "post_id"), "quality", "text")
    return _scores(scorer.transform(posts, "text"))


def _judged(spark, sf_dir, scored: DataFrame) -> DataFrame:
    labels = V.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("post_id"), "quality")
    found = hashed.auc(scored.join(labels, "post_id"), "score", "quality")
    return rounded(found, "auc")


@query
def sentiment_auc(spark, sf_dir):
    """How well the word list's scores tell good posts from bad ones; many scores are tied."""
    scored = V.scored_posts(spark, sf_dir)
    return _judged(spark, sf_dir, scored.select("post_id", F.col("sentiment_positive").alias("score")))


@query
def trained_auc(spark, sf_dir):
    """The same of word shares learned from labelled posts, on the posts that were not learned
    from. A post's score is the difference of its log-likelihoods a word."""
    labels = V.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("post_id"), F.col("quality").cast("string").alias("class")
    )
    posts = V.posts(spark, sf_dir).join(labels, "post_id")
    counted = store(count_terms(posts, "text", (1, 1), (), ["post_id", "class"]), "terms")
    learned = counted.where(f"NOT {HELD_OUT}")
    model = vec.fit_counted(learned, MAX_FEATURES, MIN_DF, MAX_DF, False, (1, 1), ())
    weights = store(topics.class_weights(learned, "class", model.vocabulary), "weights")
    held, parts = counted.where(HELD_OUT).drop("class"), []
    for c in (0, 1):
        one = weights.where(F.col("topic") == c).withColumn("topic", F.lit(0))
        folded = topics.fold_in(held, one, 0).where("words > 0")
        parts.append(
            folded.select("post_id", (F.col("log_likelihood") / F.col("words")).alias(f"l{c}"))
        )
    scored = parts[0].join(parts[1], "post_id")
    return _judged(
        spark, sf_dir, scored.select("post_id", F.round(F.col("l1") - F.col("l0"), 9).alias("score"))
    )


@query
def score_sentiment_joined(spark, sf_dir):
    cleaned = flows.preprocess(V.noisy_posts(spark, sf_dir).select("post_id", "text"))
    return _scores(sent.score_sentiment(cleaned, V.LEXICON, match="join"))


@query
def emotion_labels_joined(spark, sf_dir):
    posts = V.posts(spark, sf_dir).select("post_id", "text")
    return sent.score_emotion(posts, V.EMOTIONS, "text", match="join").drop("text")


@query
def score_sentiment_trained_checks(spark, sf_dir):
    """What holds for every post whatever was learned: one row, a known label, shares of 1."""
    scored = score_sentiment_trained(spark, sf_dir)
    total = F.col("sentiment_positive") + F.col("sentiment_negative")
    larger = F.greatest("sentiment_positive", "sentiment_negative")
    return scored.select(
        "post_id",
        F.col("sentiment_label").isin("POSITIVE", "NEGATIVE").alias("known_label"),
        (F.abs(total - 1) < 1e-5).alias("adds_up"),
        (F.col("sentiment_score") == larger).alias("is_largest"),
    )


@query
def normalize_scores(spark, sf_dir):
    scored = V.scored_posts(spark, sf_dir)

    def item(label: str, score: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.col(score).alias("score"))

    pos, neg = item("pos", "sentiment_positive"), item("Negative", "sentiment_negative")
    neu, star = item("2", "sentiment_neutral"), item("5 stars", "sentiment_score")
    items = (
        F.when(F.col("lang") == "en", F.array(pos, neg, neu))
        .when(F.col("lang") == "fr", F.array(neu, pos))
        .when(F.col("lang") == "de", F.array(star))
        .otherwise(F.array(neg, pos, pos))
    )
    normal = scored.select("post_id", S.sentiment_columns(S.normalize_scores(items)))
    return rounded(normal, *SENTIMENT[1:])


@query
def emotion_labels(spark, sf_dir):
    posts = V.posts(spark, sf_dir).select("post_id", "text")
    return sent.score_emotion(posts, V.EMOTIONS, "text").drop("text")


@query
def emotion_distribution(spark, sf_dir):
    posts = V.posts(spark, sf_dir).select("post_id", "text")
    counts = summary.label_distribution(sent.score_emotion(posts, V.EMOTIONS, "text"), "emotion")
    return rounded(counts, "share")


# Summaries -----------------------------------------------------------------------------------


@query
def dataset_profile(spark, sf_dir):
    return summary.dataset_profile(V.dated_posts(spark, sf_dir), "user_name")


@query
def hashtag_distribution(spark, sf_dir):
    return summary.hashtag_distribution(V.posts(spark, sf_dir))


@query
def sentiment_distribution(spark, sf_dir):
    return rounded(summary.label_distribution(V.scored_posts(spark, sf_dir)), "share")


@query
def distinct_labels(spark, sf_dir):
    return summary.distinct_values(V.scored_posts(spark, sf_dir))


@query
def sentiment_statistics(spark, sf_dir):
    stats = summary.sentiment_statistics(V.scored_posts(spark, sf_dir))
    return rounded(stats, *[c for c in stats.columns if c != "total_posts"])


@query
def confidence_boxstats(spark, sf_dir):
    box = summary.confidence_boxstats(V.scored_posts(spark, sf_dir))
    return rounded(box, "min", "q1", "median", "q3", "max")


def _trends(period: str) -> Query:
    def run(spark, sf_dir):
        trends = summary.sentiment_trends(V.scored_posts(spark, sf_dir), period=period)
        return rounded(trends, *trends.columns[1:])

    return run


QUERIES["sentiment_trends_day"] = _trends("D")
QUERIES["sentiment_trends_week"] = _trends("W")
QUERIES["sentiment_trends_month"] = _trends("M")
QUERIES["sentiment_trends_2w"] = _trends("2W")
QUERIES["sentiment_trends_6h"] = _trends("6H")


@query
def sentiment_timeline(spark, sf_dir):
    return summary.sentiment_timeline(V.scored_posts(spark, sf_dir))


@query
def sentiment_timeline_wide(spark, sf_dir):
    return summary.sentiment_timeline_wide(V.scored_posts(spark, sf_dir))


@query
def top_words(spark, sf_dir):
    cleaned = flows.preprocess(V.noisy_posts(spark, sf_dir).select("post_id", "text"))
    return summary.top_words(cleaned, stopwords=BASIC_STOPWORDS)


@query
def top_words_negative(spark, sf_dir):
    return summary.top_words(V.scored_posts(spark, sf_dir), "text", "negative")


@query
def top_words_by_sentiment(spark, sf_dir):
    return summary.top_words_by_label(V.scored_posts(spark, sf_dir), "text")


@query
def dashboard(spark, sf_dir):
    """Rows of each report table, and the posts that its counts add up to."""
    scored = store(V.scored_posts(spark, sf_dir), "scored")
    parts = []
    for name, table in summary.dashboard(scored, "text").items():
        posts = F.sum("count") if "count" in table.columns and "words" not in name else F.lit(None)
        parts.append(
            table.agg(F.count("*").alias("rows"), posts.cast("bigint").alias("posts")).select(
                F.lit(name).alias("report"), "rows", "posts"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _cube(spark, sf_dir) -> DataFrame:
    return cube.report_cube(V.scored_posts(spark, sf_dir))


@query
def report_cube(spark, sf_dir):
    made = _cube(spark, sf_dir)
    return rounded(made, *[c for c, kind in made.dtypes if kind == "double"])


@query
def report_cube_tables(spark, sf_dir):
    """Values of the report tables, all from one stored cube of two merged halves."""
    scored = V.scored_posts(spark, sf_dir)
    halves = [cube.report_cube(scored.where(F.col("post_id") % 2 == i)) for i in (0, 1)]
    whole = store(cube.merge_cubes(*halves), "cube")
    tables = {
        "distribution": (cube.cube_distribution(whole), F.col("sentiment_label"), ("count", "share")),
        "range": (cube.cube_range(whole), F.col("sentiment_label"), ("min", "max", "count")),
        "statistics": (
            cube.cube_statistics(whole),
            F.lit("all"),
            ("total_posts", "avg_positive", "avg_negative", "mean_confidence", "std_confidence"),
        ),
        "timeline": (
            cube.cube_timeline(whole),
            F.concat_ws(" ", F.col("bucket").cast("string"), "sentiment_label"),
            ("count",),
        ),
        "trends": (
            cube.cube_trends(whole, "W"),
            F.col("bucket").cast("string"),
            ("POSITIVE", "NEGATIVE", "NEUTRAL"),
        ),
    }
    parts = []
    for name, (table, key, measures) in tables.items():
        pairs = [F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in measures]
        parts.append(
            table.select(key.alias("key"), F.explode(F.array(*pairs)).alias("x")).select(
                F.lit(name).alias("report"),
                "key",
                F.col("x.m").alias("measure"),
                F.round("x.v", 6).alias("value"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


@query
def quick_start(spark, sf_dir):
    """Flagship: clean noisy posts, score them, and summarise the confident ones."""
    posts = V.noisy_posts(spark, sf_dir).select("post_id", "text")
    shares = flows.quick_start(posts, lambda df: sent.score_sentiment(df, V.LEXICON))
    return rounded(shares, "share")


@query
def full_flow(spark, sf_dir):
    noisy = V.add_noise(V.dated_posts(spark, sf_dir)).select("post_id", "text", "date")
    scored = flows.full(
        noisy,
        lambda df: sent.score_sentiment(df, V.LEXICON),
        tags=TAGS,
        total=100,
        newest_first=[F.desc("date")],
    )
    return rounded(scored.select("post_id", "source_hashtag", *SENTIMENT), *SENTIMENT[1:])


# Keywords, entities, topics ------------------------------------------------------------------


@query
def keyword_scores(spark, sf_dir):
    posts = V.posts(spark, sf_dir)
    return rounded(keywords.keyword_scores(posts, "text", stopwords=BASIC_STOPWORDS), "score")


@query
def top_keywords(spark, sf_dir):
    posts = V.posts(spark, sf_dir)
    return rounded(keywords.top_keywords(posts, 20, "text", stopwords=BASIC_STOPWORDS), "score")


@query
def entity_counts(spark, sf_dir):
    gazetteer = spark.createDataFrame(V.GAZETTEER, "name string, type string")
    noisy = V.noisy_posts(spark, sf_dir).select("text")
    return entities.entity_counts(filters.clean_posts(noisy, cleaner=X.ner_clean), gazetteer)


@query
def entity_candidates(spark, sf_dir):
    return entities.candidate_counts(V.posts(spark, sf_dir), "text")


@cache
def _topics(spark, sf_dir) -> tuple[topics.TopicModel, DataFrame]:
    """Fitted once for all topic queries of a session."""
    posts = V.posts(spark, sf_dir).select("post_id", "text")
    cleaned = filters.clean_posts(posts, cleaner=X.topic_clean).drop("text")
    return topics.fit_assign(cleaned, keep=["post_id"])


@query
def lda_topics(spark, sf_dir):
    return _topics(spark, sf_dir)[1].select("post_id", "topic")


@query
def topic_top_words(spark, sf_dir):
    return _topics(spark, sf_dir)[0].top_words()


@query
def topic_distribution(spark, sf_dir):
    return topics.topic_distribution(_topics(spark, sf_dir)[1])


@query
def topic_clusters(spark, sf_dir):
    clustered = topics.topic_clusters(_topics(spark, sf_dir)[1])
    return clustered.select("post_id", "topic", "cluster", "x", "y")


@query
def lda_topic_checks(spark, sf_dir):
    """What holds for every post whatever was learned: one row, a topic, weights that add to 1, or
    to 0 where it has no word of the vocabulary."""
    weights = vector_to_array("topic_weights")
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    heaviest = F.get(weights, F.col("topic")) == F.array_max(weights)
    return _topics(spark, sf_dir)[1].select(
        "post_id",
        F.col("topic").between(0, 4).alias("in_range"),
        ((F.abs(total - 1) < 1e-6) | (total == 0)).alias("adds_up"),
        heaviest.alias("is_heaviest"),
    )


@query
def topic_top_words_checks(spark, sf_dir):
    """Ten words of the vocabulary for each topic, by falling weight."""
    model = _topics(spark, sf_dir)[0]
    before = F.lag("weight").over(Window.partitionBy("topic").orderBy("rank"))
    ranked = model.top_words().withColumn("falls", F.coalesce(before >= F.col("weight"), F.lit(True)))
    return ranked.groupBy("topic").agg(
        F.count_distinct("term").alias("terms"), F.bool_and("falls").alias("falls")
    )


@query
def topic_distribution_checks(spark, sf_dir):
    counts = topics.topic_distribution(_topics(spark, sf_dir)[1])
    return counts.agg(F.sum("count").alias("posts"), (F.count("*") <= 5).alias("few_topics"))


@query
def topic_cluster_checks(spark, sf_dir):
    clustered = topics.topic_clusters(_topics(spark, sf_dir)[1])
    return clustered.select(
        "post_id",
        F.col("cluster").between(0, 4).alias("in_range"),
        (~F.isnan("x") & ~F.isnan("y")).alias("placed"),
    )


# Topics whose weights SQL can count too: one for each language, learned from four fifths of the posts.

FOLD_STEPS = 5


def _language_topics(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Stored term counts of all posts, and the topics' stored weights."""
    counted = store(
        count_terms(V.posts(spark, sf_dir), "text", (1, 1), BASIC_STOPWORDS, ["post_id", "lang"]),
        "terms",
    )
    learned = counted.where(f"NOT {HELD_OUT}")
    model = vec.fit_counted(learned, MAX_FEATURES, MIN_DF, MAX_DF, False, (1, 1), BASIC_STOPWORDS)
    return counted, store(topics.class_weights(learned, "lang", model.vocabulary), "weights")


@query
def topic_class_weights(spark, sf_dir):
    return _language_topics(spark, sf_dir)[1].withColumn("weight", F.round("weight", 9))


@query
def topic_perplexity(spark, sf_dir):
    """Perplexity of the posts that the topics were not learned from."""
    counted, weights = _language_topics(spark, sf_dir)
    folded = topics.fold_in(counted.where(HELD_OUT), weights, FOLD_STEPS)
    return topics.perplexity(folded).withColumn("perplexity", F.round("perplexity", 4))


def _shares(spark, sf_dir) -> DataFrame:
    counted, weights = _language_topics(spark, sf_dir)
    return topics.fold_in(counted.drop("lang"), weights, FOLD_STEPS)


@query
def topic_shares(spark, sf_dir):
    shares = F.posexplode("topic_weights").alias("topic", "share")
    return rounded(_shares(spark, sf_dir).select("post_id", "words", shares), "share")


@query
def topic_points(spark, sf_dir):
    """Posts along the two principal axes of their topic shares."""
    stored = store(_shares(spark, sf_dir).select("post_id", "topic_weights"), "shares")
    points = topics.topic_points(stored, size=4)
    return rounded(points.select("post_id", "x", "y"), "x", "y")


@query
def topic_point_clusters(spark, sf_dir):
    """Clusters of the (rounded) points of ``topic_points``, and their centres."""
    stored = store(_shares(spark, sf_dir).select("post_id", "topic_weights"), "shares")
    points = topics.topic_points(stored, size=4).select(
        "post_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y")
    )
    clustered, _ = topics.cluster_points(store(points, "points"), 4)
    sums = clustered.groupBy("cluster").agg(
        F.count("*").alias("posts"), F.avg("x").alias("x"), F.avg("y").alias("y")
    )
    return rounded(sums, "x", "y")
