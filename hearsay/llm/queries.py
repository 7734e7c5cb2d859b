"""One registered query for each operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.operators.scratch import store

from . import (
    alignment,
    decontamination,
    embeddings,
    filter_audit,
    hnsw,
    html_text,
    language,
    licences,
    lm_scoring,
    mixing,
    quality,
    sharding,
    simhash,
)
from .common import fold

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    LLM_QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)


@query
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 4) == 2
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    labels = table(spark, sf_dir, "labels")
    return quality.score_quality(docs, labels, ~F.col("held_out"), keep=("held_out",))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        mixing.word_count("text").alias("size"),
        mixing.row_hash("doc_id", "text").alias("h"),
    )
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixing.mix(store(sized, "sizes")).select(
        "doc_id", "size", "source_size", "target", taken
    )


# The same mix as one statement: sources fill in the order of size over weight, so a source is
# full if it would be over its limit when the sources before it are.
LLM_ORACLES["op5_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substring(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))),
                            1, 15))::BIGINT AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
              WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER before, 0) AS used,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS share
  FROM sources
  WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (
  SELECT *, (total - used) * weight > 3 * source_size * share AS over FROM filled),
ends AS (
  SELECT total - coalesce(sum(3 * source_size) FILTER (over) OVER (), 0) AS remaining,
         sum(weight) OVER () - coalesce(sum(weight) FILTER (over) OVER (), 0) AS share_left, *
  FROM marked),
targets AS (
  SELECT source, source_size,
         CASE WHEN over THEN (3 * source_size)::DOUBLE
              ELSE (remaining * weight)::DOUBLE / share_left::DOUBLE END AS target
  FROM ends),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
  FROM targets),
hashes AS (
  SELECT source, h, sum(size) AS size,
         sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto
  FROM sized GROUP BY source, h),
chosen AS (
  SELECT k.source, k.h,
         CASE WHEN b.source_size = 0 THEN FALSE
              WHEN k.upto <= b.target - b.whole * b.source_size THEN TRUE
              WHEN k.upto - k.size <= b.target - b.whole * b.source_size
              THEN (b.target - b.whole * b.source_size) - (k.upto - k.size)
                   > k.upto - (b.target - b.whole * b.source_size)
              ELSE FALSE END AS more
  FROM hashes k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source)
SELECT s.doc_id, s.size, b.source_size, b.target,
       (s.size * (b.whole + c.more::INT))::BIGINT AS taken
FROM sized s
JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
JOIN chosen c ON s.source IS NOT DISTINCT FROM c.source AND s.h = c.h
"""


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


LLM_ORACLES["op6_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n,
         array_to_string(w[i + 1:i + 10], ' ') AS terms
  FROM b, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
runs AS (
  SELECT rid, i AS start, n, array_to_string(w[i + 1:i + n], ' ') AS terms
  FROM d, sizes, unnest(range(0, len(w) - n + 1)) AS r(i)),
found AS (SELECT rid, start, n, item FROM runs JOIN windows USING (n, terms)),
hit AS (
  SELECT rid, count(DISTINCT start + k) AS n_hit
  FROM (SELECT DISTINCT rid, start, n FROM found), unnest(range(0, n)) AS r(k) GROUP BY rid),
named AS (
  SELECT rid, count(DISTINCT item) AS n_items,
         string_agg(DISTINCT item, ',' ORDER BY item) AS items
  FROM found GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""


@query
def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.best_licence(licences.scan(table(spark, sf_dir, "documents")))


@query
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@query
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


LLM_ORACLES["op9_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
         sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm
  FROM embeddings WHERE embedding IS NOT NULL),
usable AS (SELECT * FROM v WHERE norm > 0 AND isfinite(norm)),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.label = b.label AND a.vec_id <> b.vec_id
     AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach AS (
  SELECT vec_id AS node, vec_id AS other FROM embeddings
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id)::BIGINT AS n_links,
       min(r.other) AS component_id, e.vec_id = min(r.other) AS kept
FROM embeddings e JOIN reach r ON r.node = e.vec_id GROUP BY e.vec_id
"""


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 4) == 2
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    model = language.train(docs, "text", "lang", ~F.col("held_out"))
    return language.predict(docs, model, keep=("doc_id", "held_out")).drop("fit")


@query
def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        "n_best",
        "count_sum",
        "groups_sha256",
    )


@query
def op12_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


LLM_ORACLES["op13_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
  FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         concat(CASE WHEN len(w) < 200 THEN 'A' END,
                CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
                CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t)
                     THEN 'C' END,
                CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
                CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 'E' END) AS fails
  FROM d LEFT JOIN marks USING (doc_id)),
counts AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM failed GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT *, left(filter_order, k - 1) AS before, filter_order[k] AS own
  FROM orders, unnest(range(1, 6)) AS r(k)),
rows AS (
  SELECT part, filter_order, k, own,
         coalesce(sum(n) FILTER (translate(fails, before || own, '') = fails), 0) AS kept,
         coalesce(sum(n) FILTER (contains(fails, own) AND translate(fails, before, '') = fails),
                  0) AS removed,
         coalesce(sum(n) FILTER (contains(fails, own) AND translate(fails, before, '') <> fails),
                  0) AS redundant,
         coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
         coalesce(sum(good) FILTER (contains(fails, own) AND translate(fails, before, '') = fails),
                  0) AS good_lost,
         coalesce(sum(toxic) FILTER (contains(fails, own) AND translate(fails, before, '') = fails),
                  0) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, k, own)
SELECT part, filter_order, k::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM rows
"""
