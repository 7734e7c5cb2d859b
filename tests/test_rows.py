"""Sources, filters, dedup, quotas, samples and joins."""

from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from hearsay.operators import entities, filters, topn
from hearsay.operators.dedup import dedup_posts
from hearsay.operators.entities import entity_counts
from hearsay.operators.filters import coerce_dates
from hearsay.operators.joins import fits_broadcast, lookup_join
from hearsay.operators.scratch import new_path, shared_dir
from hearsay.operators.topn import first_per_group, sample_rows
from hearsay.plans import flows
from hearsay.schema import POST, RAW_POST
from hearsay.sources import files
from hearsay.sources import posts as src

HARD_POSTS = [
    ('say "hi", ok', "2024-01-06 10:00:00", "Ann", "ann", 1, 2, 3, "layoffs", "http://x"),
    ("line one\nline two\n", "bad date", "Bo", "bo", 0, 0, 0, "jobcuts", ""),
    ("  spaces kept  ", None, None, "c", None, 0, 0, "x", "u"),
    ("tab\tback\\slash 日本 😀", "", "D", "d", 5, 0, 0, "x", "u,v"),
    ("NA", "null", "nan", "None", 7, 0, 0, "x", "u"),
]


def hard_posts(spark):
    return spark.createDataFrame(HARD_POSTS, POST)


def empty_to_null(rows):
    return {tuple(None if v == "" else v for v in r) for r in rows}


def test_csv_roundtrip_keeps_text(spark):
    path = new_path(spark, "csv")
    files.write_csv(hard_posts(spark), path)
    got = files.read_csv(spark, path)
    assert got.schema == POST
    assert {tuple(r) for r in got.collect()} == empty_to_null(HARD_POSTS)


def test_json_roundtrip_keeps_nulls(spark):
    path = new_path(spark, "json")
    files.write_json(hard_posts(spark), path)
    assert {tuple(r) for r in files.read_json(spark, path).collect()} == set(HARD_POSTS)
    assert '"user":null' in "".join(r[0] for r in spark.read.text(path).collect())


def test_load_or_create(spark):
    path = new_path(spark, "posts")
    assert files.load_or_create(spark, path).count() == 0
    made = files.load_or_create(spark, path, lambda: hard_posts(spark))
    assert made.count() == len(HARD_POSTS)

    def fail():
        raise AssertionError("must not be built again")

    assert files.load_or_create(spark, path, fail).count() == len(HARD_POSTS)


def test_configured_folder_is_used():
    class Session:
        conf = {"spark.checkpoint.dir": "/some/shared/folder"}

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    assert shared_dir(Session) == "/some/shared/folder"


def test_a_cluster_needs_a_shared_folder():
    class Session:
        conf = {}

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def test_csv_goes_by_name(spark, tmp_path):
    path = tmp_path / "posts.csv"
    path.write_text('url,extra,text,date,user,likes\nu1,e1,"a, b",2024-01-01,me,3\nu2,,x,d,you,many\n')
    got = files.read_csv(spark, str(path))
    assert got.columns == [*POST.fieldNames(), "extra"]
    first, second = got.orderBy("url").collect()
    assert (first["text"], first["likes"], first["url"], first["extra"]) == ("a, b", 3, "u1", "e1")
    assert (second["likes"], second["extra"], second["username"]) == (None, None, None)
    path.write_text("url,date,user\nu,d,me\n")
    with pytest.raises(ValueError, match="text"):
        files.read_csv(spark, str(path))


def test_csv_without_line_breaks_can_be_split(spark, tmp_path):
    path = tmp_path / "posts.csv"
    path.write_text("text,date,user\na,b,c\n")
    assert files.read_csv(spark, str(path), multi_line=False).first()["text"] == "a"


def test_bad_json_lines_are_not_hidden(spark, tmp_path):
    path = tmp_path / "posts.json"
    path.write_text('{"text": "a"}\n{"text": \n')
    with pytest.raises(Exception):
        files.read_json(spark, str(path)).collect()
    with pytest.raises(Exception):
        src.read_raw(spark, str(path)).collect()
    kept = src.read_raw(spark, str(path), mode="DROPMALFORMED").collect()
    assert [r["text"] for r in kept] == ["a"]


def test_dedup_takes_any_order(spark):
    rows = [(1, "a", 5), (2, "a", 9), (3, "a", 9), (4, None, 1), (5, None, 2), (6, "b", 0)]
    df = spark.createDataFrame(rows, "post_id bigint, text string, n int").repartition(3)
    newest = dedup_posts(df, [F.desc("n")])
    assert newest.columns == df.columns
    assert sorted(r["post_id"] for r in newest.collect()) == [2, 5, 6]
    assert sorted(r["post_id"] for r in dedup_posts(df, []).collect()) == [1, 4, 6]


def test_large_quota_is_still_trimmed_early(spark):
    df = spark.range(20_000).select(F.col("id").alias("post_id"), F.concat(F.lit("t"), F.col("id") % 2).alias("source_hashtag"))
    taken = src.hashtag_quota(df, [F.col("post_id")], 10_000, ["t0", "t1"])
    assert taken.count() == 10_000
    plan = taken._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Jan 5, 2024", "2024-01-05 00:00:00"),
        ("01/05/2024", "2024-01-05 00:00:00"),
        ("Mon, 01 Jan 2024 10:00:00 +0200", "2024-01-01 08:00:00"),
        ("Mar 31, 2023 · 5:23 PM UTC", "2023-03-31 17:23:00"),
        ("2024-01-31T23:00:00-08:00", "2024-02-01 07:00:00"),
        ("2024-01-31T23:00:00Z", "2024-01-31 23:00:00"),
        ("2024-01-31 23:00:00.25+01:00", "2024-01-31 22:00:00.250000"),
        ("2024-01-31", "2024-01-31 00:00:00"),
        ("2024/01/05", "2024-01-05 00:00:00"),
        ("2024/1/5 13:04:05", "2024-01-05 13:04:05"),
        ("2024.01.05 3:04", "2024-01-05 03:04:00"),
        ("20240105", "2024-01-05 00:00:00"),
        ("20240105T130405", "2024-01-05 13:04:05"),
        ("202401051304", "2024-01-05 13:04:00"),
        ("13/05/2024", "2024-05-13 00:00:00"),
        ("05-13-2024", "2024-05-13 00:00:00"),
        ("1/5/2024 3:04 PM", "2024-01-05 15:04:00"),
        ("1/5/2024 12:04 am", "2024-01-05 00:04:00"),
        ("1/5/2024 12:04 p.m.", "2024-01-05 12:04:00"),
        ("05.01.2024 13:04", "2024-01-05 13:04:00"),
        ("January 5 2024", "2024-01-05 00:00:00"),
        ("Sept 5th, 2024 at 3pm", "2024-09-05 15:00:00"),
        ("5 January 2024", "2024-01-05 00:00:00"),
        ("5th of DECEMBER, 2024 13:04:05.25", "2024-12-05 13:04:05.250000"),
        ("05-Jan-2024", "2024-01-05 00:00:00"),
        ("2024 Feb 5", "2024-02-05 00:00:00"),
        ("Fri Jan 05 13:04:05 +0200 2024", "2024-01-05 11:04:05"),
        ("1704459845", "2024-01-05 13:04:05"),
        ("1704459845.5", "2024-01-05 13:04:05.500000"),
        ("1704459845000", "2024-01-05 13:04:05"),
        ("1704459845000001", "2024-01-05 13:04:05.000001"),
        ("1704459845000001999", "2024-01-05 13:04:05.000001"),
        ("2024-01-05T13:04:05.123456789Z", "2024-01-05 13:04:05.123456"),
        ("2024", "2024-01-01 00:00:00"),
        ("2024-02-30", None),
        ("13/13/2024", None),
        ("1/5/2024 13:04 PM", None),
        ("5 Foo 2024", None),
        ("20241305", None),
        ("12345", None),
        ("10:30", None),
        ("garbage", None),
        ("", None),
        (None, None),
    ],
)
def test_everyday_dates(spark, text, expected):
    df = spark.createDataFrame([(text,)], "date string")
    got = coerce_dates(df).first()["date"]
    assert (None if got is None else str(got)) == expected


def test_day_first_and_numbers(spark):
    df = spark.createDataFrame([("05/01/2024",), ("05/13/2024",), ("13-05-2024",)], "date string")
    got = [str(r["date"])[:10] for r in coerce_dates(df, day_first=True).collect()]
    assert got == ["2024-01-05", "2024-05-13", "2024-05-13"]
    moment = dt.datetime(2024, 1, 5, 13, 4, 5)
    for kind, value in (("bigint", 1704459845), ("bigint", 1704459845000), ("double", 1704459845.0)):
        df = spark.createDataFrame([(value,), (None,)], f"date {kind}")
        assert [r["date"] for r in coerce_dates(df).collect()] == [moment, None]


def test_epochs_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = spark.createDataFrame([("1704459845",), ("2024-01-05 13:04:05 UTC",)], "date string")
        got = coerce_dates(df).select(F.col("date").cast("string")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r[0] for r in got] == ["2024-01-05 13:04:05"] * 2


def test_names_are_found_by_words(spark):
    text = "Yesterday Amazon and IBM cut jobs, PayPal and LinkedIn too. Amazon again; amazon, New York Times"
    names = ["Amazon", "IBM", "PayPal", "LinkedIn", "New York", "New York Times", "York"]
    table = spark.createDataFrame([(n, "ORG") for n in names], "name string, type string")
    df = spark.createDataFrame([(text,), (None,), ("",)], "text_cleaned string")
    got = {r["name"]: r["count"] for r in entity_counts(df, table).collect()}
    assert got == {"Amazon": 2, "IBM": 1, "PayPal": 1, "LinkedIn": 1, "New York Times": 1}
    assert entity_counts(df, table.limit(0)).count() == 0


def test_names_share_first_words(spark):
    names = ["New", "New York", "New York Times", "New Zealand All Blacks", "York Times", "All"]
    table = spark.createDataFrame([(n, "X") for n in names], "name string, type string")
    texts = ["New York Times New Zealand All Black New", "All Blacks York Times New York", "new york"]
    df = spark.createDataFrame([(t,) for t in texts], "text_cleaned string")
    got = {r["name"]: r["count"] for r in entity_counts(df, table).collect()}
    assert got == {"New York Times": 1, "New": 2, "All": 2, "York Times": 1, "New York": 1}


def test_only_first_words_are_extended(spark):
    """Runs before the join: one for each length that names with that first word have."""
    words = [f"w{i}" for i in range(500)]
    posts = spark.createDataFrame([(i, words) for i in range(4)], "_row bigint, _w array<string>")
    names = ["w7 w8 w9 w10 w11 w12", "w7 w8", "w100", "w499 w500", "w3 x"]
    known = spark.createDataFrame([(n,) for n in names], "_run string")
    firsts = entities._first_words(known)
    runs = entities.name_runs(posts, firsts, 6).where("_row = 0").collect()
    assert sorted(r["_run"] for r in runs) == ["w100", "w3 w4", "w7 w8", "w7 w8 w9 w10 w11 w12"]
    plan = entities.name_runs(posts, firsts, 6)._jdf.queryExecution().executedPlan().toString()
    # Past the first generator only the words ahead go on, not the text.
    assert "_w#" not in plan.split("Generate posexplode")[0]


def test_a_million_names(spark):
    first, last = F.concat(F.lit("F"), F.col("id") % 1000), F.concat(F.lit("L"), F.col("id"))
    names = spark.range(1_000_000).select(F.concat_ws(" ", first, last).alias("name"), F.lit("P").alias("type"))
    texts = ["F5 L5 and F7 L1007, F7 L1008 or F999 L999999", "F5 L5", "L5 F5"]
    df = spark.createDataFrame([(t,) for t in texts], "text_cleaned string")
    got = {r["name"]: r["count"] for r in entity_counts(df, names).collect()}
    assert got == {"F5 L5": 2, "F7 L1007": 1, "F999 L999999": 1}


def test_listed_words_joined_and_inline(spark):
    texts = ["The cat  sat\ton THE mat", "the the", "", None, "  ", "Élan vital", "a b c a"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    df = df.withColumn("_word", F.lit("clash"))
    listed = spark.createDataFrame([("the",), ("ON",), ("élan",), ("a",), (None,), ("a",)], "w string")
    out = {}
    for match in ("inline", "join"):
        rows = filters.remove_listed_words(df, listed, match=match)
        assert rows.columns == ["id", "text", "_word", "text_cleaned"]
        out[match] = {r["id"]: r["text_cleaned"] for r in rows.collect()}
    want = ["cat sat mat", "", "", None, "", "vital", "b c"] * 3
    assert out["inline"] == out["join"] == dict(enumerate(want))
    same = filters.remove_listed_words(df, listed.limit(0), output="text", match="join")
    assert same.columns == ["id", "_word", "text"] and same.count() == len(texts)
    with pytest.raises(ValueError):
        filters.remove_listed_words(df, listed, match="other")


def test_a_hundred_thousand_listed_words(spark):
    listed = spark.range(100_000).select(F.concat(F.lit("w"), F.col("id")).alias("w"))
    words = " ".join(f"W{i} keep{i}" for i in range(0, 100_000, 1000))
    df = spark.createDataFrame([(1, words), (2, "w5 " * 2000 + "end")], "id int, text string")
    with pytest.raises(ValueError):
        filters.remove_listed_words(df, listed, match="inline")
    got = {r["id"]: r["text_cleaned"] for r in filters.remove_listed_words(df, listed).collect()}
    assert got == {1: " ".join(f"keep{i}" for i in range(0, 100_000, 1000)), 2: "end"}


def test_flatten_defaults(spark):
    raw = spark.createDataFrame(
        [("t", "d", ("n", "u"), (1, 2, 3), "tag", "url"), (None,) * 6, ("x", None, (None, "u"), None, None, None)],
        RAW_POST,
    )
    flat = src.flatten_posts(raw)
    assert flat.columns == POST.fieldNames()
    assert [tuple(r) for r in flat.collect()] == [
        ("t", "d", "n", "u", 1, 2, 3, "tag", "url"),
        ("", "", "", "", 0, 0, 0, "", ""),
        ("x", "", "", "u", 0, 0, 0, "", ""),
    ]


def test_selectors(texts):
    df = texts(["#Layoffs now", "layoffs #layoffs2", "x#LAYOFFS!", None, "a 100% Layoff_s"])
    by_tag = src.post_selector("hashtag")(df, "layoffs")
    assert sorted(r["id"] for r in by_tag.collect()) == [0, 2]
    by_word = src.post_selector("keyword")(df, "LAYOFF_")
    assert [r["id"] for r in by_word.collect()] == [4]
    with pytest.raises(ValueError):
        src.post_selector("other")


def test_union_by_tag(texts):
    both = src.union_by_tag({"a": texts(["x"]), "b": texts(["y", "z"])})
    assert sorted((r["text"], r["source_hashtag"]) for r in both.collect()) == [
        ("x", "a"), ("y", "b"), ("z", "b")
    ]


def skewed(spark, n=4000):
    """A third of the rows share one tag and one text."""
    return spark.range(n).select(
        F.col("id").alias("post_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("tag"),
        F.when(F.col("id") % 3 == 0, "same").otherwise((F.col("id") % 700).cast("string")).alias("text"),
    )


@pytest.mark.parametrize("n", [3, 1001])
def test_first_per_group_matches_brute_force(spark, n):
    df = skewed(spark)
    got = first_per_group(df, "tag", [F.desc("post_id")], n, ["post_id"])
    groups = {}
    for r in df.collect():
        groups.setdefault(r["tag"], []).append(r["post_id"])
    want = {i for ids in groups.values() for i in sorted(ids, reverse=True)[:n]}
    assert {r["post_id"] for r in got.collect()} == want


def test_quota_drops_the_remainder(spark):
    df = skewed(spark).withColumnRenamed("tag", "source_hashtag")
    got = src.hashtag_quota(df, [F.col("post_id")], 10, ("hot", "t1", "t2"))
    counts = {r["source_hashtag"]: r["count"] for r in got.groupBy("source_hashtag").count().collect()}
    assert counts == {"hot": 3, "t1": 3, "t2": 3}
    layoffs = src.layoff_posts(df.withColumn("source_hashtag", F.lit("layoffs")), [F.col("post_id")])
    assert layoffs.count() == 1000


@pytest.mark.parametrize("partitions", [1, 7])
def test_dedup_keeps_first_and_is_idempotent(spark, partitions):
    df = skewed(spark).withColumn("text", F.when(F.col("post_id") % 5 > 0, F.col("text")))
    got = dedup_posts(df.repartition(partitions), ["post_id"])
    first = {}
    for r in sorted(df.collect()):
        first.setdefault(r["text"], r["post_id"])
    assert {(r["text"], r["post_id"]) for r in got.collect()} == set(first.items())
    assert got.columns == df.columns
    assert dedup_posts(got, ["post_id"]).count() == len(first)


@pytest.mark.parametrize("hex_digits", [5, 1])
@pytest.mark.parametrize("n", [0, 1, 100, 3999, 4000, 9999])
def test_sample_is_exact(spark, monkeypatch, n, hex_digits):
    monkeypatch.setattr(topn, "HEX_DIGITS", hex_digits)
    df = skewed(spark).repartition(5)
    got = [r["post_id"] for r in sample_rows(df, "post_id", n, 7).collect()]
    ranked = sorted(range(4000), key=lambda i: (hashlib.md5(f"{i}7".encode()).hexdigest(), i))
    assert sorted(got) == sorted(ranked[:n])


@pytest.mark.parametrize("max_rows", [1000, 3])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_broadcast_and_salted_agree(spark, max_rows, how):
    df = skewed(spark)
    table = spark.createDataFrame([("hot", 1), ("t1", 2), ("t2", 3), ("zz", 4)], "tag string, v int")
    assert fits_broadcast(table, max_rows) == (max_rows == 1000)
    got = lookup_join(df, table, "tag", ["post_id"], how, max_rows)
    want = df.join(table, "tag", how)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_date_filter_bounds(spark):
    dates = ["2024-01-05", "2024-01-04 23:59:59", "2024-01-20 00:00:00", "2024-01-20 00:00:01", "bad", None]
    df = spark.createDataFrame([(d,) for d in dates], "date string")
    got = filters.filter_by_date(df, "2024-01-05", "2024-01-20").collect()
    assert sorted(r["date"] for r in got) == [dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20)]
    assert filters.filter_by_date(df).count() == len(dates)
    assert filters.filter_by_date(df, end_date="2024-01-04").count() == 0
    no_date = df.withColumnRenamed("date", "other")
    assert filters.filter_by_date(no_date, "2024-01-05").count() == len(dates)


def test_day_partitions_are_pruned(spark):
    path = new_path(spark, "days")
    dates = [f"2024-01-{d:02d} 12:00:00" for d in range(1, 10)] + ["bad", None]
    df = spark.createDataFrame([(d,) for d in dates], "date string")
    files.write_by_day(df, path)
    stored = spark.read.parquet(path)
    got = filters.filter_by_date(stored, "2024-01-03", "2024-01-05", day_column="day")
    assert sorted(r["date"].day for r in got.collect()) == [3, 4]
    text = got._jdf.queryExecution().executedPlan().toString()
    pruned = text[text.index("PartitionFilters") :].splitlines()[0]
    assert "day#" in pruned.split("PushedFilters")[0]
    assert filters.filter_by_date(stored, day_column="day").count() == len(dates)


def test_extra_date_formats(spark):
    df = spark.createDataFrame([("06/01/2024 10:30",), ("x",)], "date string")
    got = filters.coerce_dates(df, formats=["dd/MM/yyyy HH:mm"]).collect()
    assert [r["date"] for r in got] == [dt.datetime(2024, 1, 6, 10, 30), None]


@pytest.mark.parametrize(
    "values, valid",
    [(["a", None], True), ([None, None], False), ([" ", " "], False), ([" ", None], True), ([], False)],
)
def test_validate(spark, values, valid):
    df = spark.createDataFrame([(v, "d", "u") for v in values], "text string, date string, user string")
    row = filters.validate_posts(df).first()
    assert (row["is_valid"], row["total_rows"], row["missing_columns"]) == (valid, len(values), "")
    missing = filters.validate_posts(df.drop("user", "text")).first()
    assert (missing["is_valid"], missing["missing_columns"]) == (False, "text,user")


def test_filter_by_sentiment(spark):
    df = spark.createDataFrame(
        [("POSITIVE", 0.5), ("POSITIVE", 0.49), ("NEGATIVE", 0.9), (None, 1.0)],
        "sentiment_label string, sentiment_score double",
    )
    assert filters.positive_posts(df).count() == 1
    assert filters.filter_by_sentiment(df, "negative", 0.9).count() == 1
    assert filters.filter_by_sentiment(df.drop("sentiment_score"), "positive").count() == 2
    assert filters.high_confidence_positive(df).count() == 0


def test_collect_flow_keeps_text_under_first_tag(spark):
    rows = [(1, "#b #a same"), (2, "#b only"), (3, "#b #a same"), (4, "none")]
    df = spark.createDataFrame(rows, "post_id bigint, text string")
    got = flows.collect(df, ("A", "b"), 10)
    assert sorted((r["post_id"], r["source_hashtag"]) for r in got.collect()) == [(1, "a"), (2, "b")]


def test_words_that_stay_are_not_gathered(spark):
    """Positions of listed words are; repeated words and keys, and odd texts come out the same."""
    rows = [(1, "The cat The  mat"), (1, "The cat The  mat"), (None, "the"), (2, None), (3, ""), (4, " a\tb a ")]
    df = spark.createDataFrame(rows, "id int, text string")
    listed = spark.createDataFrame([("the",), ("B",), (None,)], "w string")
    joined = filters.remove_listed_words(df, listed)
    inline = filters.remove_listed_words(df, listed, match="inline")
    key = lambda r: str(tuple(r))
    assert sorted(joined.collect(), key=key) == sorted(inline.collect(), key=key)
    gathered = [f.dataType for f in _collected(joined)]
    assert gathered == ["array<int>"]


def _collected(df):
    """Columns gathered by ``collect_list`` in the plan of ``df``."""
    from types import SimpleNamespace

    found, plans = [], [df._jdf.queryExecution().optimizedPlan()]
    while plans:
        plan = plans.pop()
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
        if plan.nodeName() == "Aggregate" and "collect_list" in plan.toString().splitlines()[0]:
            out = plan.output()
            types = [out.apply(i).dataType().simpleString() for i in range(out.size())]
            found += [SimpleNamespace(dataType=t) for t in types if t.startswith("array")]
    return found
