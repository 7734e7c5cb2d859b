from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearsay.llm import language
from hearsay.llm.queries import LLM_QUERIES

from .helpers import DOC, documents

LETTERS = language._letters()


def plain_codes(text):
    out = " "
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or out[-1] != " ":
            out += c
    return out if out[-1] == " " else out + " "


@pytest.mark.parametrize("text", ["", "a", "Ab  c", "É!1é", "日本 😀x", " - ", "a\n\nb"])
def test_codes(text):
    codes, any_letter = language.character_codes(text.encode(), LETTERS)
    assert "".join(map(chr, codes)) == plain_codes(text)
    assert any_letter == any(c.isalpha() for c in text)


def test_buckets_do_not_depend_on_pieces(monkeypatch):
    codes = np.arange(60, 160, dtype=np.uint32) % 7
    whole = np.sort(np.concatenate(list(language.buckets(codes))))
    assert len(whole) == 100 + 99 + 98
    monkeypatch.setattr(language, "CHUNK", 9)
    assert (np.sort(np.concatenate(list(language.buckets(codes)))) == whole).all()


def test_posterior_by_hand(spark):
    rows = [
        (1, "the cat", "en", "s", 0), (2, "der hund", "de", "s", 0), (3, "the the", "en", "s", 0),
        (4, None, "en", "s", 0), (5, "x", None, "s", 0), (6, "12 !", "de", "s", 0),
    ]
    docs = spark.createDataFrame(rows, DOC).withColumn("score", F.lit("clash"))
    model = language.train(docs, "text", "lang", F.lit(True), bits=10)
    assert model.languages == ["de", "en"]
    assert np.exp(model.log_prior).tolist() == pytest.approx([0.4, 0.6])
    assert np.exp(model.log_likelihood).sum(0) == pytest.approx([1, 1], rel=1e-4)
    got = {r["doc_id"]: r for r in language.predict(docs, model, keep=("doc_id",)).collect()}
    for i, text, *_ in rows:
        if text is None or not any(c.isalpha() for c in text):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        codes, _ = language.character_codes(text.encode(), LETTERS)
        total = model.log_prior.copy()
        for b in np.concatenate(list(language.buckets(codes, 10))):
            total += model.log_likelihood[b]
        share = np.exp(total) / np.exp(total).sum()
        assert got[i]["lang_pred"] == model.languages[share.argmax()]
        assert got[i]["score"] == pytest.approx(share.max(), rel=1e-6)


def test_nothing_learned(spark):
    docs = documents(spark, ["abc", "12", None, ""]).withColumn("lang", F.lit(None).cast("string"))
    model = language.train(docs, "text", "lang", F.lit(True))
    got = language.predict(docs, model, keep=("doc_id",)).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    assert [r["doc_id"] for r in language.keep_known(docs).collect()] == [0]
    assert language.keep_known(docs.limit(0)).count() == 0


def test_keep_known(spark):
    docs = documents(spark, ["the cat sat", "99", None, "a dog ran"]).withColumn("score", F.lit(1))
    kept = language.keep_known(docs.withColumn("lang_pred", F.lit("x")))
    assert kept.columns == [*docs.columns, "lang_pred"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3]


def test_keep_known_rejects_what_fits_no_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = [
        "Привет, как дела? Сегодня хорошая погода.", "今日は天気がいいですね。", "Ελληνικά",
        "sdkjfh qwrtzx lkjhgf mnbvcx asdlkj", "xkcd zzqj vvkw " * 2000, "مرحبا بالعالم",
    ]
    more = documents(spark, [*odd, "The cat sat on the mat.", "la casa de la"])
    more = more.withColumns({"doc_id": F.col("doc_id") + 10_000_000, "lang": F.lit(None).cast("string")})
    kept = language.keep_known(docs.union(more))
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert sorted(i - 10_000_000 for i in ids if i >= 10_000_000) == [6, 7]
    with_letter = docs.where(F.col("text").rlike(r"\p{L}"))
    assert kept.where("doc_id < 10000000").count() == with_letter.count()


def test_fit_does_not_grow_with_the_text(spark):
    docs = documents(spark, ["a b c", "a b c " * 50, "q"])
    model = language.train(docs.where("doc_id < 2"), "text", "lang", F.lit(True))
    fits = [r["fit"] for r in language.predict(docs, model, keep=("doc_id",)).sort("doc_id").collect()]
    assert 0 < fits[1] < 2 * fits[0] and fits[2] < fits[0]


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = LLM_QUERIES["op10_language_id"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    right = (F.col("lang") == F.col("lang_pred")).cast("int")
    held = got.where("held_out").join(docs, "doc_id").agg(F.avg(right), F.count("*")).first()
    assert held[0] > 0.98 and held[1] > 150
