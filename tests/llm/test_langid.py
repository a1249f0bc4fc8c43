"""op5: held-out accuracy on the given tables, edge rows, rejection."""

import os
import zlib

import pytest
from pyspark.sql import functions as F

from aerolith.llm import langid

SF = "/root/testdata/sf0.01"


def test_edge_rows(spark):
    rows = [(i, t * 30, "en" if t[0] == "t" else "fr") for i, t in enumerate(["the cat is here and there ", "le chat est ici et voilà "] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, None, "x"), (None, "", None), (3, "12 34!! \n", "en"), (4, "the cat is there", None), (4, "the cat is there", None), (5, "voilà le chat " * 30000, "fr")], "doc_id long, text string, lang_pred string")
    got = [tuple(r) for r in odd.select("doc_id", langid.predictor(model)("text").alias("p")).select("doc_id", "p.*").collect()]
    assert [g[1] for g in got] == ["und", "und", "und", "en", "en", "fr"]
    assert got[0][2] == 0 and got[0][3] and all(0 <= g[2] <= 1 for g in got)


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    model = langid.fit(empty)
    assert empty.select(langid.predictor(model)("text")).collect() == []
    one = spark.createDataFrame([("abc",)], "text string")
    assert one.select(langid.predictor(model)("text").alias("p")).first()[0][0] == "und"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_held_out_accuracy(spark):
    got = langid.op5_language_id(spark, SF).collect()
    lang = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(got) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert sum(r["rejected"] for r in got) <= 0.01 * len(got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_foreign_texts_are_rejected_and_own_ones_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    foreign = [
        "Tämä on suomenkielinen lause, jossa puhutaan säästä ja ihmisistä kaupungissa.",
        "To jest polskie zdanie o pogodzie i ludziach w mieście, którzy rozmawiają.",
        "Bu şehirde yaşayan insanlar hakkında Türkçe bir cümledir ve uzundur.",
        "qzx wvk jjq xkcd zzq wvx kqj pfft grx",
        "Это русский текст о погоде",
        "这是中文文本",
    ]
    got = spark.createDataFrame([(t,) for t in foreign], "text string").select(langid.predictor(model)("text").rejected).collect()
    assert all(r[0] for r in got)
    for out in ("de", "en"):  # a language that the model has not seen, against those it has
        left = langid.fit(docs.where(f"lang <> '{out}'"))
        shares = {r["lang"]: r["share"] for r in docs.where("length(text) > 300").select("lang", langid.predictor(left)("text").rejected.cast("int").alias("r")).groupBy("lang").agg({"r": "mean"}).withColumnRenamed("avg(r)", "share").collect()}
        assert all(v < 0.03 for lang, v in shares.items() if lang != out) and shares[out] > 0.5, shares


def test_copies_and_rare_languages_in_the_sample(spark):
    rows = [("the same text over and over", "en")] * 3000 + [(f"the other texts that were there {i}", "en") for i in range(40)] + [(f"das ist ein anderer text nummer {'abcdefghij'[i % 10]}{'klmno'[i % 5]}{i}", "de") for i in range(60)] + [(f"voici encore un texte {i}", "fr") for i in range(400)]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("lang_pred", F.lit("clash"))
    model = langid.fit(docs, sample_rows=90)
    assert model.languages == ["de", "en", "fr"]
    got = docs.select("lang", langid.predictor(model)("text").alias("p")).where("p.lang_pred <> lang").count()
    assert got <= 0.02 * len(rows)
