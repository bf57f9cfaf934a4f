from pyspark.sql import functions as F

from vellum.llm import langid, queries

from . import cases


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op3_language_id(spark, sf).join(truth, "doc_id").where("held_out and lang_pred <> 'und'")
    row = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.min("score").alias("low"), F.max("score").alias("high"), F.avg(F.col("ambiguous").cast("int")).alias("unsure")).first()
    assert row.right > 0.97 and 0 <= row.low and row.high <= 1 and row.unsure < 0.02


def test_awkward_rows(spark):
    docs = cases.frame(spark)
    got = langid.predict(docs, langid.train(docs)).collect()
    assert len(got) == docs.count()
    assert {r.lang_pred for r in got} <= {"en", "de", "und"}
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {0, 1, 2, 13} <= und and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.accepted(docs, langid.train(docs)).columns == docs.columns
    assert langid.train(cases.empty(spark)) is None and langid.predict(cases.empty(spark), None).count() == 0
    alone = docs.where("lang = 'de' or lang is null")
    assert {r.lang_pred for r in langid.predict(alone, langid.train(alone)).collect()} == {"de", "und"}


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 5, 9, 20):
        code = langid.codewords(n)
        apart = min(((code[i] != code[j]).sum() for i in range(n) for j in range(i)), default=9)
        assert apart >= (1 if n < 3 else 2) and len({tuple(c) for c in code}) == n
