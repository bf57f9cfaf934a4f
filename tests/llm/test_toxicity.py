import numpy as np
from pyspark.sql import functions as F

from vellum.llm import queries, toxicity

from . import cases


def test_labels_are_met(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = toxicity.train(docs, labels.where(~held))
    found = toxicity.score(docs, model).join(labels.where(held).selectExpr("doc_id", "toxic as truth"), "doc_id")
    share = {r.truth: r.flagged for r in found.groupBy("truth").agg(F.avg(F.col("toxic").cast("int")).alias("flagged")).collect()}
    assert share[1] > 0.85 and share[0] < 0.005


def test_later_links_read_earlier_ones(spark):
    rng = np.random.default_rng(1)
    bags = [{b"plain%d" % k for k in rng.integers(0, 30, 9)} | ({b"idiot"} if i % 4 == 0 else {b"scum"} if i % 4 == 1 else set()) for i in range(400)]
    model = toxicity.fit(bags, np.array([i % 4 < 2 for i in range(400)]))
    assert [len(w) for w in model.weights] == [len(model.markers) + k for k in range(len(toxicity.LINKS))]
    p = dict(zip(toxicity.LINKS, model.chain(toxicity.presence([{b"idiot"}], model.markers))[0], strict=True))
    assert p["insult"] > 0.5 > p["dehumanising"] and p["toxic"] > 0.5
    assert (model.chain(toxicity.presence([{b"plain1"}], model.markers))[0] < 0.5).all()


def test_awkward_rows(spark):
    docs = cases.frame(spark)
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (4, None), (999, 1), (5, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == docs.count()
    none = toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()
    assert len(none) == docs.count() and not any(r.toxic for r in none)
    assert toxicity.score(cases.empty(spark), toxicity.train(cases.empty(spark), labels)).count() == 0


def test_query_has_a_row_for_each_document(spark):
    got = queries.op5_toxicity(spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
