import random
from collections import defaultdict

from pyspark.sql import functions as F

from vellum.llm import mixing

from . import cases


def rake(cells, goals):
    """cells: {(source, lang, topic): share}; goals: a dict for each dimension."""
    share, off = dict(cells), 1.0
    while off > mixing.TOLERANCE:
        off = 0.0
        for d in range(3):
            total = defaultdict(float)
            for k, v in share.items():
                total[k[d]] += v
            off = max([off, *(abs(goals[d][c] / n - 1) for c, n in total.items())])
            share = {k: v * goals[d][k[d]] / total[k[d]] for k, v in share.items()}
    return share


def frame(spark):
    rng = random.Random(2)
    rows = [(f"s{rng.choice([0, 0, 0, 0, 1, 2, 3])}", rng.choice(["en", "en", "de", None]), rng.choice(["a", "b"]), float(rng.randint(1, 900))) for _ in range(400)]
    return rows, spark.createDataFrame(rows, "source string, lang string, topic string, tokens double").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))


def test_raking_meets_the_targets(spark):
    rows, table = frame(spark)
    got = mixing.raked(table).collect()
    own = defaultdict(float)
    for s, lang, t, n in rows:
        own[s, lang, t] += n
    total = sum(own.values())
    own = {k: v / total for k, v in own.items()}
    goals = []
    for d in range(3):
        marginal = defaultdict(float)
        for k, v in own.items():
            marginal[k[d]] += v
        norm = sum(v**mixing.TEMPER for v in marginal.values())
        goals.append({k: v**mixing.TEMPER / norm for k, v in marginal.items()})
    want = rake(own, goals)
    assert {(r.source, r.lang, r.topic) for r in got} == set(want)
    for r in got:
        assert abs(r.share - want[r.source, r.lang, r.topic]) < 1e-9
    for d, name in enumerate(mixing.DIMENSIONS):
        marginal = defaultdict(float)
        for r in got:
            marginal[r[name]] += r.share
        assert all(abs(marginal[k] - goals[d][k]) < 1e-4 for k in marginal)


def test_named_targets(spark):
    _, table = frame(spark)
    got = mixing.raked(table, {"source": {"s0": 0.1, "s1": 0.5, "absent": 0.1}}).groupBy("source").agg(F.sum("share").alias("share")).collect()
    share = {r.source: r.share for r in got}
    assert abs(share["s1"] / share["s0"] - 5) < 0.01 and abs(sum(share.values()) - 1) < 1e-6


def test_draw_is_calibrated(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = mixing.weighed(docs).withColumn("n", F.expr(mixing.TOKENS)).cache()
    rows = found.groupBy("source").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("mix_kept"), F.col("n") * F.col("mix_weight"))).alias("drawn"), F.sum(F.col("n") * F.col("mix_ratio")).alias("goal")).collect()
    assert all(abs(r.drawn / r.goal - 1) < 0.25 for r in rows)
    assert abs(sum(r.drawn for r in rows) / sum(r.goal for r in rows) - 1) < 0.03
    assert abs(sum(r.goal for r in rows) / sum(r.all for r in rows) - 1) < 1e-6
    found.unpersist()


def test_awkward_rows(spark):
    docs = cases.frame(spark)
    found = mixing.weighed(docs)
    assert found.count() == docs.count() and found.where("mix_p is null or mix_p <= 0 or mix_p > 1 or mix_kept is null").count() == 0
    assert mixing.sampled(docs).columns == docs.columns
    assert mixing.weighed(cases.empty(spark)).count() == 0
    assert sorted(map(str, mixing.sampled(docs).collect())) == sorted(map(str, mixing.sampled(docs.repartition(5)).collect()))


def test_plain_shares_of_the_sample_meet_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    tokens, topic = F.expr(mixing.TOKENS).alias("n"), F.expr(mixing.TOPIC).alias("topic")
    own = docs.select("source", "lang", topic, tokens).cache()
    drawn = mixing.sampled(docs).select("source", "lang", topic, tokens).cache()
    for d in ("lang", "topic"):
        had = {r[0]: float(r.n) for r in own.groupBy(d).agg(F.sum("n").alias("n")).collect() if r.n}
        got = {r[0]: float(r.n) for r in drawn.groupBy(d).agg(F.sum("n").alias("n")).collect() if r.n}
        goal = {k: (v / sum(had.values())) ** mixing.TEMPER for k, v in had.items()}
        for k, v in goal.items():
            share, want = got[k] / sum(got.values()), v / sum(goal.values())
            assert abs(share / want - 1) < 0.05, (d, k, share, want)
    all_tokens = own.agg(F.sum("n")).first()[0]
    assert abs(drawn.agg(F.sum("n")).first()[0] / all_tokens / mixing.KEEP - 1) < 0.03
    own.unpersist()
    drawn.unpersist()
