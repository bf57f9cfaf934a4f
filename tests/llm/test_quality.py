import re
from collections import Counter

from pyspark.sql import functions as F

from vellum.llm import quality

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    t = text or ""
    words = WORD.findall(t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_counts_and_verdicts(spark):
    extra = [(900, "x y z\nx y z\n\n \nx y z # $ <b>|", None, None, 0, 0, "", 0, 0, 0), (901, "JUNK!! " * 80, None, None, 0, 0, "", 0, 0, 0)]
    docs = cases.frame(spark).unionByName(spark.createDataFrame(extra, cases.SCHEMA))
    got = quality.scored(docs).withColumn("failed", quality.base_failed()).collect()
    want = Counter((r[0], *plain(r[1])) for r in [*cases.rows(), *extra])
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert 0 <= r.p_good <= 1
    assert quality.scored(cases.empty(spark)).count() == 0


def test_estimation_recovers_known_accuracies():
    import random

    rng = random.Random(4)
    right = [0.95, 0.85, 0.75, 0.9]
    votes = Counter()
    for _ in range(20000):
        good = rng.random() < 0.8
        votes[tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < a) == good else -1) for a in right)] += 1
    share, rates = quality.estimate(list(votes.items()))
    assert abs(share - 0.8) < 0.03
    for r, a in zip(rates, right, strict=True):
        assert abs(r[1][0] / (r[1][0] + r[-1][0]) - a) < 0.03 and abs(r[-1][1] / (r[1][1] + r[-1][1]) - a) < 0.06


def test_verdicts_follow_the_quality_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = quality.scored(docs).withColumn("kept", ~quality.base_failed() & F.col("good")).join(labels, "doc_id").where("n_words >= 50")
    right = found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in right}
    assert kept[1] > 0.98 and kept[0] < 0.1


def test_the_estimation_decides(spark):
    """Not all-must-pass: some that are kept carry a bad vote, some that go carry a good one and pass the base rules."""
    found = quality.scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where(~quality.base_failed())
    votes = [f"vote_{k}" for k in quality.rules()]
    rows = found.select("good", F.least(*votes).alias("worst"), F.greatest(*votes).alias("best")).collect()
    assert any(r.good and r.worst < 0 for r in rows) and any(not r.good and r.best > 0 for r in rows)


def test_a_rule_below_even_is_not_heard():
    assert quality.told({1: (0.2, 0.6), -1: (0.5, 0.1)}, 1) == 0 == quality.told({1: (0.2, 0.6), -1: (0.5, 0.1)}, -1)
    assert quality.told({1: (0.6, 0.2), -1: (0.1, 0.5)}, 1) > 0 > quality.told({1: (0.6, 0.2), -1: (0.1, 0.5)}, -1)


def test_windows_of_a_very_long_text(spark):
    """A text of 300,000 words with one repeated window."""
    text = " ".join([f"w{i}" for i in range(300_000)] + ["w7", "w8", "w9"])
    [row] = quality.signals(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row.n_words, row.n_repeat_words) == (300_003, 6)
