import random

import pytest

from vellum.llm import neardup, simhash

from . import cases


def plain_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def groups(rows):
    """Least id of each row's group, by all pairs."""
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[top(i)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return [least.get(top(k)) for k in range(len(rows))]


def check(spark, docs, rows):
    got = sorted(((r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).collect()), key=str)
    want = groups(rows)
    assert got == sorted(zip((i for i, _ in rows), want, strict=True), key=str)
    assert sorted(r.doc_id for r in neardup.keep_one(docs).collect()) == sorted({w for w in want if w is not None})


def test_against_all_pairs(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    common = [word() for _ in range(25)]
    rows = []
    for _ in range(25):
        base = [*common, *(word() for _ in range(rng.randint(3, 150)))] if rng.random() < 0.6 else [word() for _ in range(rng.randint(1, 200))]
        for _ in range(rng.randint(1, 8)):
            text = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 30)):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
    assert len(set(groups(rows))) < len(rows)
    check(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


def test_awkward_rows(spark):
    check(spark, cases.frame(spark), [r[:2] for r in cases.rows()])
    assert neardup.keep_one(cases.empty(spark)).count() == 0


def test_pipeline_drops_edited_copies(spark):
    """Edited copies of similarity 0.8 or more go, though their SimHashes differ in 5 bits or more."""
    import corpus_pipeline
    from vellum.llm import simhash

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = set(groups(rows))
    prints = {i: simhash.simhash64(t) for i, t in rows}
    edited = [i for (i, _), g in zip(rows, groups(rows), strict=True) if (prints[i] ^ prints[g]).bit_count() > 4]
    assert edited
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()) == sorted(want)


def test_group_that_links_leave_apart_costs_no_square(spark, monkeypatch):
    """Edited copies of one text, many of them too far from all others: pairs met grow with the group, and no link is lost."""
    rng, verify, met = random.Random(6), neardup.similar, []
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base, rows = [word() for _ in range(150)], []
    for i in range(800):
        text = list(base)
        for _ in range(rng.choice((1, 2, 5, 6, 7))):
            text[rng.randrange(len(text))] = word()
        rows.append((i, " ".join(text)))
    rows += [(800 + i, f"{rows[40 * i][1]} {word()}") for i in range(20)]
    monkeypatch.setattr(neardup, "similar", lambda texts, pairs: (met.append(pairs.count()), verify(texts, pairs))[1])
    got = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == list(zip(range(len(rows)), groups(rows), strict=True))
    assert len({c for _, c in got}) > 200
    assert sum(met) < 50 * len(rows)


def on_disk(spark):
    """Shuffle files with their bytes."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName(): files.apply(i).length() for i in range(files.size())}


def written(spark, before):
    return sum(n for name, n in on_disk(spark).items() if name not in before)


@pytest.fixture
def wide(spark):
    """Texts that do not compress, one of them with a near copy; no table is broadcast unasked."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"{rng.getrandbits(60):x}" for _ in range(300))) for i in range(1000)]
    rows.append((1000, rows[0][1] + " tail"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint(), sum(len(t) for _, t in rows)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_that_stay_are_not_shuffled(spark, wide):
    docs, size = wide
    kept = simhash.one_each(docs, neardup.near_duplicates(docs))
    before = on_disk(spark)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(1000))
    assert written(spark, before) < size / 10
