import random
import re

from vellum.llm import substring

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """(doc_id, text) rows: n_words, n_removed, kept text of each."""
    first = {}
    for doc, text in rows:
        words = WORD.findall(text or "")
        for i in range(len(words) - 19 if doc is not None else 0):
            key = tuple(words[i : i + 20])
            first[key] = min(first.get(key, (doc, i)), (doc, i))
    out = []
    for doc, text in rows:
        words, gone = WORD.findall(text or ""), set()
        for i in range(len(words) - 19 if doc is not None else 0):
            if first[tuple(words[i : i + 20])] != (doc, i):
                gone.update(range(i, i + 20))
        out.append((doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


def check(spark, rows):
    got = substring.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_awkward_rows(spark):
    got = substring.deduplicated(cases.frame(spark)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([r[:2] for r in cases.rows()])
    assert substring.deduplicated(cases.empty(spark)).count() == 0


def test_branching_passages(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(50)]
    prose = lambda n: rng.choices(vocabulary, k=n)
    passages = [prose(rng.randint(15, 90)) for _ in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            s = rng.randint(0, 10)
            words += prose(rng.randint(0, 30)) + p[s : len(p) - rng.randint(0, 10)]
        rows.append((i * 3 % 121, " ".join(words)))
    rows += [(500, " ".join(["a"] * 70)), (501, " ".join(["a", "b"] * 40)), (502, " ".join(["a", "b"] * 40)), (503, rows[5][1] + " " + rows[5][1])]
    check(spark, rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    check(spark, [tuple(r) for r in docs.collect()])


def test_rows_that_share_a_doc_id(spark):
    rng = random.Random(12)
    prose = lambda n: [f"u{rng.random()}" for _ in range(n)]
    p, a, b = prose(40), prose(25), prose(60)
    rows = [(1, " ".join(p)), (5, " ".join(p + a)), (5, " ".join(b))]
    assert [n for d, _, n, _ in brute(rows) if d == 5] == [0, 40] or [n for d, _, n, _ in brute(rows) if d == 5] == [40, 0]
    passages = [prose(rng.randint(20, 50)) for _ in range(5)]
    for _ in range(40):
        rows.append((rng.randint(1, 9), " ".join(prose(rng.randint(0, 12)) + rng.choice(passages) + prose(rng.randint(0, 5)) + rng.choice(passages)[: rng.randint(5, 40)])))
    check(spark, rows)


def test_a_repeat_is_removed_only_where_the_words_are_its_source_words():
    import pyarrow as pa

    words = [f"w{i}" for i in range(30)]
    good = substring._digest([w.encode() for w in words], 2, 3)
    spans = [[{"start": 2, "size": 3, "digests": [good]}], [{"start": 2, "size": 3, "digests": [good + 1]}]]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([" ".join(words)] * 2), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("digests", pa.list_(pa.int64()))])))], ["doc_id", "text", "spans"])
    [out] = substring._apply([batch])
    assert out.column("n_removed").to_pylist() == [22, 0]
