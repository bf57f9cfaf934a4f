import random

from vellum.llm import decontam

from . import cases


def edits(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def mutated(rng, text, n):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = rng.choice("xyz")
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, rng.choice("xyz"))
    return "".join(out)


def test_against_full_alignment(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcde", k=rng.randint(2, 7))) for _ in range(80)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, prose(rng.randint(2, 30))) for i in range(12)] + [(20, "Qxz"), (21, None), (22, "  ")]
    docs = []
    for i in range(60):
        item = rng.choice(items[:12])[1]
        docs.append((i, prose(rng.randint(0, 40)) + " " + mutated(rng, item, rng.randint(0, max(1, len(item) // 7))) + " " + prose(rng.randint(0, 40))))
    docs += [(100, items[3][1]), (101, items[3][1].upper().replace(" ", "\n")), (102, "a QXZ b"), (103, None), (104, "")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.leaks(frame, bench).collect()}
    want = {}
    for d, text in docs:
        for i, item in items:
            a, b = decontam.normal(item).strip(), decontam.normal(text)
            if a and (n := edits(a, b)) <= decontam.budget(len(a)):
                want[d, i] = n
    assert got == want
    dirty = {d for d, _ in want}
    assert sorted(r.doc_id for r in decontam.clean(frame, bench).collect()) == sorted(d for d, _ in docs if d not in dirty)


def test_places(spark):
    item = "some passage of the benchmark that is long enough to matter"
    frame = spark.createDataFrame([(1, f"before {item} after"), (2, f"before {item.replace('passage', 'pasage')} after")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.leaks(frame, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()}
    assert (got[1].match_start, got[1].match_end, got[1].distance) == (7, 7 + len(item), 0)
    assert (got[2].match_start, got[2].match_end, got[2].distance) == (7, 6 + len(item), 1)


def test_awkward_tables(spark):
    docs = cases.frame(spark)
    bench = spark.createDataFrame([(1, cases.rows()[8][1])], "item_id long, text string")
    assert {9, 8, 10, None} <= {r.doc_id for r in decontam.leaks(docs, bench).collect()}
    assert decontam.clean(docs, bench).columns == docs.columns
    assert decontam.leaks(cases.empty(spark), bench).count() == 0
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.clean(docs, bench.limit(0)).count() == docs.count()


def test_items_without_id_count(spark):
    item, other = "some passage of the benchmark that is long enough to matter", "another passage that is also long enough to be found in a text"
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, f"before {other} after"), (3, "neither of them")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (None, other), (5, other), (None, None)], "item_id long, text string")
    assert sorted(((r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()), key=str) == [(1, None), (2, 5), (2, None)]
    assert [r.doc_id for r in decontam.clean(docs, bench).collect()] == [3]


def test_repetitive_texts_against_full_alignment(monkeypatch):
    rng = random.Random(9)
    for pairs in (1 << 20, 64):
        monkeypatch.setattr(decontam, "PAIRS", pairs)
        for alphabet in ("a", "ab", "aab "):
            items = [(i, "".join(rng.choices(alphabet, k=rng.randint(10, 60))).strip().encode()) for i in range(6)]
            items = [(i, x) for i, x in items if len(x) >= 8]
            index = decontam.Index(items)
            for _ in range(12):
                text = "".join(rng.choices(alphabet, k=rng.randint(0, 150))) + "zz" + mutated(rng, items[0][1].decode(), rng.randint(0, 5)) + "zz" * rng.randint(0, 2)
                got = {m.item_id: m.distance for m in index.matches(text)}
                assert got == {i: n for i, x in items if (n := edits(x.decode(), text)) <= decontam.budget(len(x))}
                for m in index.matches(text):
                    assert edits_whole(dict(items)[m.item_id].decode(), text[m.start : m.end]) == m.distance


def edits_whole(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_one_letter_a_million_times_in_bounded_memory():
    import tracemalloc

    index = decontam.Index([(1, b"a" * 500), (2, b"ab" * 250)])
    for text, found in (("a" * 1_000_000, {1: 0}), ("b" * 500_000 + "ba" * 250_000, {2: 0})):
        tracemalloc.start()
        assert {m.item_id: m.distance for m in index.matches(text)} == found
        assert tracemalloc.get_traced_memory()[1] < 500 << 20
        tracemalloc.stop()


def test_the_table_has_2k_1_diagonals():
    row, low = decontam._banded(b"some passage of text", b"here is some pasage of text", 5, 11, free=True)
    assert (len(row), low, row.min()) == (7, 5, 1)
