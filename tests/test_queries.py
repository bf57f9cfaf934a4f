"""Every registered query against its SQL on the smallest tables, and the rules that SQL does not show."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from vellum.operators import bidi, dedupe, insert, layout, lookup
from vellum.plans import documents as files, queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


@pytest.mark.parametrize("name", [*plans.ORACLES, *files.ORACLES])
def test_against_sql(spark, duck, name):
    got = {**plans.QUERIES, **files.QUERIES}[name](spark, SF)
    want = duck.sql({**plans.ORACLES, **files.ORACLES}[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    mine = sorted(repr([norm(r[c]) for c in order]) for r in got.collect())
    theirs = sorted(repr([norm(r[want.columns.index(c)]) for c in order]) for r in want.fetchall())
    assert mine == theirs and mine


def wrapped(text, limit, advance):
    lines, line, width, blank, at_blank = [], "", 0, -1, 0
    for c in text:
        if c == "\n":
            lines.append(line)
            line, width, blank = "", 0, -1
            continue
        if c == " ":
            blank = len(line)
        if width + advance(c) > limit and line:
            if blank >= 0:
                rest = line[blank + 1 :]
                lines.append(line[: blank + 1])
                line, width = rest, sum(map(advance, rest))
            else:
                lines.append(line)
                line, width = "", 0
            blank = -1
        line += c
        width += advance(c)
    return lines + [line] if line else lines


def test_word_wrap_against_a_loop(spark):
    advance = lambda c: 278 if c == " " else 222 if c in "iljt.," else 556
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {}
    for r in plans.word_wrap(spark, SF).collect():
        got.setdefault(r.doc_id, []).append((r.line_no, r.line))
    for d, text in texts.items():
        assert [x for _, x in sorted(got.get(d, []))] == wrapped(text, 20000, advance)


def glyph_rows(spark, rows):
    base = dict(doc_id=1, page_num=0, cp=97, c="a", adv=0.5, dx=1.0, dy=0.0, size=10.0, asc=0.8, dsc=-0.2, font="F", color=0, bold=False, italic=False, serif=False, mono=False, wmode=0, bidi=0, real_glyph=True, new_obj=False)
    full = [{**base, "seq": i, **r} for i, r in enumerate(rows)]
    for r in full:
        r["c"] = chr(r["cp"])
    schema = "doc_id long, page_num long, seq long, c string, cp long, x double, y double, adv double, dx double, dy double, size double, asc double, dsc double, font string, color long, bold boolean, italic boolean, serif boolean, mono boolean, wmode int, bidi int, real_glyph boolean, new_obj boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([[r[n] for n in names] for r in full], schema)


def test_duplicates_are_greedy_not_transitive(spark):
    rng = random.Random(3)
    rows = [{"x": rng.uniform(0, 4), "y": rng.uniform(0, 1.5), "cp": rng.choice([97, 98]), "size": rng.choice([8.0, 12.0])} for _ in range(80)]
    kept = []
    for i, r in enumerate(rows):
        if not any(rows[k]["cp"] == r["cp"] and abs(rows[k]["x"] - r["x"]) < 0.1 * rows[k]["size"] and abs(rows[k]["y"] - r["y"]) < 0.1 * rows[k]["size"] for k in kept):
            kept.append(i)
    assert sorted(r.seq for r in dedupe.remove_duplicates(glyph_rows(spark, rows)).collect()) == kept
    chain = [{"x": 0.0, "y": 0.0}, {"x": 0.8, "y": 0.0}, {"x": 1.6, "y": 0.0}]
    assert sorted(r.seq for r in dedupe.remove_duplicates(glyph_rows(spark, chain)).collect()) == [0, 2]


def test_fake_bold_takes_the_last_colour(spark):
    rows = [{"x": 0.0, "y": 0.0, "color": 1}, {"x": 0.5, "y": 0.0, "color": 2}, {"x": 0.5, "y": 0.0, "color": 3, "font": "G"}]
    got = sorted((r.seq, r.bold, r.color) for r in dedupe.merge_fake_bold(glyph_rows(spark, rows)).collect())
    assert got == [(0, True, 2), (2, False, 3)]


def test_overstrikes_compare_with_the_last_kept(spark):
    def left(*rows):
        return sorted(r.seq for r in layout.drop_overstrikes(glyph_rows(spark, list(rows))).collect())

    at = lambda x, y=0.0, **k: {"x": x, "y": y, **k}
    assert left(at(0.0), at(0.6), at(1.2), at(1.8), at(2.4)) == [0, 2, 4]
    assert left(at(0.0), at(0.9), at(-0.5), at(0.0), at(9.0)) == [0, 4]
    assert left(*[at(0.0)] * 50, at(0.5), at(0.5, cp=98), at(0.5, cp=98)) == [0, 51]
    assert left(at(0.0), at(0.0, dx=0.0, dy=1.0), at(0.1, size=20.0, dx=0.0, dy=1.0)) == [0, 1]
    assert left(at(0.0), at(30.0, real_glyph=False), at(0.5), at(0.5, cp=0x301), at(0.5)) == [0, 1, 3, 4]
    rng = random.Random(6)
    rows = [at(rng.uniform(0, 3), 0.0, cp=rng.choice([97, 97, 98]), size=rng.choice([8.0, 12.0]), real_glyph=rng.random() < 0.9) for _ in range(300)]
    kept, before, place = [], None, None
    for i, r in enumerate(rows):
        if r["real_glyph"] and before == r["cp"] and place is not None and abs(r["x"] - place) < 0.1 * r["size"]:
            continue
        kept.append(i)
        before, place = r["cp"], r["x"] if r["real_glyph"] else place
    assert left(*rows) == kept


def test_riders_have_no_width_at_the_pen(spark):
    rows = [{"x": 50.0, "y": 30.0}, {"x": 50.0, "y": 30.0, "cp": 0x301}, {"x": 55.0, "y": 30.0}]
    got = layout.glyph_boxes(layout.with_lines(glyph_rows(spark, rows))).orderBy("seq").collect()
    assert [(r.x0, r.x1, r.line_no) for r in got] == [(50.0, 55.0, 1), (55.0, 55.0, 1), (55.0, 60.0, 1)]


def breaks(spark, rows, **options):
    found = layout.with_lines(glyph_rows(spark, rows), layout.Options(**options)).orderBy("seq").collect()
    return [(r.line_no, r.block_no, r.gap) for r in found]


def test_line_rules(spark):
    at = lambda x, y=0.0, **k: {"x": x, "y": y, **k}
    assert breaks(spark, [at(0.0), at(5.0), at(11.6), at(20.0), at(33.1)]) == [(1, 1, 0), (1, 1, 0), (1, 1, 1), (1, 1, 2), (2, 1, 0)]
    assert breaks(spark, [at(0.0), at(0.0, 9.0), at(0.0, 25.0)]) == [(1, 1, 0), (2, 1, 0), (3, 2, 0)]
    assert breaks(spark, [at(0.0), at(3.0, 12.0, new_obj=True)]) == [(1, 1, 0), (2, 2, 0)]
    assert breaks(spark, [at(0.0, cp=0x2022), at(3.0, 12.0, new_obj=True)]) == [(1, 1, 0), (2, 1, 0)]
    assert breaks(spark, [at(0.0), at(50.0, 50.0, real_glyph=False), at(5.0)]) == [(1, 1, 0)] * 3
    assert breaks(spark, [at(0.0), at(5.0, dx=0.0, dy=1.0)]) == [(1, 1, 0), (2, 2, 0)]
    assert breaks(spark, [at(0.0), at(8.0)], inhibit_spaces=True) == [(1, 1, 0), (1, 1, 0)]
    assert breaks(spark, [at(0.0, cp=0x4E00), at(8.0)]) == [(1, 1, 0), (1, 1, 0)]
    rtl = [at(20.0, bidi=1), at(15.0, bidi=1), at(6.0, bidi=1)]
    assert breaks(spark, rtl) == [(1, 1, 0), (1, 1, 0), (1, 1, 1)]


def test_levels_and_order():
    assert bidi.levels("abc") == [0, 0, 0] and bidi.levels("אב") == [1, 1]
    assert bidi.levels("אב 12 ג") == [1, 1, 1, 2, 2, 1, 1]
    assert bidi.levels("a אב b") == [0, 0, 1, 1, 0, 0]
    assert bidi.reorder([1, 1, 2, 2, 1]) == [4, 2, 3, 1, 0] and bidi.reversed_runs([0, 3, 3, 0]) == [0, 2, 1, 3]


def test_layout_needs_one_exchange(spark):
    plan = layout.laid_out(glyph_rows(spark, [{"x": 0.0, "y": 0.0}]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_style_stand_ins(spark):
    row = spark.range(1).select(insert.synthetic_style(F.lit(True), F.lit(True), F.lit(10.0)).alias("s"), insert.line_start(F.lit(0.0), F.lit(100.0), F.lit(30.0), F.lit(True)).alias("x")).first()
    assert row.s.stroke == pytest.approx(0.3) and row.s.skew == pytest.approx(0.2125) and row.x == 70


def test_bitmaps_of_ties_and_empty_ones(spark, monkeypatch):
    """The first of equal templates wins, two empty bitmaps are equal, and the join finds the same."""
    zeros = ", ".join(f"0 as {{0}}{i}" for i in range(1, 16))
    glyphs = spark.sql(" union all ".join(f"select {g} as glyph_id, {c} as contours, {b} as b0, {zeros.format('b')}" for g, c, b in ((1, 0, 7), (2, 0, 0), (3, 1, 7), (4, 2, 7), (5, 1, 1 << 40))))
    templates = spark.sql(" union all ".join(f"select {i}L as idx, '{ch}' as ch, {c} as contours, {t} as t0, {zeros.format('t')}" for i, ch, c, t in ((3, "c", 0, 7), (1, "a", 0, 3), (2, "b", 0, 7), (9, "z", 0, 0), (4, "d", 1, 5))))
    want = [(1, 2, "b", 1.0), (2, 9, "z", 1.0), (3, 4, "d", 2 / 3)]
    assert sorted(map(tuple, lookup.match_bitmaps(glyphs, templates).collect())) == want
    monkeypatch.setattr(lookup, "SMALL_ROWS", 2)
    assert sorted(map(tuple, lookup.match_bitmaps(glyphs, templates).collect())) == want


def test_glyph_names_of_all_parts_against_sql(spark, duck, tmp_path):
    """Part numbers that take five and six hexadecimal digits, as in larger tables."""
    spark.range(65400, 1200000, 6547).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(tuple, plans.glyph_name_to_unicode(spark, str(tmp_path)).collect()))
    sql = plans.ORACLES["glyph_name_to_unicode"].replace("from part", f"from '{tmp_path}/part.parquet/*.parquet'")
    assert got == sorted(duck.sql(sql).fetchall()) and any(p > 0xFFFF and c == p for p, c in got)


def test_font_choice_needs_no_window(spark):
    """A task's slots stay in its row: nothing is joined, dealt out by a key or ranked."""
    plan = plans.font_choice(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "hashpartitioning" not in plan


def test_slots_are_chosen_as_by_the_grid(spark):
    rng = random.Random(4)
    tasks = spark.createDataFrame([(t, rng.choice(["", "lib", "notosans", "deja"]), rng.random() < 0.5, rng.random() < 0.5, rng.choice([3, 4])) for t in range(60)], "task_id long, family string, bold boolean, italic boolean, n_chars int")
    kind = "slot_id long, slot_family string, slot_bold boolean, slot_italic boolean, fallback boolean, covered int"
    for n in (1, 6):
        slots = [(s, rng.choice(["liberation", "noto", "deja", "lib"]), rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.3, rng.choice([0, 0, 2, 3, 4])) for s in range(n)]
        names = [c.split()[0] for c in kind.split(", ")]
        best = insert.choose_slot({c: F.col(c) for c in ("family", "bold", "italic", "n_chars")}, [dict(zip(names, map(F.lit, s), strict=True)) for s in slots])
        got = tasks.select("task_id", best.alias("b")).select("task_id", "b.slot_id", "b.tier")
        grid = tasks.select("task_id").crossJoin(spark.createDataFrame(slots, kind))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, insert.choose_font(tasks, grid).select("task_id", "slot_id", "tier").collect()))
