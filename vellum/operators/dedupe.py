"""Removal of text drawn twice: overprinted (fake bold) and hidden duplicate glyphs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layout import FAKE_BOLD_MAX_DIST, PAGE

#: Side of the cells that candidate pairs share; any value is exact.
CELL = 10.0


def _cells(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / CELL), F.floor(high / CELL)))


def near_pairs(glyphs: DataFrame, *same: str) -> DataFrame:
    """Rows (doc_id, page_num, first, second): pairs of glyphs of a page, equal in ``same``, whose origins differ by under a tenth of the earlier one's size on both axes.

    An equi-join on cells: the earlier glyph visits each cell its neighbourhood reaches into.
    """
    keys = [*PAGE, *same]
    reach = F.col("size") * FAKE_BOLD_MAX_DIST
    a = glyphs.select(*keys, F.col("seq").alias("first"), F.col("x").alias("ax"), F.col("y").alias("ay"), reach.alias("reach"))
    a = a.withColumn("cx", _cells(F.col("ax") - F.col("reach"), F.col("ax") + F.col("reach"))).withColumn("cy", _cells(F.col("ay") - F.col("reach"), F.col("ay") + F.col("reach")))
    b = glyphs.select(*keys, F.col("seq").alias("second"), F.col("x").alias("bx"), F.col("y").alias("by"), F.floor(F.col("x") / CELL).alias("cx"), F.floor(F.col("y") / CELL).alias("cy"))
    met = a.join(b, [*keys, "cx", "cy"]).where("first < second and abs(ax - bx) < reach and abs(ay - by) < reach")
    return met.select(*PAGE, "first", "second")


def _greedy(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A glyph goes if an earlier one that stayed is near it; pairs in order of the later glyph."""
    pairs = sorted((b, a) for batch in batches for a, b in zip(batch.column("first").to_pylist(), batch.column("second").to_pylist(), strict=True))
    gone: dict[int, int] = {}
    for b, a in pairs:
        if a not in gone and b not in gone:
            gone[b] = a
    n = len(gone)
    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * n, t) for k, t in zip(keys, (pa.int64(), pa.int64()), strict=True)] + [pa.array(list(gone), pa.int64()), pa.array(list(gone.values()), pa.int64())], ["doc_id", "page_num", "seq", "kept"])


def duplicates(glyphs: DataFrame, *same: str) -> DataFrame:
    """Rows (doc_id, page_num, seq, kept): glyphs to drop and the glyph each repeats.

    Being near is not transitive, so pairs of a page are settled in order; only glyphs that have a partner get there.
    """
    pairs = near_pairs(glyphs, *same).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_num").cast("long").alias("page_num"), "first", "second")
    return pairs.groupBy(*PAGE).applyInArrow(_greedy, "doc_id long, page_num long, seq long, kept long")


def remove_duplicates(glyphs: DataFrame) -> DataFrame:
    """Without hidden duplicates of the same character; blanks stay."""
    return glyphs.join(duplicates(glyphs.where("cp <> 32"), "cp").select(*PAGE, "seq"), [*PAGE, "seq"], "left_anti")


def merge_fake_bold(glyphs: DataFrame) -> DataFrame:
    """Overprinted glyphs of one font become one, bold, in the colour of the last."""
    found = duplicates(glyphs, "cp", "font")
    last = found.join(glyphs.select(*PAGE, "seq", "color"), [*PAGE, "seq"]).groupBy(*PAGE, F.col("kept").alias("seq")).agg(F.max_by("color", "seq").alias("_color"))
    kept = glyphs.join(found.select(*PAGE, "seq"), [*PAGE, "seq"], "left_anti").join(last, [*PAGE, "seq"], "left")
    order = [c for c in glyphs.columns if c not in ("bold", "color")]
    return kept.select(*order, (F.col("bold") | F.col("_color").isNotNull()).alias("bold"), F.coalesce("_color", "color").alias("color")).select(*glyphs.columns)


def drop_blank_lines(chars: DataFrame) -> DataFrame:
    """Without lines that hold only blanks."""
    full = chars.groupBy(*PAGE, "line_no").agg(F.bool_or((F.col("cp") != 32) & ~F.col("synthetic")).alias("full")).where("full")
    return chars.join(full.select(*PAGE, "line_no"), [*PAGE, "line_no"], "left_semi")
