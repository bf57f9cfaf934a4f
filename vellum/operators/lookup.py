"""Lookups: code ranges, glyph bitmaps against templates, ordered merges and numbered runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .sizes import SMALL_ROWS, small

MIN_SCORE = 0.30
N_BLOCKS = 16


def match_codespace(strings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Code at the head of each byte string: the longest range that holds it, else one byte.

    ``strings``: (string_id, font, b0..b3 as integers, n_bytes); ``ranges``: (font, nbytes, low, high), a small table.
    """
    code = F.lit(0).cast("long")
    codes = []
    for i in range(4):
        code = code * 256 + F.coalesce(F.col(f"b{i}"), F.lit(0))
        codes.append(code)
    of = F.element_at(F.array(*codes), F.col("nbytes"))
    fits = (F.col("n_bytes") >= F.col("nbytes")) & of.between(F.col("low"), F.col("high"))
    met = strings.join(small(ranges), "font", "left").withColumn("code", F.when(fits, of)).withColumn("fits", F.coalesce(fits, F.lit(False)))
    best = Window.partitionBy("string_id").orderBy(F.col("fits").desc(), F.col("nbytes").desc(), "low", "high")
    top = met.withColumn("_rank", F.row_number().over(best)).where("_rank = 1")
    return top.select("string_id", F.when(F.col("fits"), F.col("code")).otherwise(F.col("b0").cast("long")).alias("code"), F.when(F.col("fits"), F.col("nbytes")).otherwise(1).alias("consumed"))


def overlap(a: list[Column], b: list[Column]) -> Column:
    """Share of common among all set bits of two bitmaps; 1 for two empty ones."""
    common = sum((F.bit_count(x.bitwiseAND(y)) for x, y in zip(a, b, strict=True)), F.lit(0))
    either = sum((F.bit_count(x.bitwiseOR(y)) for x, y in zip(a, b, strict=True)), F.lit(0))
    return F.when(either == 0, 1.0).otherwise(common / F.when(either > 0, either))


def match_bitmaps(glyphs: DataFrame, templates: DataFrame) -> DataFrame:
    """Best template of each glyph bitmap with as many contours, above the least score; of equal ones the first.

    ``glyphs``: (glyph_id, contours, b0..b15); ``templates``: (idx, ch, contours, t0..t15), a few thousand rows.
    Every glyph is scored against every template of its contour count, which is a matrix of bit counts: Arrow batches
    hold it in arrays, so no row is made for a pair; only a glyph's best one moves.  Beyond ``SMALL_ROWS`` templates both sides are joined.
    """
    names = [f"t{i}" for i in range(N_BLOCKS)]
    rows = templates.select("idx", "ch", "contours", *names).orderBy("idx").limit(SMALL_ROWS + 1).collect()
    if len(rows) > SMALL_ROWS:
        return _match_joined(glyphs, templates)
    bits = glyphs.select("glyph_id", "contours", *[F.col(f"b{i}").cast("long").alias(f"b{i}") for i in range(N_BLOCKS)])
    return _best_rows(bits.mapInArrow(_best_of(rows), f"glyph_id {glyphs.schema['glyph_id'].dataType.simpleString()}, idx long, ch string, score double"))


def _best_rows(found: DataFrame) -> DataFrame:
    """The best row of each glyph_id, also where several bitmaps share one; of equal ones the first template."""
    best = found.groupBy("glyph_id").agg(F.max_by(F.struct("idx", "ch"), F.struct("score", -F.col("idx"))).alias("b"), F.max("score").alias("score"))
    return best.where(F.col("score") > MIN_SCORE).select("glyph_id", "b.*", "score")


#: Scores that a task holds at once.
MATRIX = 1 << 20


def _best_of(rows: list[Row]):
    """Rows (glyph_id, idx, ch, score) of batches of bitmaps, against ``rows`` of templates in ascending order of idx."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {c: [r for r in rows if r.contours == c] for c in {r.contours for r in rows}}
        bits = {c: np.array([r[3:] for r in of], np.int64).view(np.uint64) for c, of in kinds.items()}
        for batch in batches:
            contours = batch.column(1).to_numpy(zero_copy_only=False)
            blocks = np.stack([batch.column(2 + i).fill_null(0).to_numpy(zero_copy_only=False) for i in range(N_BLOCKS)], 1).view(np.uint64)
            for c, of in kinds.items():
                same = np.flatnonzero(contours == c)
                step = max(1, MATRIX // len(of))
                for at in (same[i : i + step] for i in range(0, len(same), step)):
                    mine, theirs = blocks[at], bits[c]
                    common = sum(np.bitwise_count(mine[:, i, None] & theirs[None, :, i]).astype(np.int32) for i in range(N_BLOCKS))
                    either = np.bitwise_count(mine).sum(1, dtype=np.int32)[:, None] + np.bitwise_count(theirs).sum(1, dtype=np.int32)[None, :] - common
                    score = np.where(either == 0, 1.0, common / np.maximum(either, 1))
                    best = score.argmax(1)  # the first of equal ones
                    top = score[np.arange(len(at)), best]
                    best, top, at = best[top > MIN_SCORE], top[top > MIN_SCORE], at[top > MIN_SCORE]
                    columns = [batch.column(0).take(pa.array(at)), pa.array([of[k].idx for k in best.tolist()], pa.int64()), pa.array([of[k].ch for k in best.tolist()], pa.string()), pa.array(top)]
                    yield pa.RecordBatch.from_arrays(columns, ["glyph_id", "idx", "ch", "score"])

    return run


def _match_joined(glyphs: DataFrame, templates: DataFrame) -> DataFrame:
    """``match_bitmaps`` by a join, for any number of templates."""
    met = glyphs.join(templates, "contours")
    met = met.withColumn("score", overlap([F.col(f"b{i}") for i in range(N_BLOCKS)], [F.col(f"t{i}") for i in range(N_BLOCKS)]))
    return _best_rows(met)


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*").select(*rows.columns)


def overlay(child: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    """Both tables, the child's rows in place of the parent's of the same key."""
    return child.unionByName(parent.join(child.select(*key).distinct(), key, "left_anti"))


def fill_missing(have: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``more`` only for keys that are absent."""
    return overlay(have, more, key)


def subsections(ids: DataFrame, doc: str = "doc_id", id_column: str = "obj_id") -> DataFrame:
    """Runs of consecutive numbers: (doc, first, n)."""
    w = Window.partitionBy(doc).orderBy(id_column)
    numbered = ids.select(doc, id_column).distinct().withColumn("_run", F.col(id_column) - F.row_number().over(w))
    return numbered.groupBy(doc, "_run").agg(F.min(id_column).alias("first"), F.count("*").alias("n")).drop("_run")
