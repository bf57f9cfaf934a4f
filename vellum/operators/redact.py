"""Redaction decisions: which glyphs of a page zones remove, and the kerning that keeps the rest in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .layout import PAGE
from .sizes import small

#: Share of a glyph's box that is cut on each side before the test.
MARGIN = 0.1
#: Zones up to this many are sent to every task; more are joined by page.
BROADCAST_ZONES = 100_000


def _hit(glyphs: DataFrame, zones: DataFrame, min_overlap: float) -> tuple:
    z = zones.select(F.col("doc_id").alias("z_doc"), F.col("page_num").alias("z_page"), *[F.col(c).alias(f"z_{c}") for c in G.SIDES])
    z = small(z, BROADCAST_ZONES)
    own, zone = G.rect(*[F.col(c) for c in G.SIDES]), G.rect(*[F.col(f"z_{c}") for c in G.SIDES])
    same = (F.col("doc_id") == F.col("z_doc")) & (F.col("page_num") == F.col("z_page"))
    cut = G.shrink(own, MARGIN)
    test = G.touches(cut, zone)
    if min_overlap > 0:
        common = G.intersect(own, zone)
        area = F.greatest(G.width(common), F.lit(0.0)) * F.greatest(G.height(common), F.lit(0.0))
        test = test & (area >= min_overlap * G.width(own) * G.height(own))
    return z, same & test


def removed(glyphs: DataFrame, zones: DataFrame, min_overlap: float = 0.0) -> DataFrame:
    """Glyphs (with their boxes x0..y1) that a zone touches, edges included, after the margin is cut off.

    ``min_overlap`` above zero asks for this share of the glyph's box besides.
    """
    z, test = _hit(glyphs, zones, min_overlap)
    return glyphs.join(z, test, "left_semi")


def kept(glyphs: DataFrame, zones: DataFrame, min_overlap: float = 0.0) -> DataFrame:
    z, test = _hit(glyphs, zones, min_overlap)
    return glyphs.join(z, test, "left_anti")


def kerning(flagged: DataFrame, *string: str) -> DataFrame:
    """Of glyphs with ``removed`` flags, a row for each run of removed ones within a string: the
    sequence number of the next kept glyph (null at the string's end) and the sum of thousandths
    to skip, negative as in the format.
    """
    back = Window.partitionBy(*PAGE, *string).orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0)  # a running frame; the reverse would be quadratic
    run = flagged.withColumn("next_kept", F.min(F.when(~F.col("removed"), F.col("seq"))).over(back))
    return run.where("removed").groupBy(*PAGE, *string, "next_kept").agg(F.sum(-F.col("adv") * 1000).alias("adjust"), F.count("*").alias("n_removed"))
