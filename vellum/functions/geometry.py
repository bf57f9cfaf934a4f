"""Points, rectangles and matrices as column expressions.  Rectangles and matrices are structs."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def intersect(a: Column, b: Column) -> Column:
    return rect(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))


def union(a: Column, b: Column) -> Column:
    return rect(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def width(r: Column) -> Column:
    return r["x1"] - r["x0"]


def height(r: Column) -> Column:
    return r["y1"] - r["y0"]


def is_empty(r: Column) -> Column:
    return (r["x1"] <= r["x0"]) | (r["y1"] <= r["y0"])


def contains(outer: Column, inner: Column) -> Column:
    return (outer["x0"] <= inner["x0"]) & (outer["y0"] <= inner["y0"]) & (outer["x1"] >= inner["x1"]) & (outer["y1"] >= inner["y1"])


def overlap_state(a: Column, zone: Column) -> Column:
    """0 apart, 1 overlapping, 2 inside the zone."""
    apart = (a["x1"] <= zone["x0"]) | (a["x0"] >= zone["x1"]) | (a["y1"] <= zone["y0"]) | (a["y0"] >= zone["y1"])
    return F.when(apart, 0).when(contains(zone, a), 2).otherwise(1)


def touches(a: Column, b: Column) -> Column:
    """Whether two rectangles share a point, edges included."""
    return (a["x0"] <= b["x1"]) & (a["x1"] >= b["x0"]) & (a["y0"] <= b["y1"]) & (a["y1"] >= b["y0"])


def overlaps_horizontally(a: Column, b: Column) -> Column:
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"])


def shrink(r: Column, share: float) -> Column:
    """A rectangle without this share of its width and height on each side."""
    dx, dy = width(r) * share, height(r) * share
    return rect(r["x0"] + dx, r["y0"] + dy, r["x1"] - dx, r["y1"] - dy)


def matrix(*values: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in zip("abcdef", values, strict=True)])


def multiply(m: Column, n: Column) -> Column:
    """First m, then n."""
    return matrix(
        m["a"] * n["a"] + m["b"] * n["c"], m["a"] * n["b"] + m["b"] * n["d"],
        m["c"] * n["a"] + m["d"] * n["c"], m["c"] * n["b"] + m["d"] * n["d"],
        m["e"] * n["a"] + m["f"] * n["c"] + n["e"], m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    )


def transform_x(m: Column, x: Column, y: Column) -> Column:
    return m["a"] * x + m["c"] * y + m["e"]


def transform_y(m: Column, x: Column, y: Column) -> Column:
    return m["b"] * x + m["d"] * y + m["f"]


def transform_rect(m: Column, r: Column) -> Column:
    xs = [transform_x(m, r[a], r[b]) for a in ("x0", "x1") for b in ("y0", "y1")]
    ys = [transform_y(m, r[a], r[b]) for a in ("x0", "x1") for b in ("y0", "y1")]
    return rect(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def inverse(m: Column) -> Column:
    """Inverse matrix; null where there is none."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    k = F.when(F.abs(det) > 1e-12, 1 / F.when(det != 0, det))
    return matrix(m["d"] * k, -m["b"] * k, -m["c"] * k, m["a"] * k, (m["c"] * m["f"] - m["d"] * m["e"]) * k, (m["b"] * m["e"] - m["a"] * m["f"]) * k)


def expansion(m: Column) -> Column:
    """By how much a matrix enlarges: the effective size of text drawn through it."""
    return F.sqrt(F.abs(m["a"] * m["d"] - m["b"] * m["c"]))


def effective_size(m: Column, size: Column) -> Column:
    """Expansion, or the nominal size where that vanishes, or one."""
    return F.when(expansion(m) > 0.001, expansion(m)).when(size > 0.001, size).otherwise(F.lit(1.0))


def snapped_rotation(rotate: Column) -> Column:
    """A page's rotation as 0, 90, 180 or 270."""
    return F.pmod(F.floor((rotate + 45) / 90) * 90, F.lit(360)).cast("int")


def page_box(media: Column, crop: Column) -> Column:
    """Crop box within the media box; the media box where there is no crop box."""
    return F.when(crop.isNull(), media).otherwise(intersect(media, crop))


def page_matrix(box: Column, rotate: Column) -> Column:
    """From the page's own space (y up) to top-down space with the box at the origin."""
    turn, one, zero = snapped_rotation(rotate), F.lit(1.0), F.lit(0.0)
    return (
        F.when(turn == 90, matrix(zero, one, one, zero, -box["y0"], -box["x0"]))
        .when(turn == 180, matrix(-one, zero, zero, one, box["x1"], -box["y0"]))
        .when(turn == 270, matrix(zero, -one, -one, zero, box["y1"], box["x1"]))
        .otherwise(matrix(one, zero, zero, -one, -box["x0"], box["y1"]))
    )


def page_rect(box: Column, rotate: Column) -> Column:
    """[0, 0, width, height] of a page as shown."""
    return transform_rect(page_matrix(box, rotate), box)


def crop_pixels(r: Column, scale: Column, page: Column) -> Column:
    """Whole pixels that a clip covers at a scale, within the page, one pixel at least."""
    limit_x, limit_y = F.ceil(width(page) * scale), F.ceil(height(page) * scale)
    x0 = F.greatest(F.lit(0), F.least(F.floor(r["x0"] * scale), limit_x - 1))
    y0 = F.greatest(F.lit(0), F.least(F.floor(r["y0"] * scale), limit_y - 1))
    x1 = F.greatest(x0 + 1, F.least(F.ceil(r["x1"] * scale), limit_x))
    y1 = F.greatest(y0 + 1, F.least(F.ceil(r["y1"] * scale), limit_y))
    return F.struct(x0.cast("long").alias("x0"), y0.cast("long").alias("y0"), x1.cast("long").alias("x1"), y1.cast("long").alias("y1"))


class Rect(NamedTuple):
    """A rectangle of plain numbers; ``&`` intersects."""

    x0: float
    y0: float
    x1: float
    y1: float

    @property
    def width(self) -> float:
        return max(0.0, self.x1 - self.x0)

    @property
    def height(self) -> float:
        return max(0.0, self.y1 - self.y0)

    @property
    def is_empty(self) -> bool:
        return self.x1 <= self.x0 or self.y1 <= self.y0

    def __and__(self, other: Rect) -> Rect:
        return Rect(max(self.x0, other.x0), max(self.y0, other.y0), min(self.x1, other.x1), min(self.y1, other.y1))


class Matrix(NamedTuple):
    """A matrix of plain numbers; ``m * n`` is first m, then n."""

    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 1.0
    e: float = 0.0
    f: float = 0.0

    def __mul__(self, n: Matrix) -> Matrix:
        return Matrix(self.a * n.a + self.b * n.c, self.a * n.b + self.b * n.d, self.c * n.a + self.d * n.c, self.c * n.b + self.d * n.d, self.e * n.a + self.f * n.c + n.e, self.e * n.b + self.f * n.d + n.f)

    def at(self, x: float, y: float) -> tuple[float, float]:
        return self.a * x + self.c * y + self.e, self.b * x + self.d * y + self.f

    def box(self, r: Rect) -> Rect:
        points = [self.at(x, y) for x in (r.x0, r.x1) for y in (r.y0, r.y1)]
        xs, ys = zip(*points, strict=True)
        return Rect(min(xs), min(ys), max(xs), max(ys))

    def inverse(self) -> Matrix:
        k = self.a * self.d - self.b * self.c
        return Matrix(self.d / k, -self.b / k, -self.c / k, self.a / k, (self.c * self.f - self.d * self.e) / k, (self.b * self.e - self.a * self.f) / k)

    @property
    def expansion(self) -> float:
        return math.sqrt(abs(self.a * self.d - self.b * self.c))


def page_matrix_of(box: Rect, rotate: int) -> Matrix:
    """Plain form of ``page_matrix``."""
    turn = (rotate + 45) // 90 * 90 % 360
    if turn == 90:
        return Matrix(0, 1, 1, 0, -box.y0, -box.x0)
    if turn == 180:
        return Matrix(-1, 0, 0, 1, box.x1, -box.y0)
    if turn == 270:
        return Matrix(0, -1, -1, 0, box.y1, box.x1)
    return Matrix(1, 0, 0, -1, -box.x0, box.y1)
