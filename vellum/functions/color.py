"""Colours as 0xRRGGBB integers, by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _byte(v: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255).cast("int")


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(_byte(r), 16).bitwiseOR(F.shiftleft(_byte(g), 8)).bitwiseOR(_byte(b))


def gray(v: Column) -> Column:
    return rgb(v, v, v)


def cmyk(c: Column, m: Column, y: Column, k: Column) -> Column:
    """Pure black ink is printed black, not full black."""
    pure = (k >= 0.999) & (c <= 0.001) & (m <= 0.001) & (y <= 0.001)
    plain = rgb(*[1 - F.least(F.lit(1.0), v + k) for v in (c, m, y)])
    return F.when(pure, (35 << 16) + (31 << 8) + 32).otherwise(plain)


def lab(lightness: Column, a: Column, b: Column) -> Column:
    """CIE Lab with a D50 white to sRGB."""
    fy = (lightness + 16) / 116
    fx, fz = fy + a / 500, fy - b / 200

    def cube(t: Column) -> Column:
        return F.when(t > 6 / 29, t * t * t).otherwise(3 * (6 / 29) ** 2 * (t - 4 / 29))

    x, y, z = cube(fx) * 0.9642, cube(fy), cube(fz) * 0.8249
    linear = (3.1338561 * x - 1.6168667 * y - 0.4906146 * z, -0.9787684 * x + 1.9161415 * y + 0.0334540 * z, 0.0719453 * x - 0.2289914 * y + 1.4052427 * z)
    return rgb(*[gamma(v) for v in linear])


def gamma(v: Column) -> Column:
    """sRGB transfer curve."""
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)


def tint(t: Column, c0: Column, c1: Column, exponent: Column) -> Column:
    """A power function between two values (function type 2)."""
    return c0 + F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), exponent) * (c1 - c0)


def sampled(t: Column, samples: Column) -> Column:
    """Linear interpolation in an array of samples over 0 to 1 (function type 0 with one input)."""
    top = F.size(samples) - 1
    place = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * top
    low = F.least(F.floor(place).cast("int"), F.greatest(top - 1, F.lit(0)))
    a = F.element_at(samples, low + 1)
    b = F.element_at(samples, F.least(low + 1, top) + 1)
    return a + (b - a) * (place - low)


def text_color(mode: Column, fill: Column, stroke: Column) -> Column:
    """Text that is only outlined, or outlined as clip, shows its stroke colour."""
    return F.when(mode.isin(1, 5), stroke).otherwise(fill)


def by_count(values: Column) -> Column:
    """Colour of an operand list by its length: 1 gray, 3 RGB, 4 CMYK; black otherwise."""
    v = [F.get(values, F.lit(i)) for i in range(4)]
    return F.when(F.size(values) == 1, gray(v[0])).when(F.size(values) == 3, rgb(*v[:3])).when(F.size(values) == 4, cmyk(*v)).otherwise(0)


def hex_string(color: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.hex(color), 6, "0"))
