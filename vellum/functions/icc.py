"""Colours of matrix and curve ICC profiles as sRGB."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass


@dataclass
class Profile:
    matrix: tuple[tuple[float, float, float], ...]  # columns of red, green and blue in XYZ
    curves: tuple[Callable[[float], float], ...]

    def rgb(self, values: list[float]) -> tuple[float, float, float]:
        linear = [c(max(0.0, min(1.0, v))) for c, v in zip(self.curves, values, strict=False)]
        x, y, z = (sum(m[k] * v for m, v in zip(self.matrix, linear, strict=True)) for k in range(3))
        out = (3.1338561 * x - 1.6168667 * y - 0.4906146 * z, -0.9787684 * x + 1.9161415 * y + 0.0334540 * z, 0.0719453 * x - 0.2289914 * y + 1.4052427 * z)
        return tuple(12.92 * v if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055 for v in out)


def _fixed(data: bytes, at: int) -> float:
    return struct.unpack_from(">i", data, at)[0] / 65536


def _curve(data: bytes) -> Callable[[float], float]:
    kind = data[:4]
    if kind == b"curv":
        n = struct.unpack_from(">I", data, 8)[0]
        if n == 0:
            return lambda v: v
        table = struct.unpack_from(f">{n}H", data, 12)
        if n == 1:
            return lambda v: v ** (table[0] / 256)

        def lerp(v: float) -> float:
            place = v * (n - 1)
            low = min(int(place), n - 2)
            return (table[low] + (table[low + 1] - table[low]) * (place - low)) / 65535

        return lerp
    if kind == b"para":
        form = struct.unpack_from(">H", data, 8)[0]
        g, *p = (_fixed(data, 12 + 4 * i) for i in range((1, 3, 4, 5, 7)[form] if form < 5 else 1))
        if form == 0 or form > 4:
            return lambda v: v**g
        a, b = p[0], p[1]
        c, d, e, f = {1: (0.0, -b / a if a else 0.0, 0.0, 0.0), 2: (0.0, -b / a if a else 0.0, p[2] if len(p) > 2 else 0.0, p[2] if len(p) > 2 else 0.0), 3: (p[2] if len(p) > 2 else 0.0, p[3] if len(p) > 3 else 0.0, 0.0, 0.0), 4: (*p[2:4], *p[4:6]) if len(p) > 5 else (0.0, 0.0, 0.0, 0.0)}[form]
        return lambda v: (max(0.0, a * v + b) ** g + e) if v >= d else c * v + f
    return lambda v: v


def parse(data: bytes) -> Profile | None:
    """The profile, or None where it is not one of three curves and a matrix."""
    try:
        n = struct.unpack_from(">I", data, 128)[0]
        tags = {tag: data[at : at + size] for tag, at, size in (struct.unpack_from(">4sII", data, 132 + 12 * i) for i in range(min(n, 100)))}
        matrix = tuple(tuple(_fixed(tags[t], 8 + 4 * k) for k in range(3)) for t in (b"rXYZ", b"gXYZ", b"bXYZ"))
        return Profile(matrix, tuple(_curve(tags[t]) for t in (b"rTRC", b"gTRC", b"bTRC")))
    except (struct.error, KeyError):
        return None
