"""Visual order of right-to-left lines back to reading order.

Lines without right-to-left characters never leave the JVM; the others are reordered line by
line: sorted by place, given embedding levels, and runs reversed from the highest level down.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layout import PAGE

_NEUTRAL = ("B", "S", "WS", "ON", "BN")


def levels(text: str) -> list[int]:
    """Embedding levels of one line without explicit embeddings, by the weak, neutral and implicit rules."""
    kinds = [unicodedata.bidirectional(c) or "ON" for c in text]
    base = next((int(k in ("R", "AL")) for k in kinds if k in ("L", "R", "AL")), 0)
    sor = "R" if base else "L"
    strong = sor
    for i, k in enumerate(kinds):  # marks, and numbers after Arabic letters
        if k == "NSM":
            kinds[i] = kinds[i - 1] if i else sor
        if kinds[i] in ("L", "R", "AL"):
            strong = kinds[i]
        elif kinds[i] == "EN" and strong == "AL":
            kinds[i] = "AN"
    kinds = ["R" if k == "AL" else k for k in kinds]
    for i in range(1, len(kinds) - 1):  # single separators between numbers
        if kinds[i - 1] == kinds[i + 1] and ((kinds[i] == "CS" and kinds[i - 1] in ("EN", "AN")) or (kinds[i] == "ES" and kinds[i - 1] == "EN")):
            kinds[i] = kinds[i - 1]
    for i, k in enumerate(kinds):  # terminators next to European numbers
        if k == "ET":
            j = i
            while j < len(kinds) and kinds[j] == "ET":
                j += 1
            if (i and kinds[i - 1] == "EN") or (j < len(kinds) and kinds[j] == "EN"):
                kinds[i] = "EN"
    kinds = ["ON" if k in ("ES", "ET", "CS") else k for k in kinds]
    strong = sor
    for i, k in enumerate(kinds):
        if k in ("L", "R"):
            strong = k
        elif k == "EN" and strong == "L":
            kinds[i] = "L"
    i = 0
    while i < len(kinds):  # neutrals take the direction around them
        if kinds[i] not in _NEUTRAL:
            i += 1
            continue
        j = i
        while j < len(kinds) and kinds[j] in _NEUTRAL:
            j += 1
        before = sor if i == 0 else "L" if kinds[i - 1] == "L" else "R"
        after = sor if j == len(kinds) else "L" if kinds[j] == "L" else "R"
        kinds[i:j] = [before if before == after else sor] * (j - i)
        i = j
    up = {"L": (0, 2), "R": (1, 1), "EN": (2, 2), "AN": (2, 2)}
    out = [base + (up.get(k, (0, 0))[0] if not base else {"L": 1, "R": 0, "EN": 1, "AN": 1}.get(k, 0)) for k in kinds]
    for i in range(len(out) - 1, -1, -1):  # blanks at the end
        if not text[i].isspace():
            break
        out[i] = base
    return out


def reorder(levels_: list[int]) -> list[int]:
    """Indices with every run of a level or above reversed, from the highest level to 1."""
    order = list(range(len(levels_)))
    for level in range(max(levels_, default=0), 0, -1):
        i = 0
        while i < len(order):
            j = i
            while j < len(order) and levels_[order[j]] >= level:
                j += 1
            order[i:j] = order[i:j][::-1]
            i = max(j, i + 1)
    return order


def reversed_runs(kinds: list[int], which: int = 3) -> list[int]:
    """Indices with every run of ``which`` reversed."""
    return reorder([int(k == which) for k in kinds])


def _lines(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(list(batches))
    x, seq, bidi, text = (rows.column(c).to_pylist() for c in ("x", "seq", "bidi", "c"))
    if any(b & 1 and b != 3 for b in bidi):
        place = sorted(range(len(x)), key=lambda i: (x[i], seq[i]))
        order = [place[i] for i in reorder(levels("".join(text[i] for i in place)))]
    else:
        place = sorted(range(len(x)), key=lambda i: seq[i])
        order = [place[i] for i in reversed_runs([bidi[i] for i in place])]
    out = rows.take(pa.array(order))
    out = out.set_column(out.schema.get_field_index("seq"), "seq", pa.array(sorted(seq), pa.int64()))
    yield from out.combine_chunks().to_batches()


def reordered(chars: DataFrame) -> DataFrame:
    """Characters with ``seq`` dealt anew within lines that have right-to-left text."""
    odd = chars.groupBy(*PAGE, "line_no").agg(F.count_if(F.col("bidi") % 2 == 1).alias("n")).where("n > 0").select(*PAGE, "line_no")
    keys = [*PAGE, "line_no"]
    plain = chars.join(odd, keys, "left_anti")
    turned = chars.join(odd, keys, "left_semi").select(*plain.columns).groupBy(*keys).applyInArrow(_lines, plain.schema)
    return plain.unionByName(turned)
