"""Stream filters the other way: bytes to encoded bytes, as ``codec`` reads them."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable

import numpy as np


def ascii_hex(data: bytes) -> bytes:
    return data.hex().encode() + b">"


def ascii85(data: bytes) -> bytes:
    return base64.a85encode(data) + b"~>"


_STRETCH = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def run_length(data: bytes) -> bytes:
    """Stretches of three or more equal bytes as a count and the byte, what stands between as it is."""
    out, plain = bytearray(), 0

    def copied(end: int) -> None:
        for at in range(plain, end, 128):
            part = data[at : min(at + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _STRETCH.finditer(data):
        copied(m.start())
        out.extend((257 - (m.end() - m.start()), m[1][0]))
        plain = m.end()
    copied(len(data))
    return bytes(out) + b"\x80"


#: Sizes of a table at which codes get a bit more.
_WIDER = {512, 1024, 2048}


def lzw(data: bytes, early: int = 1) -> bytes:
    """Codes of 9 to 12 bits; the table is cleared when it is full."""
    table, top, width = {}, 258, 9
    codes, widths = [256], [9]
    last = data[0] if data else None
    for byte in data[1:]:
        more = last << 8 | byte
        if more in table:
            last = table[more]
            continue
        codes.append(last)
        widths.append(width)
        table[more] = top
        top += 1
        if top - 1 + early in _WIDER:  # the reader's table is one entry behind
            width += 1
        if top > 4094:
            codes.append(256)
            widths.append(width)
            table, top, width = {}, 258, 9
        last = byte
    if data:
        codes.append(last)
        widths.append(width)
        width += top + early in _WIDER
    wide = np.array([*widths, width])
    bits = np.array([*codes, 257], np.uint16)[:, None] >> np.arange(11, -1, -1, dtype=np.uint16) & 1
    return np.packbits(bits[np.arange(12) >= 12 - wide[:, None]].astype(np.uint8)).tobytes()


def png_rows(data: bytes, columns: int, kind: int) -> bytes:
    """Rows of one-byte samples under PNG prediction ``kind`` (0 to 4); the last row may be short."""
    rows = _rows(data, columns).astype(np.int16)
    left, up, corner = (np.zeros_like(rows) for _ in range(3))
    left[:, 1:], up[1:], corner[1:, 1:] = rows[:, :-1], rows[:-1], rows[:-1, :-1]
    if kind == 4:
        near = left + up - corner
        a, b, c = abs(near - left), abs(near - up), abs(near - corner)
        guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    else:
        guess = (0, left, up, (left + up) // 2)[kind]
    out = np.full((len(rows), columns + 1), kind, np.uint8)
    out[:, 1:] = rows - guess & 255
    return out.tobytes()[: len(data) + len(rows)]


def _rows(data: bytes, columns: int) -> np.ndarray:
    """Bytes as rows, the last one filled up with zeros."""
    return np.frombuffer(data + bytes(-len(data) % columns), np.uint8).reshape(-1, columns)


def tiff_rows(data: bytes, columns: int) -> bytes:
    """Rows of one-byte samples as differences from the sample to the left."""
    rows = _rows(data, columns)
    return np.concatenate((rows[:, :1], rows[:, 1:] - rows[:, :-1]), 1).tobytes()[: len(data)]


FILTERS: dict[str, Callable[[bytes], bytes]] = {"ASCIIHexDecode": ascii_hex, "ASCII85Decode": ascii85, "RunLengthDecode": run_length, "LZWDecode": lzw, "FlateDecode": zlib.compress}


def encode(data: bytes, filters: list[str], parms: list[dict]) -> bytes:
    """What ``codec.decode`` with the same names and parameters turns back into ``data``."""
    for name, parm in reversed(list(zip(filters, parms, strict=True))):
        predictor, columns = int(parm.get("Predictor", 1)), int(parm.get("Columns", 1))
        if predictor == 2:
            data = tiff_rows(data, columns)
        elif predictor >= 10:
            data = png_rows(data, columns, min(predictor - 10, 4))
        data = lzw(data, int(parm.get("EarlyChange", 1))) if name == "LZWDecode" else FILTERS[name](data)
    return data
