"""Stream filters: bytes to bytes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

MAX_BYTES = 128 << 20


def flate(data: bytes) -> bytes:
    """Zlib or raw deflate data, as far as it can be read; unchanged if it is neither."""
    for bits in (zlib.MAX_WBITS, -zlib.MAX_WBITS):
        engine, out = zlib.decompressobj(bits), b""
        try:
            out = engine.decompress(data, MAX_BYTES)
        except zlib.error:
            engine, parts = zlib.decompressobj(bits), []
            try:  # keep what comes before the damage
                for i in range(0, len(data), 256):
                    parts.append(engine.decompress(data[i : i + 256], MAX_BYTES))
            except zlib.error:
                pass
            out = b"".join(parts)
        if out or engine.eof:  # a whole stream may be empty
            return out
    return data


NOT_HEX = bytes(set(range(256)) - set(b"0123456789abcdefABCDEF"))


def ascii_hex(data: bytes) -> bytes:
    digits = data.split(b">")[0].translate(None, NOT_HEX)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii85(data: bytes) -> bytes:
    """Base-85 groups; ``z`` is four zeros.  A stray ``z`` or a lone last digit makes the stream invalid: empty."""
    body = data[2:] if data[:2] == b"<~" else data
    body = body.split(b"~")[0]
    if b"z" not in body:
        digits = np.frombuffer(body, np.uint8)
        digits = digits[(digits >= 33) & (digits <= 117)].astype(np.int64) - 33
        fill = -len(digits) % 5
        if fill == 4:
            return b""
        values = np.concatenate((digits, np.full(fill, 84))).reshape(-1, 5) @ (85 ** np.arange(4, -1, -1))
        out = (values & 0xFFFFFFFF).astype(">u4").tobytes()
        return out[: len(out) - fill]
    out, group = bytearray(), []
    for c in body:
        if c == 0x7A and not group:
            out += bytes(4)
        elif c == 0x7A:
            return b""
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += _four(group)
                group = []
    if len(group) == 1:
        return b""
    return bytes(out + (_four(group + [84] * (5 - len(group)))[: len(group) - 1] if group else b""))


def _four(group: list[int]) -> bytes:
    value = 0
    for d in group:
        value = value * 85 + d
    return (value & 0xFFFFFFFF).to_bytes(4, "big")


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and (n := data[i]) != 128:
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


#: Codes after a clearing until the table is full, and how many more are read at a time.
LZW_CODES = 4096


def _lzw_runs(data: bytes, early: int) -> Iterator[tuple[bool, list[int]]]:
    """Codes from one clearing to the next, in parts: whether the table starts anew before them, and they."""
    size = 257 + np.arange(LZW_CODES)  # of the table when a code is read, after the first
    schedule = 9 + sum((size + early >= n).astype(np.int64) for n in (512, 1024, 2048))
    schedule[0] = 9
    full = np.full(LZW_CODES, 12)
    padded = np.frombuffer(data + bytes(3), np.uint8).astype(np.int64)
    at, fresh = 0, True
    while True:
        wide = schedule if fresh else full
        ends = at + np.cumsum(wide)
        n = int(np.searchsorted(ends, 8 * len(data), "right"))
        starts, wide = ends[:n] - wide[:n], wide[:n]
        byte = starts >> 3
        window = padded[byte] << 16 | padded[byte + 1] << 8 | padded[byte + 2]
        codes = window >> (24 - (starts & 7) - wide) & (1 << wide) - 1
        marks = np.flatnonzero(codes >> 1 == 128)  # 256 or 257
        stop = int(marks[0]) if len(marks) else n
        yield fresh, codes[:stop].tolist()
        if not n or len(marks) and codes[stop] == 257 or stop == n < LZW_CODES:
            return
        fresh = bool(len(marks))
        at = int(ends[stop if fresh else n - 1])


def lzw(data: bytes, early: int = 1) -> bytes:
    """Codes of 9 to 12 bits; 256 clears the table, 257 ends."""
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, last = list(single), [], b""
    for fresh, codes in _lzw_runs(data, early):
        if fresh:
            table, last = list(single), b""
        for code in codes:
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                return b"".join(out)
            out.append(entry)
            if last and len(table) < 4096:
                table.append(last + entry[:1])
            last = entry
    return b"".join(out)


def unpredict(data: bytes, predictor: int, colors: int = 1, bits: int = 8, columns: int = 1) -> bytes:
    """Undo TIFF (2) or PNG (10 to 15) prediction."""
    if predictor < 2:
        return data
    step, row = max(1, colors * bits // 8), -(-colors * bits * columns // 8)
    if data and (predictor == 2 or set(data[:: row + 1]) in ({0}, {1}, {2})):
        return _summed(data, step, row, predictor)
    out, above = bytearray(), bytearray(row)
    for at in range(0, len(data), row + 1):
        kind, line = data[at], bytearray(data[at + 1 : at + 1 + row])
        for i in range(len(line)):
            left = line[i - step] if i >= step else 0
            up = above[i]
            if kind == 1:
                guess = left
            elif kind == 2:
                guess = up
            elif kind == 3:
                guess = (left + up) // 2
            elif kind == 4:
                corner = above[i - step] if i >= step else 0
                guess = min((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner))[2]
            else:
                guess = 0
            line[i] = line[i] + guess & 255
        out += line
        above = line + bytearray(row - len(line))
    return bytes(out)


def _summed(data: bytes, step: int, row: int, predictor: int) -> bytes:
    """Rows that hold differences only from the left (TIFF, PNG 1) or only from above (PNG 2), or none (PNG 0): running sums, all rows at a time."""
    head = int(predictor != 2)
    rows = np.frombuffer(data + bytes(-len(data) % (row + head)), np.uint8).reshape(-1, row + head)
    if head and data[0] != 1:
        out = np.cumsum(rows[:, 1:], 0, np.uint8) if data[0] else rows[:, 1:]
    else:
        wide = -(-row // step)
        lanes = np.zeros((len(rows), wide * step), np.uint8)
        lanes[:, :row] = rows[:, head:]
        out = np.cumsum(lanes.reshape(-1, wide, step), 1, np.uint8).reshape(len(rows), -1)[:, :row]
    return out.tobytes()[: len(data) - head * len(rows)]


#: Names and their short forms; image formats are passed on as they are.
FILTERS = {"FlateDecode": flate, "Fl": flate, "ASCIIHexDecode": ascii_hex, "AHx": ascii_hex, "ASCII85Decode": ascii85, "A85": ascii85, "RunLengthDecode": run_length, "RL": run_length, "LZWDecode": lzw, "LZW": lzw}
IMAGE_FILTERS = ("DCTDecode", "DCT", "JPXDecode", "CCITTFaxDecode", "CCF", "JBIG2Decode")


def decode(data: bytes, filters: list[str], parms: list[dict]) -> tuple[bytes, str | None]:
    """Apply filters in order.  Returns the bytes and the image filter that remains, if any; an unknown filter gives nothing."""
    for name, parm in zip(filters, [*parms, *[{}] * len(filters)], strict=False):
        if name in IMAGE_FILTERS:
            return data, name
        if name == "Crypt":
            continue
        if name not in FILTERS:
            return b"", None
        data = lzw(data, int(parm.get("EarlyChange", 1))) if FILTERS[name] is lzw else FILTERS[name](data)
        data = unpredict(data, *(int(parm.get(k, d)) for k, d in (("Predictor", 1), ("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1))))
    return data, None
