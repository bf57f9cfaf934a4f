"""Every filter and prediction read back, on awkward bytes."""

import itertools
import random
import time

import pytest

from vellum.sources import codec, encode

rng = random.Random(4)
SAMPLES = [b"", b"a", b"aa", b"aaa", bytes(5000), bytes(range(256)) * 40, b"ab" * 3000 + b"c" * 300, rng.randbytes(20001), bytes(rng.choices(b"ab", k=30000)), b"\0\0\0\0abcd\0\0\0"]


@pytest.mark.parametrize("name", encode.FILTERS)
def test_filters(name):
    for data in SAMPLES:
        for early in (0, 1) if name == "LZWDecode" else (1,):
            parms = [{"EarlyChange": early}]
            assert codec.decode(encode.encode(data, [name], parms), [name], parms) == (data, None)


@pytest.mark.parametrize("predictor", [2, 10, 11, 12, 13, 14])
def test_predictions(predictor):
    for data in SAMPLES:
        for columns in (1, 7, 64):
            parms = [{}, {"Predictor": predictor, "Columns": columns}]
            names = ["ASCII85Decode", "FlateDecode"]
            assert codec.decode(encode.encode(data, names, parms), names, parms) == (data, None)


def test_rows_under_prediction_byte_by_byte():
    """Rows of all lengths, also with a short last one; many short rows take no step of their own each."""
    rng = random.Random(9)
    for n, columns in itertools.product((0, 1, 5, 16, 33, 100), (1, 2, 5, 16, 40)):
        data = bytes(rng.choice([0, 1, 97, 255, rng.randrange(256)]) for _ in range(n))
        for kind in range(5):
            want = bytearray()
            for at in range(0, n, columns):
                row, above = data[at : at + columns], data[at - columns : at] if at else bytes(columns)
                want.append(kind)
                for i, v in enumerate(row):
                    a, b, c = row[i - 1] if i else 0, above[i], above[i - 1] if i else 0
                    paeth = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                    want.append(v - (0, a, b, (a + b) // 2, paeth)[kind] & 255)
            assert encode.png_rows(data, columns, kind) == bytes(want)
            assert codec.unpredict(bytes(want), 10 + kind, columns=columns) == data
        assert codec.unpredict(encode.tiff_rows(data, columns), 2, columns=columns) == data
    data = bytes(rng.randrange(97, 123) for _ in range(1 << 20))
    began = time.process_time()
    assert codec.unpredict(encode.png_rows(data, 16, 2), 12, columns=16) == data
    assert codec.ascii85(encode.ascii85(data)) == data
    assert time.process_time() - began < 0.5  # row by row over a second


def test_lzw_of_a_table_that_stays_full_and_of_damage():
    """Codes are read in parts: one after the other from a full table that is never cleared, and up to what is no code."""
    codes, bits, width = [rng.randrange(256) for _ in range(9000)], "", 9
    for k, code in enumerate([256, *codes, 257]):
        bits += format(code, f"0{width}b")
        width = 9 + sum(min(4096, 257 + k) + 1 >= n for n in (512, 1024, 2048)) if k else 9
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert codec.lzw(data) == bytes(codes)
    assert [len(part) for _, part in codec._lzw_runs(data, 1)] == [0, 4096, 4096, 808]
    assert codec.lzw(data[:1000]) == bytes(codes)[: len(codec.lzw(data[:1000]))] and len(codec.lzw(data[:1000])) > 700
    assert codec.lzw(bytes([0x80, 0x10, 0x60, 0x7F, 0xFF])) == b"A"  # 256, 65, then a code beyond the table
