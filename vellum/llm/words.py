"""Hashes of the words of texts and of runs of them, whole texts at a time in numpy.

A word is a run of bytes without white space.  Its hash is multilinear: random numbers by byte value
times random numbers by place, added up and mixed with the length; long words are hashed by XXH3.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes that are hashed at once, and bytes from which on a word is hashed by XXH3.
BLOCK_BYTES, LONG_WORD = 1 << 13, 4096
STEP, OTHER_STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_TABLES = [(mixed(np.arange(1, 257, dtype=np.uint64) * s), mixed(np.arange(1001, 1001 + LONG_WORD, dtype=np.uint64) * s) | np.uint64(1)) for s in (STEP, OTHER_STEP)]


def word_hashes(texts: list[bytes], n_hashes: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    """One or two independent hashes of the words of all texts, one text after the other, and each text's number of words."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    gap = _IS_SPACE[raw]
    edges = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1)))
    starts, ends = edges[::2], edges[1::2]
    sizes = np.diff(np.searchsorted(starts, np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))))
    lengths, out = ends - starts, [np.zeros(len(starts), np.uint64) for _ in range(n_hashes)]
    whole = np.where(lengths < LONG_WORD, lengths, 0)
    done = np.concatenate(([0], np.cumsum(whole)))
    w = 0
    while w < len(starts):
        e = max(w + 1, int(np.searchsorted(done, done[w] + BLOCK_BYTES)) - 1)
        at = np.repeat(starts[w:e] - (done[w:e] - done[w]), whole[w:e]) + np.arange(done[e] - done[w])
        place = np.arange(done[e] - done[w]) - np.repeat(done[w:e] - done[w], whole[w:e])
        some = whole[w:e] > 0
        for h, (by_byte, by_place) in zip(out, _TABLES, strict=False):
            if some.any():
                sums = np.add.reduceat(by_byte[raw[at]] * by_place[place], (done[w:e] - done[w])[some])
                h[w:e][some] = mixed(sums + whole[w:e][some].astype(np.uint64) * STEP)
        w = e
    for w in np.flatnonzero(lengths >= LONG_WORD).tolist():
        digest = xxhash.xxh3_128_digest(raw[starts[w] : ends[w]].tobytes())
        for h, part in zip(out, (digest[:8], digest[8:]), strict=False):
            h[w] = int.from_bytes(part, "big")
    return out, sizes


def stretch(h: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Hash of every run of ``size`` values."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * base
    for k in range(1, size):
        out = (out + h[k : k + n]) * base
    return mixed(out)
