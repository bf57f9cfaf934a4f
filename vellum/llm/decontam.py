"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A passage within k edits of a benchmark item of length m shares at least m - q + 1 - kq
q-grams with it, all on diagonals that lie within k of each other.  Shared q-grams are counted in
diagonal bands of twice the step 2k + 1, each overlapping the next by half, so some band in
diagonal bands of twice the step 2k + 1, each overlapping the next by half, so some band holds
all of them; only bands that reach the bound go on to a semi-global alignment of the item with the text, banded to
k diagonals on either side of those that hold the shared q-grams, and only distances within k count.

The items are the stated query set: they travel to every task in blocks of a bounded size,
one pass over the documents for each block (one block for any usual benchmark).

Comparison is on bytes after lower-casing, with each white space as one space.  Items too
short for the bound at their edit budget get the largest budget that has one; items shorter than q
must occur exactly.

Defined cases: an item with a null or blank text matches nothing; an item with a null item_id matches by its text and is returned as null; a null or empty text has no match;
repeated documents are each judged; ties between alignments take the least distance, then the earliest
end; a null doc_id is returned as it is; other columns are ignored; empty tables give no match.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged

Q = 8
EDIT_SHARE = 0.1
#: Bytes of benchmark text that travel to the tasks at once.
BLOCK_BYTES = 8 << 20
#: Pairs of a text's and the items' q-grams that are held at once.
PAIRS = 1 << 20
_BITS = 22
_BAND = 1 << 40
_SPACE = bytes(32 if c in b"\t\n\r\x0b\x0c" else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACE)


def grams(raw: bytes) -> np.ndarray:
    """The q-gram at each byte, as a number."""
    n = len(raw) - Q + 1
    return np.ndarray((n,), "<u8", raw, 0, (1,)) if n > 0 else np.zeros(0, np.uint64)


def budget(m: int, share: float = EDIT_SHARE) -> int:
    """Edits allowed for an item of length m: its share, or as many as the lemma still bounds."""
    return max(0, min(int(share * m), (m - Q) // Q))


def slots(g: np.ndarray) -> np.ndarray:
    return ((g * _ODD) >> np.uint64(64 - _BITS)).astype(np.int64)


@dataclass
class Match:
    item_id: int | None
    start: int
    end: int
    distance: int


def align(item: bytes, raw: bytes, k: int, centres: list[int]) -> tuple[int, int, int] | None:
    """Least edits of ``item`` against a stretch of ``raw`` near some diagonals: (start, end, distance), or None beyond k.

    An alignment within k edits that passes a diagonal stays within k of it, so the table has 2k + 1 diagonals
    for each centre; those that overlap are one table.
    """
    best: tuple[int, int, int] | None = None
    for first, last in _merged(centres, k):
        at = raw.find(item, max(0, first - k), max(0, last + k + len(item)))
        if at >= 0:
            got = at, at + len(item), 0
        elif k == 0:
            continue
        else:
            row, low = _banded(item, raw, first - k, last + k, free=True)
            where = int(np.argmin(row))
            if row[where] > k:
                continue
            end = low + where + len(item)
            back, turned = _banded(item[::-1], raw[max(0, end - len(item) - k) : end][::-1], -k, k, free=False)
            got = end - (turned + int(np.argmin(back)) + len(item)), end, int(row[where])
        if best is None or (got[2], got[1]) < (best[2], best[1]):
            best = got
    return best


def _merged(centres: list[int], k: int) -> Iterator[tuple[int, int]]:
    """Runs (first, last) of the sorted centres whose bands of k to either side overlap."""
    first = last = centres[0]
    for c in centres[1:]:
        if c - last > 2 * k:
            yield first, last
            first = c
        last = c
    yield first, last


def _banded(item: bytes, raw: bytes, low: int, high: int, free: bool) -> tuple[np.ndarray, int]:
    """Last row of the alignment table over the diagonals ``low`` to ``high`` (place in ``raw`` less place in ``item``), and ``low``.

    With ``free`` the item may start anywhere, else at the start of ``raw``.  Places outside ``raw`` cost too much.
    """
    n, width, never = len(raw), high - low + 1, len(item) + len(raw) + 1
    text = np.full(width + len(item) + 1, 256, np.int64)  # text[i + d] is the byte before place low + i + d
    s, e = max(0, low - 1), min(n, low + len(text) - 1)
    if e > s:
        text[s - low + 1 : e - low + 1] = np.frombuffer(raw, np.uint8, e - s, s)
    place, along = np.arange(low, high + 1), np.arange(width)
    row = np.where((place >= 0) & (place <= n), 0 if free else place, never)
    for i, c in enumerate(item, 1):
        best = row + (text[i : i + width] != c)
        np.minimum(best[:-1], row[1:] + 1, out=best[:-1])
        at = place + i
        best[(at < 0) | (at > n)] = never
        if not free and 0 <= -i - low < width:
            best[-i - low] = i
        row = np.minimum.accumulate(best - along) + along
    return row, low


class Index:
    """q-grams of a block of items, with their places."""

    def __init__(self, items: list[tuple[int | None, bytes]], share: float = EDIT_SHARE):
        self.items = items
        self.short = [(i, x) for i, (_, x) in enumerate(items) if len(x) < Q]
        self.k = np.array([budget(len(x), share) for _, x in items], np.int64)
        self.need = np.array([len(x) - Q + 1 - k * Q for (_, x), k in zip(items, self.k.tolist(), strict=True)], np.int64)
        per = [grams(x) for _, x in items]
        key = np.concatenate([*per, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(items)), [len(g) for g in per]) if items else np.zeros(0, np.int64)
        place = np.concatenate([*(np.arange(len(g)) for g in per), np.zeros(0, np.int64)])
        order = np.argsort(key, kind="stable")
        self.item, self.place = item[order], place[order].astype(np.int64)
        self.keys, self.first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.of_key = np.repeat(np.arange(len(self.keys)), self.count)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[slots(self.keys)] = True

    def matches(self, text: str | None) -> list[Match]:
        raw = normal(text)
        found = [Match(self.items[i][0], at, at + len(x), 0) for i, x in self.short if (at := raw.find(x)) >= 0]
        g = grams(raw)
        p = np.flatnonzero(self.seen[slots(g)])
        if not len(p) or not len(self.keys):
            return found
        at = np.minimum(np.searchsorted(self.keys, g[p]), len(self.keys) - 1)
        same = self.keys[at] == g[p]
        p, at = p[same], at[same]
        best: dict[int, Match] = {}
        for i, centres in self._candidates(p, at):
            item_id, x = self.items[i]
            if i in best and best[i].distance == 0:
                continue  # bands come in order, so no later one ends earlier
            got = align(x, raw, int(self.k[i]), centres)
            if got and (i not in best or (got[2], got[1]) < (best[i].distance, best[i].end)):
                best[i] = Match(item_id, *got)
        return found + list(best.values())

    def _hits(self, p: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, place, diagonal) of the pairs of a text's q-grams ``at`` (sorted by ``p``) and the items', in arrays of bounded size.

        Where q-grams repeat so often that the pairs are many, of a q-gram's places in a stretch of
        the text as long as an item's step only the first and last are paired: the others fall into the same bands.
        """
        n = self.count[at]
        if int(n.sum()) <= PAIRS:
            yield self._paired(p, at, self.first, n)
            return
        for k in np.unique(self.k).tolist():
            pick = np.flatnonzero(self.k[self.item] == k)  # in the order of the keys
            own = np.searchsorted(self.of_key[pick], np.arange(len(self.keys) + 1))
            first, count = own[:-1], np.diff(own)
            held = count[at] > 0
            pk, ak = p[held], at[held]
            if not len(pk):
                continue
            order = np.argsort(ak, kind="stable")
            pk, ak = pk[order], ak[order]
            cell = pk // (2 * k + 1)
            new = np.concatenate(([True], (ak[1:] != ak[:-1]) | (cell[1:] != cell[:-1])))
            ends = new | np.concatenate((new[1:], [True]))
            pk, ak = pk[ends], ak[ends]
            total = np.cumsum(count[ak])
            cuts = np.unique(np.concatenate(([0], np.searchsorted(total, np.arange(PAIRS, int(total[-1]) + PAIRS, PAIRS)) + 1)).clip(0, len(pk)))
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield self._paired(pk[s:e], ak[s:e], first, count[ak[s:e]], pick)

    def _paired(self, p: np.ndarray, at: np.ndarray, first: np.ndarray, n: np.ndarray, pick: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hit = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        if pick is not None:
            hit = pick[hit]
        return self.item[hit], self.place[hit], np.repeat(p, n) - self.place[hit]

    def _candidates(self, p: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Items and diagonals to align at, one band after the other.

        The lemma speaks of an item's q-grams, so one that occurs again in the band counts once.  An alignment has at
        most k + 1 diagonals, so one of them holds its share of the q-grams that the bound asks for.
        """
        longest = int(self.place.max()) + 1
        seen, lines = [], []
        for item, place, diagonal in self._hits(p, at):
            code = item * _BAND + diagonal // (2 * self.k[item] + 1) + (_BAND >> 1)
            both, where = np.concatenate((code, code - 1)), np.concatenate((place, place))
            codes, index = np.unique(both, return_inverse=True)
            pairs = np.unique(index * longest + where)
            seen.append((codes[pairs // longest], pairs % longest))
            line, held = np.unique(item * _BAND + diagonal + (_BAND >> 1), return_counts=True)
            lines.append((line, held))
        codes, index = np.unique(np.concatenate([c for c, _ in seen]), return_inverse=True)
        pairs = np.unique(index * longest + np.concatenate([x for _, x in seen])) if len(seen) > 1 else index * longest + seen[0][1]
        enough = codes[np.bincount(pairs // longest, minlength=len(codes)) >= self.need[codes // _BAND]]
        if not len(enough):
            return
        line, index = np.unique(np.concatenate([x for x, _ in lines]), return_inverse=True)
        held = np.bincount(index, np.concatenate([n for _, n in lines]))
        many = len(seen) > 1
        for c in enough.tolist():
            i, b = c // _BAND, c % _BAND - (_BAND >> 1)
            k, step = int(self.k[i]), 2 * int(self.k[i]) + 1
            zero = i * _BAND + (_BAND >> 1)
            if many:  # diagonals were thinned out, so the whole band is met
                yield i, [*range(b * step, (b + 2) * step - 1, max(1, k)), (b + 2) * step - 1]
                continue
            s, e = np.searchsorted(line, [zero + b * step, zero + (b + 2) * step]).tolist()
            share = -(-int(self.need[i]) // (k + 1))
            centres = (line[s:e][held[s:e] >= share] - zero).tolist()
            if centres:
                yield i, centres


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in lists that each fit a task, one at a time; their number grows with the benchmark."""
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n = -(-size // BLOCK_BYTES)
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        items = sorted({(r.item_id, x) for r in part.toLocalIterator() if (x := normal(r.text).strip())}, key=lambda i: (i[0] is None, i[0] or 0, i[1]))
        if items:
            yield items


def _match_rows(items: list[tuple[int | None, bytes]], share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, share)
        for batch in batches:
            rows = [(doc.as_py(), m.item_id, m.start, m.end, m.distance) for doc, text in zip(batch.column(0), batch.column(1), strict=True) for m in index.matches(text.as_py())]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "match_start", "match_end", "distance"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """Rows (doc_id, item_id, match_start, match_end, distance): the best match of each item in each document that has one.

    Places are bytes of the lower-cased text.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, match_start long, match_end long, distance long"
    out = texts.sparkSession.createDataFrame([], schema)
    for n, items in enumerate(blocks(benchmark)):
        found = texts.mapInArrow(_match_rows(items, share), schema)
        out = found if n == 0 else (staged(out, "leaks") if n == 1 else out).union(staged(found, "leaks"))  # a block leaves the driver before the next one comes
    return out


def clean(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    small_batches(docs.sparkSession)
    at, schema = docs.columns.index("text"), docs.schema
    for n, items in enumerate(blocks(benchmark)):

        def run(batches: Iterator[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            index = Index(items, share)
            for batch in batches:
                yield batch.filter(pa.array([not index.matches(t.as_py()) for t in batch.column(at)], pa.bool_()))

        docs = (docs if n == 0 else staged(docs, "clean")).mapInArrow(run, schema)
    return docs
