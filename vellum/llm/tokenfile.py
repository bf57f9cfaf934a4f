"""Token ids as directly addressable codes, with random access to any token.

Ids are split into chunks of eight bits.  Level k holds the k-th chunk of every id that has
one, with a bitmap that says whether the id goes on to the next level, and a directory of
the ones before each block of bits.  Token i is read by following at most four chunks, each
found by one rank: no block is decoded.

A file set is a Parquet table in the shared folder: a row is a segment, that is a run of
whole documents with their ids, lengths, and the bytes of the code.  Documents lie in
ascending doc_id order over segments and parts.  Spark's commit protocol makes the write
safe against lost executors, and any store that Spark reads will do.

Defined cases: a null text is empty and holds the end id alone; rows without doc_id come
first; rows that share a doc_id follow each other by text (nulls first); columns besides
doc_id and text are ignored; a segment outgrows its size only for a single long document;
an empty table gives an empty file set.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged

END_ID = 0
SEGMENT_IDS = 1 << 18
MAGIC = b"VDAC"
BLOCK_BITS = 512
#: Texts are tokenized in groups of about this many characters.
GROUP_CHARS = 1 << 18
MEMO_ENTRIES = 1_000_000
JOINED_RUNS = 2000

# ---- the code ---------------------------------------------------------------------------


def encode_ids(ids: np.ndarray) -> bytes:
    """The code of a run of unsigned 32-bit ids."""
    rest, levels = ids.astype(np.uint32), []
    while len(rest):
        more = rest > 0xFF
        bits = np.zeros(-(-len(rest) // BLOCK_BITS) * BLOCK_BITS, np.uint8)
        bits[: len(rest)] = more
        ones = bits.reshape(-1, BLOCK_BITS).sum(axis=1, dtype=np.uint32)
        ranks = (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + ranks.tobytes() + np.packbits(bits, bitorder="little").tobytes() + (rest & 0xFF).astype(np.uint8).tobytes())
        rest = rest[more] >> np.uint32(8)
    return MAGIC + struct.pack("<QB", len(ids), len(levels)) + b"".join(levels)


class Reader:
    """Random access into one code; opening it reads no chunk."""

    def __init__(self, code: bytes):
        if code[:4] != MAGIC:
            raise ValueError("not a token code")
        self.n, n_levels = struct.unpack_from("<QB", code, 4)
        self.levels, at = [], 13
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", code, at)
            blocks = -(-n // BLOCK_BITS)
            ranks, bits = at + 8, at + 8 + 4 * blocks
            chunks = bits + blocks * BLOCK_BITS // 8
            self.levels.append((np.frombuffer(code, "<u4", blocks, ranks), np.frombuffer(code, np.uint8, blocks * BLOCK_BITS // 8, bits), np.frombuffer(code, np.uint8, n, chunks)))
            at = chunks + n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (ranks, bits, chunks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK_BITS
            whole = bits[block * BLOCK_BITS // 8 : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(whole).sum()) + (int(bits[i >> 3]) & (1 << (i & 7)) - 1).bit_count()
        return value

    def all(self) -> np.ndarray:
        """Every id, by one pass over each level."""
        ids, at = np.zeros(self.n, np.uint32), None
        for k, (_, bits, chunks) in enumerate(self.levels):
            more = np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))
            if at is None:
                ids, at = chunks.astype(np.uint32), more
            else:
                ids[at] |= chunks.astype(np.uint32) << np.uint32(8 * k)
                at = at[more]
        return ids


# ---- tokenizing -------------------------------------------------------------------------

_CHUNK = re.compile(r"[ \n\t\r]+[^ \n\t\r]*|[^ \n\t\r]+")
_BLANK = frozenset(" \n\t\r")
#: White space or separators of other kinds: a text with them is given to the tokenizer whole.
_ODD = re.compile(r"[^\S \n\t\r]|[\x1c-\x1f\x0b\x0c\x85]")


class Encoder:
    """Ids of whole texts by the tokenizers library.

    The tokenizer never joins characters across the start of a run of white space, so a text
    may be encoded word by word, each with the blank or newline before it.  Each distinct word is given to the
    library once, many at a time in one string; the bytes that each token stands for tell where one word
    ends.  Texts with other white space are cut by a pattern, those with unusual kinds not at all.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes | None] = {}
        self.words: dict[str, bytes | None] = {}  # by the text after one blank, or from a newline on
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.sizes[i] = len(token)  # one character of the vocabulary file is one byte
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.sizes[i] = len(token.content.encode())

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, runs: list[str]) -> list[bytes]:
        """Ids of runs that start with white space and end without."""
        out: list[bytes] = []
        for i in range(0, len(runs), JOINED_RUNS):
            part = runs[i : i + JOINED_RUNS]
            [raw] = self._encode(["".join(part)])
            ends = np.cumsum(np.fromiter((len(r.encode()) for r in part), np.int64, len(part)))
            cuts = (4 * (np.searchsorted(np.cumsum(self.sizes[np.frombuffer(raw, "<u4")]), ends) + 1)).tolist()
            out += [raw[s:e] for s, e in zip([0, *cuts], cuts, strict=False)]
        return out

    def _learn_words(self, words: list[str]) -> None:
        """Memorise words; None for those that may not stand alone."""
        odd = [w for w in words if not w or w[-1] in _BLANK]
        if _ODD.search("".join(words)):
            odd += [w for w in words if _ODD.search(w)]
        if odd:
            self.words.update(dict.fromkeys(odd))
            words = list(set(words).difference(odd))
        self.words.update(zip(words, self._joined([w if w[0] == "\n" else " " + w for w in words]), strict=True))

    def _by_runs(self, text: str) -> bytes:
        """Ids of a text with blanks of all kinds, run by run."""
        memo, runs = self.memo, _CHUNK.findall(text)
        for r in set(runs).difference(memo):
            memo[r] = None if _ODD.search(r) else self._encode([r])[0]
        try:
            return b"".join(map(memo.__getitem__, runs))
        except TypeError:  # a run that may not stand alone
            return self._encode([text])[0]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        for memo in (self.memo, self.words):
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
        split = [t.replace("\n", " \n").split(" ") for t in texts]
        heads = [words.pop(0) for words in split]
        words = self.words
        if new := set().union(*split).difference(words):
            self._learn_words(list(new))
        out = []
        for text, head, rest in zip(texts, heads, split, strict=True):
            try:
                if head and head[-1] in _BLANK:
                    raise TypeError
                raw = (self._by_runs(head) if head else b"") + b"".join(map(words.__getitem__, rest))
            except TypeError:
                raw = self._by_runs(text)
            out.append(np.frombuffer(raw, "<u4"))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---- files ------------------------------------------------------------------------------

SEGMENTS = "part int, seq int, first long, n_ids long, doc_ids array<long>, lengths array<long>, code binary"


def _segment(part: int, seq: int, first: int, ids: list[int | None], tokens: list[np.ndarray]) -> pa.RecordBatch:
    lengths = [len(x) for x in tokens]
    one = [[part], [seq], [first], [sum(lengths)], [ids], [lengths], [encode_ids(np.concatenate(tokens))]]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(one, types, strict=True)], ["part", "seq", "first", "n_ids", "doc_ids", "lengths", "code"])


def _write(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq, first = encoder(path), TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        held = 0

        def groups() -> Iterator[tuple[list, list[str]]]:
            keys, texts, n = [], [], 0
            for batch in batches:
                for key, value in zip(batch.column(0), batch.column(1), strict=True):
                    keys.append(key.as_py())
                    texts.append(value.as_py() or "")
                    n += len(texts[-1])
                    if n >= GROUP_CHARS:
                        yield keys, texts
                        keys, texts, n = [], [], 0
            yield keys, texts

        end = np.array([END_ID], "<u4")
        for keys, texts in groups():
            for key, found in zip(keys, enc.encode(texts), strict=True):
                if ids and held + len(found) + 1 > SEGMENT_IDS:
                    yield _segment(part, seq, first, ids, tokens)
                    seq, first, ids, tokens, held = seq + 1, first + held, [], [], 0
                ids.append(key)
                tokens.append(np.concatenate((found, end)))
                held += len(found) + 1
        if ids:
            yield _segment(part, seq, first, ids, tokens)

    return run


def write(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Tokenize and write ``docs`` as a file set; returns its segments as read back."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return staged(dealt.mapInArrow(_write(tokenizer or tokenizer_path()), SEGMENTS), "tokens")


def part_starts(segments: DataFrame) -> dict[int, int]:
    """Number of ids before each part; parts are as many as the tasks that wrote them."""
    starts, n = {}, 0
    for row in sorted(segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        starts[row["part"]], n = n, n + row["n"]
    return starts


def _documents(starts: dict[int, int], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, first, keys, lengths, code = (batch.column(c)[row].as_py() for c in ("part", "first", "doc_ids", "lengths", "code"))
                ids = Reader(code).all().astype("<u4")
                ends = np.cumsum(lengths)
                begins = ends - lengths
                pieces = [ids[s:e] for s, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                out = [pa.array(keys, pa.int64()), pa.array(begins + first + starts[part]), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array(pieces, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def documents(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row a document, read from the files: its place, its length, the CRC-32 of its ids, and on demand the ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return segments.mapInArrow(_documents(part_starts(segments), with_ids), schema)


def tokens_at(segments: DataFrame, positions: DataFrame) -> DataFrame:
    """Rows (position, id) for a column ``position`` of global token positions; those outside are left out.

    A segment is found by the bucket of positions it reaches into, then one id is read from it.
    """
    starts = part_starts(segments)
    if not starts:
        return positions.select(F.col("position").cast("long"), F.lit(None).cast("long").alias("id")).limit(0)
    base = F.element_at(F.create_map(*[F.lit(v) for p, s in starts.items() for v in (p, s)]), F.col("part"))
    placed = segments.withColumn("begin", base + F.col("first")).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("begin") / SEGMENT_IDS), F.floor((F.col("begin") + F.col("n_ids") - 1) / SEGMENT_IDS))))
    asked = positions.select(F.col("position").cast("long").alias("position")).withColumn("bucket", F.floor(F.col("position") / SEGMENT_IDS))
    found = asked.join(placed.select("bucket", "begin", "n_ids", "code"), "bucket").where("position >= begin and position < begin + n_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [Reader(c.as_py())[p.as_py() - b.as_py()] for p, b, c in zip(batch.column(0), batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64())], ["position", "id"])

    return found.select("position", "begin", "code").mapInArrow(run, "position long, id long")
