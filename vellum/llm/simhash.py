"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's 64-bit fingerprint is a majority vote over the XXH64 values of its word
shingles.  Two fingerprints link when they differ in at most ``radius`` bits.  To find all
links, every bit position is mapped to a nonzero vector of radius+1 bits; for each nonzero
vector v, the mask of v keeps the positions whose vector has odd inner product with v.  At
most ``radius`` differing positions always leave some v orthogonal to all of them, and under
that mask the two fingerprints agree: no pair within the radius is missed.

Defined cases: a null or blank text has fingerprint zero and is linked like any other;
equal texts share a fingerprint, so copies are one node; rows with a null doc_id get a
fingerprint but never give a component its id (null if the component has no other id);
columns besides doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from .common import hot_keys, marked, marks, on_label, pair_components, release, small_batches, staged

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: Members of a bucket that one task compares at once; larger buckets are cut by further masks, but for
#: those whose mask leaves out so few bits that they cannot be much larger.
BLOCK, SMALL_BITS = 4096, 11


def simhash64(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """Fingerprint of one text as an unsigned 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    hashed, seed = xxhash.xxh64_intdigest, SEED
    values = np.fromiter((hashed(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    votes = bit_counts(values.astype(">u8").view(np.uint8).reshape(-1, 8))
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How often each bit is set over rows of a multiple of eight bytes; eight counts are added in one number."""
    votes = np.zeros(8 * rows.shape[1], np.int64)
    for i in range(0, len(rows), 255):
        votes += np.unpackbits(rows[i : i + 255], axis=1).view(np.uint64).sum(axis=0).view(np.uint8)
    return votes


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((simhash64(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints.view(np.int64))], ["doc_id", "row", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, row, fp): the row's content number and its fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", numbered(docs).alias("row")).mapInArrow(_fingerprint, "doc_id long, row long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The 2**(radius+1)-1 bit masks, as signed longs."""
    top = (1 << (radius + 1)) - 1
    vectors = [1 + i % top for i in range(bits)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, top + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what links of at most ``radius`` bits connect among ``prints``.

    Breadth first: each reached value is compared with those not reached yet, so a tight
    group costs little more than its size.
    """
    rest, left, right = prints, [], []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                left.append(np.full(len(found), x))
                right.append(found)
                queue.extend(found)
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def refining_masks(kept: int, radius: int) -> list[int]:
    """Masks that hold ``kept`` and cover the positions it leaves out, as signed longs.

    Two fingerprints that agree on ``kept`` and differ in at most ``radius`` bits agree under one of them.
    """
    top = (1 << (radius + 1)) - 1
    stride = next(k for k in range(top // 3 + 1, 2 * top + 2) if math.gcd(k, top) == 1)
    left = [i for i in range(64) if not kept >> i & 1]
    vectors = [1 + i * stride % top for i in range(len(left))]
    masks = {(kept | sum(1 << i for i, m in zip(left, vectors, strict=True) if (m & v).bit_count() & 1)) & (1 << 64) - 1 for v in range(1, top + 1)}
    return sorted(m - (1 << 64) if m >> 63 else m for m in masks)


def _bucket_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches are sorted by mask and key; a bucket may go on in the next batch."""
        carry: list[np.ndarray] = []
        key_now: tuple[int, int] | None = None

        def flush() -> Iterator[pa.RecordBatch]:
            prints = np.concatenate(carry)
            if len(prints) > 1:
                a, b = forest(prints, radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            mask, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(fp):
                continue
            fp = fp.view(np.uint64)
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fp)]))
            last = len(starts) - 1
            many = (ends - starts > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == last)
            for s, e in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
                if key_now != (now := (int(mask[s]), int(key[s]))):
                    if carry:
                        yield from flush()
                    carry, key_now = [], now
                carry.append(fp[s:e])
        if carry:
            yield from flush()

    return run


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows (a, b) over distinct fingerprints ``fp``: enough links to connect all that link.

    Buckets are counted before anything moves.  One over ``BLOCK`` members is cut by covering
    masks of the bits that its own mask leaves out, again until it is small enough or has so few
    bits left that it must be: memory is bounded, no task gets a hot bucket whole, rows grow
    by the number of masks and not by pairs, and no link is lost.
    """
    spark, out = prints.sparkSession, []
    prints = prints.select("fp")
    now = prints.select("fp", F.explode(F.array(*[F.lit(m) for m in covering_masks(radius)])).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    while True:
        hot = hot_keys(now.where(64 - F.bit_count("mask") > SMALL_BITS), ["mask", "key"], BLOCK).select("mask", "key")
        masks = [r["mask"] for r in hot.select("mask").distinct().collect()]  # at most the masks of a level, whatever the data
        cold = now.join(hot, ["mask", "key"], "left_anti") if masks else now
        dealt = cold.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key")
        out.append(staged(dealt.mapInArrow(_bucket_links(radius), "a long, b long"), "simhash-links"))
        release(spark)
        if not masks:
            return functools.reduce(DataFrame.union, out).distinct()
        finer = spark.createDataFrame([(m, refining_masks(m, radius)) for m in masks], "mask long, finer array<long>")
        cut = now.join(hot, ["mask", "key"], "left_semi").join(F.broadcast(finer), "mask").select("fp", F.explode("finer").alias("mask"))
        now = staged(cut.distinct().withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))), "simhash-finer")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows (doc_id, row, fp, component_id, label), one for each row of ``docs``; label names the component among fingerprints."""
    rows = staged(fingerprints(docs), "simhash-prints")
    return grouped(rows, pair_components(links(rows.select("fp").distinct(), radius), "simhash-parts"), "simhash-parts")


def grouped(rows: DataFrame, parts: DataFrame, tag: str) -> DataFrame:
    """``rows`` (doc_id, fp, ...) with the label that ``parts`` (node, label) give fp, and the component_id: the label's least doc_id."""
    release(rows.sparkSession)
    reps = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    own = staged(reps.join(parts.withColumnRenamed("node", "fp"), "fp", "left"), tag)
    linked = own.where("label is not null")
    least = linked.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = on_label(linked, least, "label", "fp").select("fp", "component_id", "label")
    every = named.union(own.where("label is null").select("fp", F.col("rep").alias("component_id"), F.col("fp").alias("label")))
    return rows.join(every, "fp").select(*rows.columns, "component_id", "label")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component, see ``one_each``."""
    return one_each(docs, near_duplicates(docs, radius))


def one_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of ``found`` (doc_id, row, component_id, label): the one whose doc_id names it.

    Of rows that share this doc_id, the one of the least content number stays; of equal rows, one.  A row without
    doc_id stays only where its component has no doc_id at all.  Two maps of bits, of the rows that go or are
    repeated and of those that stay, settle most rows where they lie; texts move only for rows with a bit in both.
    """
    found = staged(found, "near-found")
    named = found.where("doc_id = component_id").groupBy("doc_id").agg(F.min("row").alias("row"))
    loose = found.where("component_id is null").groupBy("label").agg(F.min("row").alias("row"))
    chosen = staged(named.select("row").union(loose.select("row")).select(F.col("row").alias("_row")), "near-kept")
    counts = found.groupBy(F.col("row").alias("_row")).agg(F.count("*").alias("n")).join(chosen.withColumn("_stays", F.lit(True)), "_row", "left")
    loss = marks(counts.where("_stays is null or n > 1"), "_row")
    rows = marked(docs.withColumn("_row", numbered(docs)), "_row", loss, "_lost")
    unsure = marked(rows.where("_lost"), "_row", marks(chosen, "_row"), "_stays").where("_stays").drop("_stays")
    kept = unsure.join(chosen, "_row", "left_semi").dropDuplicates(["_row"])
    return rows.where("not _lost").unionByName(kept).drop("_row", "_lost")


def numbered(docs: DataFrame) -> Column:
    """A number of a row's whole content; only equal rows share one."""
    return F.xxhash64(*[F.coalesce(F.to_json(c) if isinstance(t, (ArrayType, MapType, StructType)) else F.col(c).cast("string"), F.lit("\0null")) for c, t in ((f.name, f.dataType) for f in docs.schema)])
