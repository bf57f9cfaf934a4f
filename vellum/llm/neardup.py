"""SimHash near-duplicates of five-word shingle sets, at a similarity of 0.8 or more.

The operator of ``simhash`` with wide fingerprints, for edited copies: a text's distinct shingles vote on ``PARTS``
fingerprints of ``PART_BITS`` bits each, and covering masks of radius ``PART_RADIUS`` over each part make the buckets.
Two texts that differ in at most PARTS * (PART_RADIUS + 1) - 1 bits over all parts differ in at most
PART_RADIUS in some part, and so always meet.  At a Jaccard similarity of just 0.8 an eighth to a sixth of the bits differ, which is
beyond that; such pairs meet in one of the 150 buckets by chance, with the probability that the
README gives.  A radius that covered them for sure would take over ten thousand masks.

Members of a bucket that differ in at most ``CHECK_BITS`` bits of a separate 64-bit print are candidates, and
candidates link if the Jaccard similarity of their whole shingle sets is at least ``SIMILAR``; groups are
what links connect.  Of each text the candidate that it meets in most buckets is verified first.  Then small buckets compare all members
that this leaves apart, and large ones each with a few leaders.  After that only members of large buckets that these links leave
apart are met, where they share a rare shingle or their numbers of frequent shingles allow the similarity.  So a large group
costs in proportion to its size, tight or not, unless many of its members have almost no rare shingle and yet are
not similar, and no similar pair of candidates is left out.  Buckets over ``BLOCK`` are dealt over many tasks.

Defined cases: words are split at white space, letters A to Z in lower case; a text of fewer
than five words is one shingle, a null or blank text is the empty shingle; equal texts are one
node; rows with a null doc_id never give a component its id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, marked, marks, pair_components, release, small_batches, staged
from .simhash import BLOCK, bit_counts, covering_masks, forest, grouped, numbered, one_each
from .words import STEP, mixed, stretch, word_hashes

SHINGLE_WORDS = 5
#: Least Jaccard similarity of a link, as a fraction.
SIMILAR = (4, 5)
PARTS, PART_BITS, PART_RADIUS = 10, 40, 3
CHECK_BITS = 18
#: Texts that share a bucket and are met all by all; more than these go by leaders and by labels.
LARGE = 4
#: Bytes of texts that are hashed at once.
GROUP_BYTES = 1 << 16
#: Characters of texts whose shingle sets are held while pairs are verified.
SLICE_CHARS = 1 << 22
#: Bins in which the shingles of a text are counted for a bound on the similarity, and the bits of their number.
SKETCH_BITS = 8
SKETCH_BINS = 1 << SKETCH_BITS
#: Shingles that at most so many texts have are rare; they are counted in bins, and these are dealt by blocks (bits of both numbers).
RARE, RARE_BITS, RARE_BLOCK = 64, 24, 16
#: Bits of the number of bins that buckets are counted in, at most so many numbers reach the driver.
BIN_BITS = 16
_KEYED = "key long, fp long, check long"
#: Bucket rows that a task looks at together.
CHUNK = 1 << 16


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles' numbers in ascending order: hashes over the hashes of their words."""
    return next(shingle_sets([text]))


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """``shingles`` of each text, hashed in groups of about ``GROUP_BYTES``."""
    group: list[bytes] = []
    for i, text in enumerate(texts):
        group.append((text or "").encode("utf-8", "surrogatepass").lower())
        if i + 1 < len(texts) and sum(map(len, group)) < GROUP_BYTES:
            continue
        [low], sizes = word_hashes(group)
        runs, ends = stretch(low, SHINGLE_WORDS, STEP).view(np.int64), np.cumsum(sizes)
        for s, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            if e - s < SHINGLE_WORDS:
                yield np.array([xxhash.xxh64_intdigest(low[s:e].tobytes())], np.uint64).view(np.int64)
                continue
            found = np.sort(runs[s : e - SHINGLE_WORDS + 1])
            yield found[np.concatenate(([True], found[1:] != found[:-1]))]
        group = []


def node() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


_STEPS = (np.arange(1, PARTS + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]


def wide_print(found: np.ndarray) -> np.ndarray:
    """Of a set of shingle numbers: the parts, then the check print, as signed longs."""
    votes = np.zeros(64 * (PARTS + 1), np.int64)
    for i in range(0, len(found), 1 << 14):
        h = found[i : i + (1 << 14)].view(np.uint64)[:, None] + _STEPS
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        votes += bit_counts((h ^ (h >> np.uint64(31))).view(np.uint8).reshape(len(h), -1))
    words = np.packbits(2 * votes > len(found)).view(np.uint64)
    words[:PARTS] >>= np.uint64(64 - PART_BITS)
    return words.view(np.int64)


def _print_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([wide_print(found) for found in shingle_sets(batch.column(1).to_pylist())], np.int64).reshape(batch.num_rows, PARTS + 1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * PARTS), pa.array(prints[:, :PARTS].ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints[:, PARTS].copy()), lists], ["fp", "check", "parts"])


_MASKS = np.array(covering_masks(PART_RADIUS, PART_BITS), np.int64)


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """Of each text (a row) its buckets' keys: the bits that a mask keeps of a part, and above them the number of part and mask."""
    parts = batch.column(batch.schema.get_field_index("parts")).values.to_numpy().reshape(batch.num_rows, PARTS, 1)
    return ((parts & _MASKS) | (np.arange(PARTS * len(_MASKS)).reshape(PARTS, -1) << PART_BITS)).reshape(batch.num_rows, -1)


def _bins(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.view(np.uint64)) >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def _count_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(1 << BIN_BITS, np.int64)
    for batch in batches:
        n += np.bincount(_bins(_keys(batch)).ravel(), minlength=len(n))
    found = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[found])], ["bin", "n"])


def _bucket_keys(full: np.ndarray | None):
    """Rows (key, fp, check), all of them or those of the bins ``full``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch)
            fp, check = (np.repeat(batch.column(c).to_numpy(), keys.shape[1]) for c in ("fp", "check"))
            rows = keys.ravel(), fp, check
            if full is not None:
                held = full[_bins(rows[0])]
                rows = tuple(c[held] for c in rows)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["key", "fp", "check"])

    return run


def hot_buckets(prints: DataFrame) -> DataFrame | None:
    """Rows (key, n, lead) of the buckets of over ``BLOCK`` texts, if there are any.

    Keys are first counted in a fixed number of bins, within the tasks; only keys of bins over the limit are counted singly.
    """
    bins = prints.mapInArrow(_count_bins, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK).select("bin").collect()
    if not bins:
        return None
    full = np.zeros(1 << BIN_BITS, bool)
    full[[r.bin for r in bins]] = True
    some = prints.mapInArrow(_bucket_keys(full), _KEYED).groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("fp", "check")).alias("lead"))
    return staged(some.where(F.col("n") > BLOCK), "near-hot")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows (key, fp, check) sorted by key in arrays that end where a bucket does or is over BLOCK."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def joined() -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(c) for c in zip(*held, strict=True))

    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
        n += batch.num_rows
        if n >= CHUNK:
            rows = joined()
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            cut = cut if n - cut < BLOCK else n
            yield tuple(c[:cut] for c in rows)
            held, n = [tuple(c[cut:] for c in rows)], n - cut
    if held:
        yield joined()


_FOUND = "member boolean, a long, b long, key long"


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b), a below b, with key 1 where their bucket is large, and the members (a, with print b) of large buckets."""
    last = None
    for key, fp, check in _runs(batches):
        if not len(key):
            continue
        new = np.concatenate(([True], key[1:] != key[:-1]))
        bucket, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        small, print64 = sizes[bucket] <= LARGE, check.view(np.uint64)
        member = ~small | (key == last)  # the rest of a bucket that was too large for one run is of a large one
        last = key[-1]
        left, right, few = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for d in range(1, LARGE):
            at = np.flatnonzero((bucket[d:] == bucket[:-d]) & small[:-d])
            if not len(at):
                break
            at = at[np.bitwise_count(print64[at] ^ print64[at + d]) <= CHECK_BITS]
            left.append(fp[at])
            right.append(fp[at + d])
            few += len(at)
        for b in np.flatnonzero(sizes > LARGE).tolist():
            s, e = int(starts[b]), int(starts[b] + sizes[b])
            for x, y in forest_of(fp[s:e], print64[s:e]):
                left.append(x)
                right.append(y)
        a, b = np.concatenate(left), np.concatenate(right)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), bool)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array((np.arange(len(a)) >= few).astype(np.int64))], ["member", "a", "b", "key"])
        if member.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(int(member.sum()), bool)), pa.array(fp[member]), pa.array(check[member]), pa.array(key[member])], ["member", "a", "b", "key"])


def forest_of(fp: np.ndarray, print64: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes that connect what candidates connect in a bucket; equal prints go through the first node that has them."""
    prints, first, at = np.unique(print64, return_index=True, return_inverse=True)
    heads = fp[first][at]
    yield heads[heads != fp], fp[heads != fp]
    a, b = forest(prints[np.argsort(fp[first])], CHECK_BITS)
    yield fp[first][np.searchsorted(prints, a)], fp[first][np.searchsorted(prints, b)]


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, x, y) that are similar enough; a text is hashed once for all pairs of a slice that it stands in."""
    most, least = SIMILAR
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep: list[bool] = []
        while len(keep) < len(a):
            texts: dict[int, str | None] = {}
            start, held = len(keep), 0
            for end in range(start, len(a)):
                for node_id, column in ((a[end], 2), (b[end], 3)):
                    if node_id not in texts:
                        texts[node_id] = batch.column(column)[end].as_py()
                        held += len(texts[node_id] or "")
                if held >= SLICE_CHARS:
                    break
            sets = dict(zip(texts, shingle_sets(list(texts.values())), strict=True))
            for i in range(start, end + 1):
                x, y = sets[a[i]], sets[b[i]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(least * both >= most * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text the size of its shingle set, and how many shingles fall into each of ``SKETCH_BINS`` bins."""
    for batch in batches:
        sets = list(shingle_sets(batch.column(1).to_pylist()))
        bins = [np.bincount(mixed(found.view(np.uint64)) >> np.uint64(64 - SKETCH_BITS), minlength=SKETCH_BINS).astype("<u4") for found in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.clip(max=0xFFFF).astype("<u2").tobytes() for x in bins], pa.binary())], ["fp", "n", "bins"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, m, n, x, y) whose counts in bins allow the similarity: sets differ in no fewer shingles than their counts do."""
    most, least = SIMILAR
    for batch in batches:
        m, n = (batch.column(i).to_numpy() for i in (2, 3))
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, SKETCH_BINS).astype(np.int32) for i in (4, 5))
        # |X n Y| / |X u Y| >= most / least, as |X u Y| = (m + n + differing) / 2
        yield batch.select(["a", "b"]).filter(pa.array((least + most) * np.abs(x - y).sum(axis=1) <= (least - most) * (m + n)))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (fp, text) of the staged nodes ``fp``; other texts are left where they lie."""
    rows = marked(docs.select(node().alias("fp"), "text"), "fp", marks(wanted, "fp"), "_held").where("_held").drop("_held")
    return staged(rows.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("text").alias("text")), "near-texts")


def similar(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the staged pairs (a, b) of nodes whose texts are similar enough.

    Counts of shingles in bins are met first; texts move only for pairs that these do not rule out.
    """
    small_batches(pairs.sparkSession)
    sketches = staged(texts.mapInArrow(_sketches, "fp long, n long, bins binary"), "near-sketches")
    met = pairs.join(sketches.selectExpr("fp as a", "n as m", "bins as x"), "a").join(sketches.selectExpr("fp as b", "n", "bins as y"), "b")
    possible = staged(met.select("a", "b", "m", "n", "x", "y").mapInArrow(_possible, "a long, b long"), "near-possible")
    left, right = texts.selectExpr("fp as a", "text as x"), texts.selectExpr("fp as b", "text as y")
    found = staged(possible.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long"), "near-links")
    for frame in (sketches, possible):
        discard(frame)
    release(pairs.sparkSession)
    return found


def _labelled(rows: DataFrame, parts: DataFrame, node: str, label: str) -> DataFrame:
    """``rows`` with the label of a node; nodes without links are their own."""
    known = parts.select(F.col("node").alias(node), F.col("label").alias(label))
    return rows.join(known, node, "left").withColumn(label, F.coalesce(label, node))


def _shingle_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By block of bins: the bins that shingles fall into, and how many do."""
    for batch in batches:
        if batch.num_rows:
            bins, n = np.unique(_rare_bins(np.concatenate(list(shingle_sets(batch.column(1).to_pylist())))), return_counts=True)
            blocks, starts = np.unique(bins >> RARE_BLOCK, return_index=True)
            cuts = pa.array([*starts, len(bins)], pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(c.astype(np.int64))) for c in (bins, n)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks), *lists], ["block", "bins", "n"])


def _rare_bins(found: np.ndarray) -> np.ndarray:
    return (mixed(found.view(np.uint64)) >> np.uint64(64 - RARE_BITS)).astype(np.int64)


def _full_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By block: the bits of its bins that hold over ``RARE`` shingles."""
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, block in enumerate(batch.column(0).to_pylist()):
            bins, n = (batch.column(c)[i].values.to_numpy() for c in (1, 2))
            counts.setdefault(block, np.zeros(1 << RARE_BLOCK, np.int32))[bins & ((1 << RARE_BLOCK) - 1)] += n.astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array([np.packbits(n > RARE).tobytes() for n in counts.values()], pa.binary())], ["block", "bits"])


def _rare_first(full: np.ndarray):
    """Of each text the size of its set, the number of its shingles that may be frequent, and the rare ones among the first by rarity and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, least = SIMILAR
        for batch in batches:
            sizes, frequent, first = [], [], []
            for found in shingle_sets(batch.column(1).to_pylist()):
                bins = _rare_bins(found)
                rare = found[full[bins >> 3] >> (7 - (bins & 7)).astype(np.uint8) & 1 == 0]
                sizes.append(len(found))
                frequent.append(len(found) - len(rare))
                first.append(rare[: len(found) * (least - most) // least + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(frequent, pa.int64()), pa.array(first, pa.list_(pa.int64()))], ["fp", "n", "h", "first"])

    return run


def _members_apart(docs: DataFrame, members: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Staged (texts, pairs): pairs of members of large buckets that links leave apart, without those that cannot be similar.

    Two similar sets share one of their first shingles in any order of all shingles.  With rare ones before
    frequent ones this is either a rare one, which at most ``RARE`` texts have, or all that they share is frequent;
    then the numbers of frequent shingles bound the similarity, and only members whose numbers allow it with some
    member of another label are met by pairs.  Buckets of one label cost no pair.
    """
    spark, (most, least) = docs.sparkSession, SIMILAR
    own = staged(_labelled(members, parts, "fp", "label"), "near-members")
    mixed = own.groupBy("key").agg(F.min("label").alias("_least"), F.max("label").alias("_most")).where("_least <> _most").select("key")
    own = staged(own.join(mixed, "key", "left_semi"), "near-apart")
    nodes = staged(own.select("fp", "label").distinct(), "near-nodes")
    if nodes.isEmpty():
        return None
    texts = texts_of(docs, nodes.select("fp"))
    small_batches(spark)
    blocks = texts.mapInArrow(_shingle_counts, "block long, bins array<long>, n array<long>").repartition("block").mapInArrow(_full_blocks, "block long, bits binary")
    full = np.zeros((1 << (RARE_BITS - RARE_BLOCK), 1 << (RARE_BLOCK - 3)), np.uint8)
    for block, bits in blocks.collect():  # a fixed number of bits
        full[block] = np.frombuffer(bits, np.uint8)
    facts = staged(texts.mapInArrow(_rare_first(full.ravel()), "fp long, n long, h long, first array<long>"), "near-facts")
    rare = staged(facts.select("fp", F.explode("first").alias("shingle")).join(nodes, "fp"), "near-rare")
    pairs = rare.alias("l").join(rare.alias("r"), F.expr("l.shingle = r.shingle and l.fp < r.fp and l.label <> r.label")).selectExpr("l.fp as a", "r.fp as b")
    allowed = f"{most + least} * least(l.h, r.h) >= {most} * (l.n + r.n)"
    heavy = staged(own.join(facts.where(f"{least} * h >= {most} * n").select("fp", "n", "h"), "fp"), "near-heavy")
    kinds = staged(heavy.groupBy("key", "n", "h").agg(F.min("label").alias("least"), F.max("label").alias("most")), "near-kinds")
    open_kinds = kinds.alias("l").join(kinds.alias("r"), F.expr(f"l.key = r.key and {allowed} and (l.least <> r.most or l.most <> r.least)"), "left_semi").select("key", "n", "h")
    left = staged(heavy.join(open_kinds, ["key", "n", "h"], "left_semi"), "near-open")
    met = left.alias("l").join(left.alias("r"), F.expr(f"l.key = r.key and l.fp < r.fp and l.label <> r.label and {allowed} and bit_count(l.check ^ r.check) <= {CHECK_BITS}"))
    return texts, staged(pairs.union(met.selectExpr("l.fp as a", "r.fp as b")).distinct(), "near-late")


def components(docs: DataFrame) -> DataFrame:
    """Rows (node, label): the components of the nodes that links connect; nodes without links are left out."""
    spark = docs.sparkSession
    small_batches(spark)
    prints = staged(docs.select(node().alias("fp"), "text").mapInArrow(_print_rows, "fp long, check long, parts array<long>"), "near-prints")
    prints = staged(prints.dropDuplicates(["fp"]), "near-texts")
    hot = hot_buckets(prints)
    rows = prints.mapInArrow(_bucket_keys(None), _KEYED)
    if hot is None:
        dealt = rows.repartition("key")
    else:  # the rows of hot buckets are dealt over tasks
        rows = rows.join(hot, "key", "left")
        salt = F.coalesce(F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / BLOCK)).cast("int"), F.lit(0))
        dealt = rows.withColumn("salt", salt).repartition("key", "salt")
    found = staged(dealt.sortWithinPartitions("key").select("key", "fp", "check").mapInArrow(_bucket_rows, _FOUND), "near-buckets")
    release(spark)
    pairs = found.where("not member").select("a", "b", F.col("key").alias("large"))
    if hot is not None:
        led = rows.where(f"n is not null and fp <> lead.fp and bit_count(check ^ lead.check) <= {CHECK_BITS}")
        pairs = pairs.union(led.selectExpr("least(lead.fp, fp) as a", "greatest(lead.fp, fp) as b", "1L as large"))
    pairs = staged(pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("large").alias("large")), "near-candidates")
    texts = texts_of(docs, staged(pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct(), "near-wanted"))
    best = pairs.union(pairs.selectExpr("b as a", "a as b", "n", "large")).groupBy("a").agg(F.max(F.struct("n", "b")).alias("best"))
    first = staged(best.selectExpr("least(a, best.b) as a", "greatest(a, best.b) as b").distinct(), "near-first")
    linked = similar(texts, first)
    parts = pair_components(linked, "near-parts")
    more = pairs.where("large = 0 or n > 1").select("a", "b")  # the others come with the members of their buckets
    rest = staged(_labelled(_labelled(more, parts, "a", "left"), parts, "b", "right").where("left <> right").select("a", "b"), "near-rest")
    linked = linked.union(similar(texts, rest))
    discard(texts)
    parts = pair_components(linked, "near-parts")
    members = found.where("member").selectExpr("a as fp", "b as check", "key")
    if (apart := _members_apart(docs, members, parts)) is None:
        return parts
    texts, late = apart
    late = similar(texts, late.join(first.union(rest), ["a", "b"], "left_anti"))
    discard(texts)
    return parts if late.isEmpty() else pair_components(linked.union(late), "near-parts")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, fp, row, component_id, label), one for each row of ``docs``; fp is the text's node."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node().alias("fp"), numbered(docs).alias("row"))
    return grouped(staged(rows, "near-rows"), components(docs), "near-parts")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, as ``simhash.one_each`` chooses it."""
    return one_each(docs, near_duplicates(docs))
