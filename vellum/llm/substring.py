"""Removal of repeated passages by compaction of a de Bruijn graph over the corpus.

A window of 20 consecutive words is an edge of the graph.  Windows that follow each other
and share the least hash among their stretches of six words (their anchor) form a segment; an
anchor lies at the same place in every occurrence of a window, so equal windows always meet
under one anchor, and eight windows on average cost one row.

1. Count the anchors; those seen once carry no repeat and go.
2. An anchor whose segments are all alike is unbranched: its windows repeat together.
   Unbranched segments that always follow each other (each the only successor and the
   only predecessor of the other, at adjoining places of the same source) are joined to paths by a
   Spark join; a path is decided as one, by the source coordinates of its first occurrence.
3. Where the segments of an anchor differ, the graph branches: segments that occur again go
   as a whole, and the windows of each first occurrence are decided one by one.

Every occurrence but the first (least doc_id, then start) is removed.  Counting combines
before the shuffle and joins are split where a key is hot, so a passage in a third of all
documents costs no task more than its share.  Windows are compared by two independent 64-bit
hashes over two independent 64-bit word hashes.  Last, repeats of one source that touch are joined to runs, and a run is removed only where
a digest of its very words equals that of the words at its source coordinates.

Defined cases: a null or blank text has no words; texts of under 20 words lose nothing; rows
without doc_id lose nothing and are nobody's source; rows that share a doc_id stand at the same
places, so neither removes what they have at equal starts, and each loses only its own words; words are bytes between white
space, unchanged; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, release, small_batches, staged
from .words import OTHER_STEP, STEP, mixed, stretch, word_hashes

WINDOW = 20
ANCHOR = 6
#: Texts are hashed in groups of about this many characters.
GROUP_CHARS = 1 << 18


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of the words of all texts, one after the other, and each text's number of words."""
    (low, high), sizes = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts], 2)
    return low, high, sizes


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of the batches (doc_id, text, row, ...) in groups of about GROUP_CHARS characters."""
    rows, n = [], 0
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            rows.append((row[0].as_py(), row[1].as_py(), row[2].as_py(), *row[3:]))
            n += len(rows[-1][1] or "")
            if n >= GROUP_CHARS:
                yield rows
                rows, n = [], 0
    if rows:
        yield rows


def segments(low: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the word hashes of some texts: each segment's anchor hash, first window, number of windows.

    Windows are numbered by their first word over all the texts; none reaches from one into the next.
    """
    n = len(low) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = stretch(low, ANCHOR, STEP)
    span = WINDOW - ANCHOR + 1
    least = a[:n].copy()
    for k in range(1, span):
        np.minimum(least, a[k : k + n], out=least)
    at = np.full(n, span - 1)
    for k in range(span - 2, -1, -1):
        at[a[k : k + n] == least] = k
    at += np.arange(n)
    text = np.repeat(np.arange(len(sizes)), sizes)
    whole = text[:n] == text[WINDOW - 1 :]
    new = whole.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~whole[:-1]
    starts = np.flatnonzero(new)
    owner = np.cumsum(new)[whole] - 1
    return a[at[starts]], starts, np.bincount(owner, minlength=len(starts))


def windows(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return stretch(low, WINDOW, STEP), stretch(high, WINDOW, OTHER_STEP)


def _keys(w: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Content hash of each segment: its first and last windows cover all its words."""
    return mixed(w[starts] * STEP + w[starts + sizes - 1] * OTHER_STEP + sizes.astype(np.uint64))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in groups(batches):
        low, _, words = hashed([r[1] for r in rows])
        a, starts, sizes = segments(low, words)
        if not len(a):
            continue
        row = np.searchsorted(np.cumsum(words), starts, side="right")
        key = _keys(stretch(low, WINDOW, STEP), starts, sizes)
        order = np.lexsort((key, a, row))
        a, key, row = a[order], key[order], row[order]
        new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (key[1:] != key[:-1]) | (row[1:] != row[:-1]))))
        owner = np.array([r[2] for r in rows], np.int64)[row[new]]
        yield pa.RecordBatch.from_arrays([pa.array(a[new].view(np.int64)), pa.array(key[new].view(np.int64)), pa.array(owner), pa.array(np.diff(np.concatenate((new, [len(a)]))).astype(np.int32))], ["anchor", "key", "row", "n"])


_FOUND = "anchor long, k1 long, k2 long, doc_id long, row long, start int, size int, before long, after long, forked boolean, windows array<long>"


def _found_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the documents' repeated anchors: the segments, with their neighbours' keys; those of forked anchors with both hashes of each window."""
    for rows in groups(batches):
        low, high, words = hashed([r[1] for r in rows])
        a, starts, sizes = segments(low, words)
        if not len(a):
            continue
        w1, w2 = windows(low, high)
        k1, k2 = _keys(w1, starts, sizes), _keys(w2, starts, sizes)
        ends = np.cumsum(words)
        row, docs, owner = np.searchsorted(ends, starts, side="right"), *(np.array([r[c] for r in rows], np.int64) for c in (0, 2))
        begin = ends - words
        straight, branch = np.zeros(len(a), bool), np.zeros(len(a), bool)
        cuts = np.searchsorted(row, np.arange(len(rows) + 1))
        for (*_, plain, forked), s, e in zip(rows, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            straight[s:e] = np.isin(a[s:e], plain.values.to_numpy().view(np.uint64))
            branch[s:e] = np.isin(a[s:e], forked.values.to_numpy().view(np.uint64))
        tied = straight[:-1] & straight[1:] & (row[:-1] == row[1:])
        none = np.zeros(1, np.uint64)
        before = np.concatenate((none, np.where(tied, k1[:-1], none)))
        after = np.concatenate((np.where(tied, k1[1:], none), none))
        kept = straight | branch
        at = np.repeat(starts[branch], sizes[branch])
        at += np.arange(len(at)) - np.repeat(np.cumsum(sizes[branch]) - sizes[branch], sizes[branch])
        both = np.stack((w1[at], w2[at]), axis=1).ravel().view(np.int64)
        ends = np.cumsum(np.where(branch, 2 * sizes, 0)[kept])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(both))
        longs = [x[kept].astype(x.dtype).view(np.int64) for x in (a, k1, k2, docs[row], owner[row])]
        ints = [x[kept].astype(np.int32) for x in (starts - begin[row], sizes)]
        ties = [x[kept].view(np.int64) for x in (before, after)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, (*longs, *ints, *ties, branch[kept])), lists], [x.split()[0] for x in _FOUND.split(", ")])


def _with_text(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Texts with what is known of their rows; only the short side is built into a hash table."""
    return docs.join(lists.hint("shuffle_hash"), ["row"], how)


def repeated(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The repeats of ``docs`` (doc_id, text, row), and staged frames to discard once they are read.

    Rows (doc_id, row, start, size, first_doc, first_start): ``size`` windows from ``start`` on that
    all occur before, as they do from (first_doc, first_start) on.  Rows may overlap.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.where("doc_id is not null")
    anchors = staged(known.select("doc_id", "text", "row").mapInArrow(_anchor_rows, "anchor long, key long, row long, n int"), "substring-anchors")
    often = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    again = staged(anchors.join(often, "anchor").select("anchor", "key", "row"), "substring-again")
    discard(anchors)
    release(spark)
    shape = again.groupBy("anchor").agg((F.min("key") < F.max("key")).alias("forked"))
    kinds = again.select("anchor", "row").distinct().join(shape, "anchor")
    lists = kinds.groupBy("row").agg(F.expr("collect_list(anchor) filter (where not forked)").alias("plain"), F.expr("collect_list(anchor) filter (where forked)").alias("forked"))
    lists = staged(lists, "substring-lists")
    discard(again)
    release(spark)
    found = staged(_with_text(known, lists, "inner").select("doc_id", "text", "row", "plain", "forked").mapInArrow(_found_rows, _FOUND), "substring-found")
    discard(lists)
    release(spark)
    later = "doc_id <> first_doc or start <> first_start"
    forked = found.where("forked")
    paths, nodes = _paths(found.where("not forked").drop("windows"))
    again, first = _later_segments(forked)
    whole = staged(paths.union(again).where(later), "substring-whole")
    discard(nodes)
    release(spark)
    single = staged(_first_windows(forked, first), "substring-single")
    discard(found)
    discard(first)
    release(spark)
    alone = staged(_repeated_windows(single).where(later), "substring-alone")
    discard(single)
    release(spark)
    return whole.union(alone), [whole, alone]


_PLACE = ("doc_id", "row", "start", "size", "first_doc", "first_start")


def _paths(straight: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences of unbranched paths."""
    nodes = straight.groupBy("k1", "k2").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "start", "row")).alias("at"), F.first("size").alias("size"),
        *[F.when(F.min(c) == F.max(c), F.min(c)).alias(c) for c in ("before", "after")],
    ).where("n > 1")
    nodes = staged(nodes, "substring-nodes")
    x, y = nodes.alias("x"), nodes.alias("y")
    joined = F.expr("x.after = y.k1 and y.before = x.k1 and x.n = y.n and x.at.doc_id = y.at.doc_id and x.at.row = y.at.row and x.at.start + x.size = y.at.start")
    follows = x.join(y, joined).select(F.col("y.k1").alias("k1"), F.col("y.k2").alias("k2"), F.lit(True).alias("follows"))
    order = Window.partitionBy("doc_id", "row").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    chain = nodes.join(follows, ["k1", "k2"], "left").selectExpr("k1", "k2", "size", "at.doc_id", "at.row", "at.start", "follows is null as head")
    chain = chain.withColumn("path", F.sum(F.col("head").cast("int")).over(order))
    heads = chain.groupBy(F.col("doc_id").alias("first_doc"), F.col("row").alias("_row"), "path").agg(F.expr("min_by(k1, start)").alias("k1"), F.expr("min_by(k2, start)").alias("k2"), F.min("start").alias("first_start"), F.sum("size").cast("int").alias("path_size"))
    whole = straight.select("k1", "k2", "doc_id", "row", "start").join(heads, ["k1", "k2"])
    return whole.withColumn("size", F.col("path_size")).select(*_PLACE), nodes


def _later_segments(forked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences of each segment under a forked anchor with its first one, and the first ones."""
    first = forked.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "start")).alias("at")).selectExpr("k1", "k2", "at.doc_id as first_doc", "at.start as first_start")
    first = staged(first, "substring-first")
    release(forked.sparkSession)
    return forked.select("k1", "k2", "doc_id", "row", "start", "size").join(first, ["k1", "k2"]).select(*_PLACE), first


def _first_windows(forked: DataFrame, first: DataFrame) -> DataFrame:
    """Windows (k1, k2, doc_id, start) of each segment's first occurrence; they move once, to the unique place of it."""
    heads = forked.select("k1", "k2", "doc_id", "row", "start", "size", "windows").join(first.withColumnsRenamed({"first_doc": "doc_id", "first_start": "start"}), ["k1", "k2", "doc_id", "start"])
    each = F.explode(F.expr("sequence(0, size - 1)")).alias("i")
    return heads.select("doc_id", "row", "start", "windows", each).selectExpr("windows[2 * i] as k1", "windows[2 * i + 1] as k2", "doc_id", "row", "start + i as start")


def _repeated_windows(single: DataFrame) -> DataFrame:
    """Windows that several segments share, each with its first place."""
    before = single.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("at")).where("n > 1")
    return single.join(before, ["k1", "k2"]).selectExpr("doc_id", "row", "start", "1 as size", "at.doc_id as first_doc", "at.start as first_start")


_RUN = "row long, start int, size int, first_doc long, first_start int"


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row's repeats the longest runs that have one source: those on one diagonal that touch or overlap."""
    for batch in batches:
        out: list[np.ndarray] = []
        for row, spans in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            start, size, doc, first = (spans.values.field(c).to_numpy().astype(np.int64) for c in range(4))
            order = np.lexsort((start, start - first, doc))
            start, size, doc, first = start[order], size[order], doc[order], first[order]
            line = np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]) | (start[1:] - first[1:] != start[:-1] - first[:-1]))))
            end = np.maximum.accumulate(start + size + line * (1 << 40)) - line * (1 << 40)
            new = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (start[1:] > end[:-1]))))
            last = np.concatenate((new[1:], [len(start)])) - 1
            out.append(np.stack((np.full(len(new), row), start[new], end[last] - start[new], doc[new], first[new])))
        columns = np.concatenate([*out, np.zeros((5, 0), np.int64)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int32, np.int32, np.int64, np.int32), strict=True)], [x.split()[0] for x in _RUN.split(", ")])


def _digest(words: list[bytes], start: int, size: int) -> int:
    """A digest of the very words of ``size`` windows from ``start`` on, as a signed long."""
    return xxhash.xxh3_64_intdigest(b" ".join(words[start : start + size + WINDOW - 1])) - (1 << 63)


def _source_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests of the words at source coordinates."""
    for batch in batches:
        rows: list[tuple] = []
        for doc, value, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            words = (value.as_py() or "").encode("utf-8", "surrogatepass").split()
            rows += [(doc, start, size, _digest(words, start, size)) for start, size in zip(*(places.values.field(c).to_pylist() for c in range(2)), strict=True)]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["first_doc", "first_start", "size", "digest"])


def verified(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``runs`` with the digests of the words that stand at their source coordinates: one, or one for each row that has the source's doc_id."""
    places = runs.select("first_doc", "first_start", "size").distinct().groupBy("first_doc").agg(F.collect_list(F.struct("first_start", "size")).alias("places"))
    at = docs.join(places.withColumnRenamed("first_doc", "doc_id").hint("shuffle_hash"), "doc_id").select("doc_id", "text", "places")
    told = at.mapInArrow(_source_rows, "first_doc long, first_start int, size int, digest long")
    told = staged(told.groupBy("first_doc", "first_start", "size").agg(F.collect_set("digest").alias("digests")), "substring-sources")
    return runs.join(told, ["first_doc", "first_start", "size"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of their repeats; a repeat counts only where its words are those of its source."""
    for batch in batches:
        rows: list[tuple] = []
        for doc, value, spans in zip(*(batch.column(i) for i in range(3)), strict=True):
            words = (value.as_py() or "").encode("utf-8", "surrogatepass").split()
            removed, words_kept = 0, words
            if spans.is_valid and words:
                edge = np.zeros(len(words) + 1, np.int64)
                for start, size, digests in zip(*(spans.values.field(c).to_pylist() for c in range(3)), strict=True):
                    if start + size + WINDOW - 1 <= len(words) and _digest(words, start, size) in digests:
                        edge[start] += 1
                        edge[start + size + WINDOW - 1] -= 1
                kept = np.cumsum(edge[:-1]) == 0
                removed = len(words) - int(kept.sum())
                words_kept = [w for w, k in zip(words, kept.tolist(), strict=True) if k]
            rows.append((doc.as_py(), len(words), removed, b" ".join(words_kept).decode("utf-8", "surrogatepass")))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_text"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_text), one for each row of ``docs``; kept words are joined by a space."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("doc_id", "text"))
    spans, used = repeated(texts)
    by_row = spans.groupBy("row").agg(F.collect_list(F.struct("start", "size", "first_doc", "first_start")).alias("spans"))
    runs = staged(by_row.mapInArrow(_merge_rows, _RUN), "substring-runs")
    for frame in used:
        discard(frame)
    release(docs.sparkSession)
    lists = staged(verified(texts.where("doc_id is not null"), runs).groupBy("row").agg(F.collect_list(F.struct("start", "size", "digests")).alias("spans")), "substring-spans")
    release(docs.sparkSession)
    return _with_text(texts, lists, "left").select("doc_id", "text", "spans").mapInArrow(_apply, "doc_id long, n_words long, n_removed long, kept_text string")
