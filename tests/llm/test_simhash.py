import random
from collections import defaultdict

import numpy as np
import xxhash

from vellum.llm import simhash

from . import cases


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    values = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def components(prints):
    """Least reachable id by all pairs; prints: (id, fingerprint)."""
    parent = {}
    by = defaultdict(list)
    for i, f in prints:
        by[f].append(i)
    keys = list(by)
    parent = {k: k for k in keys}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[top(a)] = top(b)
    least = {}
    for k in keys:
        ids = [i for i in by[k] if i is not None]
        least[top(k)] = min([*ids, *([least[top(k)]] if least.get(top(k)) is not None else [])], default=least.get(top(k)))
    return {k: least[top(k)] for k in keys}


def test_masks_cover_every_pair_within_the_radius():
    masks = [m & (1 << 64) - 1 for m in simhash.covering_masks()]
    rng = random.Random(1)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        assert any(m & diff == 0 for m in masks)
    assert len(masks) == 31 and all(20 < m.bit_count() < 45 for m in masks)


def test_against_all_pairs(spark):
    docs = cases.frame(spark)
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    prints = [(r[0], plain_print(r[1])) for r in cases.rows()]
    want = components(prints)
    assert got == sorted(((i, f, want[f]) for i, f in prints), key=str)
    kept = simhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0 and simhash.keep_one(cases.empty(spark)).count() == 0


def test_large_buckets_are_cut_by_finer_masks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(3)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    from vellum.llm.common import pair_components

    found = pair_components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")), "t")
    label = {r.node & (1 << 64) - 1: r.label for r in found.collect()}
    want = components(list(enumerate(values)))
    groups, mine = defaultdict(set), defaultdict(set)
    for v in values:
        groups[want[v]].add(v)
        mine[label.get(v, ("alone", v))].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_forest_connects_what_links():
    rng = np.random.default_rng(2)
    prints = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64) * np.uint64(1 << 40))
    a, b = simhash.forest(prints, 2)
    assert (np.bitwise_count(a ^ b) <= 2).all()


def test_finer_masks_cover_what_the_first_leaves_out():
    rng = random.Random(6)
    for kept in simhash.covering_masks()[::6]:
        kept &= (1 << 64) - 1
        left = [b for b in range(64) if not kept >> b & 1]
        finer = [m & (1 << 64) - 1 for m in simhash.refining_masks(kept, 4)]
        assert all(m & kept == kept and m.bit_count() > kept.bit_count() for m in finer)
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(left, rng.randint(1, 4)))
            assert any(m & diff == 0 for m in finer)
