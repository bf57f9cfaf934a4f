"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic models over marker words; each model
also reads the probabilities of the categories before it.  In training these come from
out-of-fold predictions, so a later model learns from probabilities as honest as those it will
get.  The last link is ``toxic`` itself.

The labels say only whether a document is toxic, so a category's training label is: toxic, and
with one of the category's seed words.  Markers are the words, or beginnings
of words, whose share of toxic documents is significantly off; rare words, and so the length of a text, weigh nothing.

Training reads a bounded sample (SAMPLE_PER_CLASS distinct texts of each class, drawn by hash);
prediction covers all documents.

Defined cases: a null text or one without words gets the probabilities of no marker; labels
without doc_id or toxic value, or without a document, are not used; documents labelled twice
count as toxic if either label does; with no toxic or no other label every probability is the
share of toxic labels (0 without labels); repeated rows get equal results; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Training reads at most about this many documents of each class (the bound of the sample).
SAMPLE_PER_CLASS = 3000
FOLDS = 5
MIN_DOCUMENTS = 5
#: Standard errors by which a marker's share must be off.
SIGNIFICANT = 5.0
STEPS = 600
PREFIXES = (4, 5, 6)
#: Seed words of the categories, in the order of the chain.
CATEGORIES = {
    "insult": ("idiot", "moron", "stupid", "loser", "clown", "fool", "dumb"),
    "contempt": ("pathetic", "worthless", "useless", "disgusting", "ugly"),
    "dehumanising": ("scum", "trash", "vermin", "filth", "garbage"),
    "threat": ("kill", "die", "hurt", "destroy"),
}
LINKS = (*CATEGORIES, "toxic")
_WORD = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words(text: str | None) -> set[bytes]:
    """The distinct words of a text, and the beginnings of longer ones (marked by ``^``), which inflected forms share."""
    found = set((text or "").lower().encode("utf-8", "surrogatepass").translate(_WORD).split())
    return found.union(*({b"^" + w[:n] for w in found if len(w) > n} for n in PREFIXES))


@dataclass
class Model:
    markers: dict[bytes, int]
    weights: list[np.ndarray]  # of link k: a weight for each marker, then for each earlier link
    bias: list[float]

    def chain(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of all links for rows of marker presence."""
        out = np.zeros((len(x), 0))
        for w, b in zip(self.weights, self.bias, strict=True):
            out = np.column_stack((out, _sigmoid(np.column_stack((x, out)) @ w + b)))
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by gradient steps with momentum."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0, 1e-4, 1 - 1e-4))
        return np.zeros(x.shape[1]), float(np.log(share / (1 - share)))
    w, b, vw, vb = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    rate = 1.0 / (0.25 * max(1.0, float((x * x).sum(axis=1).mean())))
    for _ in range(STEPS):
        g = (_sigmoid(x @ w + b) - y) / len(y)
        vw, vb = 0.9 * vw + x.T @ g + 1e-5 * w, 0.9 * vb + float(g.sum())
        w, b = w - rate * vw, b - rate * vb
    return w, b


def find_markers(bags: list[set[bytes]], toxic: np.ndarray) -> dict[bytes, int]:
    """Words whose documents are toxic significantly more or less often than all are."""
    share, n, bad = toxic.mean(), Counter(), Counter()
    for bag, t in zip(bags, toxic.tolist(), strict=True):
        n.update(bag)
        if t:
            bad.update(bag)
    off = {w: (bad[w] - c * share) / np.sqrt(c * share * (1 - share)) for w, c in n.items() if c >= MIN_DOCUMENTS}
    return {w: i for i, w in enumerate(sorted(w for w, z in off.items() if abs(z) > SIGNIFICANT))}


def presence(bags: list[set[bytes]], markers: dict[bytes, int]) -> np.ndarray:
    x = np.zeros((len(bags), len(markers)))
    for row, bag in zip(x, bags, strict=True):
        row[[markers[w] for w in bag if w in markers]] = 1
    return x


def fit(bags: list[set[bytes]], toxic: np.ndarray) -> Model:
    markers = find_markers(bags, toxic) if len(bags) else {}
    x = presence(bags, markers)
    fold = np.array([int.from_bytes(hashlib.md5(b"\0".join(sorted(bag))).digest()[:4], "big") % FOLDS for bag in bags])
    weights, bias, earlier = [], [], np.zeros((len(bags), 0))
    for link in LINKS:
        seeds = {s.encode() for s in CATEGORIES.get(link, ())}
        y = toxic.astype(float) * np.array([not seeds or bool(seeds & bag) for bag in bags], float)
        inputs = np.column_stack((x, earlier))
        w, b = logistic(inputs, y)
        weights.append(w)
        bias.append(b)
        unseen = np.zeros(len(bags))
        for f in range(FOLDS):
            wf, bf = logistic(inputs[fold != f], y[fold != f])
            unseen[fold == f] = _sigmoid(inputs[fold == f] @ wf + bf)
        earlier = np.column_stack((earlier, unseen))
    return Model(markers, weights, bias)


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(toxic, text) of a bounded draw of labelled documents; only two counts reach the driver."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {bool(r["toxic"]): r["n"] for r in known.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    cut = F.when(F.col("toxic") > 0, min(1.0, per_class / counts.get(True, 1))).otherwise(min(1.0, per_class / counts.get(False, 1)))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxic")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = known.where(draw < cut).selectExpr("doc_id", "toxic > 0 as toxic")
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("toxic", "text")


def _bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"\0".join(sorted(words(t.as_py()))) for t in batch.column(1)], pa.binary())], ["toxic", "bag"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on a bounded sample; equal texts count once."""
    small_batches(docs.sparkSession)
    rows = sample(docs, labels, per_class).mapInArrow(_bag_rows, "toxic boolean, bag binary").groupBy("bag").agg(F.max("toxic").alias("toxic")).collect()
    pairs = sorted((bytes(r["bag"]), bool(r["toxic"])) for r in rows)
    return fit([set(b.split(b"\0")) - {b""} for b, _ in pairs], np.array([t for _, t in pairs], bool))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.chain(presence([words(t.as_py()) for t in batch.column(1)], model.markers))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, i]) for i in range(len(LINKS))), pa.array(p[:, -1] >= 0.5)], ["doc_id", *(f"p_{k}" for k in LINKS), "toxic"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, p_<category>..., p_toxic, toxic) for all of ``docs``."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, " + ", ".join(f"p_{k} double" for k in LINKS) + ", toxic boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model), schema)
