"""Language identification by error-correcting output codes.

Each language has a binary codeword.  One logistic classifier per code bit reads hashed
byte n-grams of the whole text; decoding picks the codeword with the least loss, each bit
weighted by how well it did in training, and flags a text whose best two codewords are close.

Defined cases: a null text or one without a letter is ``und`` with score 0; with no labelled
row at all every text is ``und``; with one language every text with letters gets it; rows
with a null lang or doc_id never train; repeated rows are predicted alike; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Training reads at most about this many documents of each language (the bound of the sample).
SAMPLE_PER_LANG = 400
N_BUCKETS = 1 << 13
NGRAMS = (2, 3, 4)
STEPS = 160
#: A text is ambiguous when the best codeword's share of the two best is under this.
AMBIGUOUS = 0.6

_KEEP = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_MULT = tuple(np.uint32(m) for m in (2654435761, 2246822519, 3266489917, 668265263))


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit when decoding


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Square roots of the bucket shares of a text's byte n-grams, of unit length."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_KEEP).split()) + b" "
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    counts = np.zeros(N_BUCKETS, np.float32)
    h = np.zeros(len(a), np.uint32)
    for n in range(1, min(NGRAMS[-1], len(a)) + 1):  # the hash of n bytes goes on from that of n - 1
        h = (h[: len(a) - n + 1] ^ a[n - 1 :]) * _MULT[n - 1]
        h ^= h >> np.uint32(15)
        if n in NGRAMS:
            counts += np.bincount(h & np.uint32(N_BUCKETS - 1), minlength=N_BUCKETS)
    return np.sqrt(counts / max(1.0, counts.sum()))


def codewords(n_langs: int) -> np.ndarray:
    """Exhaustive codes for up to five languages, else seeded random ones kept far apart."""
    if n_langs <= 5:
        bits = range(1, 1 << max(1, n_langs - 1))
        return np.array([[1 if lang == 0 or not b >> (lang - 1) & 1 else -1 for b in bits] for lang in range(n_langs)], np.float32)
    rng, width, best, far = np.random.default_rng(7), int(np.ceil(10 * np.log2(n_langs))), None, -1
    for _ in range(200):
        code = rng.integers(0, 2, (n_langs, width)) * 2 - 1
        apart = ((width - code @ code.T) // 2 + width * np.eye(n_langs, dtype=int)).min()
        if apart > far and (np.abs(code.sum(axis=0)) < n_langs).all():
            best, far = code, apart
    return best.astype(np.float32)


def fit(x: np.ndarray, langs: list[str]) -> Model:
    """One logistic classifier per bit by full-batch gradient steps with momentum."""
    names = sorted(set(langs))
    codes = codewords(len(names))
    at = np.array([names.index(lang) for lang in langs], np.int64)
    y, each = codes[at], np.bincount(at, minlength=len(names))
    share = (1.0 / (len(names) * each[at])).astype(np.float32)[:, None]
    w, b = np.zeros((x.shape[1], codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(STEPS):
        g = -y * share / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        vw, vb = 0.9 * vw + x.T @ g + 1e-5 * w, 0.9 * vb + g.sum(axis=0)
        w, b = w - 8.0 * vw, b - 2.0 * vb
    right = ((np.sign(x @ w + b) == y) * share).sum(axis=0)
    return Model(names, codes, w, b, np.clip(2 * right - 1, 0.05, 1))


def sample_rows(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """Labelled (lang, text) rows, about ``per_lang`` a language, drawn by the hash of doc_id.

    Only counts by language reach the driver.  The drawn share of a language is 1.2 times
    what is asked for, so that the sample hardly ever falls short.
    """
    rows = docs.where("lang is not null and doc_id is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.select("lang", "text").limit(0)
    cut = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 1.2 * per_lang / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("lang")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(draw < F.element_at(cut, F.col("lang"))).select("lang", "text")


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [features(t.as_py()).astype(np.float16).tobytes() if has_letter(t.as_py()) else None for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["lang", "x"])


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model | None:
    """Fit on a bounded sample of the labelled rows of ``docs``; None if there are none."""
    small_batches(docs.sparkSession)
    rows = sample_rows(docs, per_lang).mapInArrow(_feature_rows, "lang string, x binary").where("x is not null").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)
    return fit(x, [r["lang"] for r in rows])


def decode(model: Model, margins: np.ndarray) -> tuple[str, float, bool]:
    """Language, score and whether the decision is ambiguous, from the bits' margins."""
    loss = (np.logaddexp(0, -model.codes * margins) * model.trust).sum(axis=1)
    order = np.argsort(loss, kind="stable")
    share = np.exp(-(loss - loss[order[0]]))
    score = float(share[order[0]] / share.sum())
    second = float(share[order[1]]) if len(order) > 1 else 0.0
    return model.langs[order[0]], min(1.0, max(0.0, score)), 1 / (1 + second) < AMBIGUOUS


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, unsure = [], [], []
            for value in batch.column(1):
                text = value.as_py()
                if model is None or text is None or not has_letter(text):
                    found = ("und", 0.0, False)
                else:
                    found = decode(model, features(text) @ model.weights + model.bias)
                for out, v in zip((lang, score, unsure), found, strict=True):
                    out.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows (doc_id, lang_pred, score, ambiguous), from the text alone."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without the rows that have no language: null, no letter, or ambiguous."""
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for value in batch.column(names.index("text")):
                text = value.as_py()
                ok = model is not None and text is not None and has_letter(text)
                keep.append(ok and not decode(model, features(text) @ model.weights + model.bias)[2])
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
