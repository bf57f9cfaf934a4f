import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from vellum.llm import tokenfile

from . import cases


def test_code_gives_random_access():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        reader = tokenfile.Reader(tokenfile.encode_ids(ids))
        assert (reader.all() == ids).all()
        assert all(reader[i] == ids[i] for i in range(0, n, 7))


def test_runs_encode_like_whole_texts():
    path = tokenfile.tokenizer_path()
    plain, rng = Tokenizer.from_file(path), random.Random(2)
    parts = [" ", "  ", "\n", "\t", "\r\n", "word", "it's", "x1", "é", "漢字", " ", "\x1c", " ", "<|endoftext|>", "!?", "'s", "\U0001f600", "\x0b"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(2000)]
    got = tokenfile.Encoder(path).encode(texts)
    assert all(g.tolist() == plain.encode(t, add_special_tokens=False).ids for g, t in zip(got, texts, strict=True))


def test_files(spark, monkeypatch):
    plain = Tokenizer.from_file(tokenfile.tokenizer_path())
    docs = cases.frame(spark)
    segments = tokenfile.write(docs)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32, list(r.ids)) for r in tokenfile.documents(segments, with_ids=True).collect()))
    start, flat = 0, []
    want = sorted(cases.rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for row, mine in zip(want, got, strict=True):
        ids = [*plain.encode(row[1] or "", add_special_tokens=False).ids, 0]
        assert mine == (start, row[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
        flat += ids
    asked = [0, 5, len(flat) - 1, len(flat), 777, 777]
    found = tokenfile.tokens_at(segments, spark.createDataFrame([(p,) for p in asked], "position long")).collect()
    assert sorted((r.position, r.id) for r in found) == sorted((p, flat[p]) for p in asked if p < len(flat))
    assert tokenfile.documents(tokenfile.write(cases.empty(spark))).count() == 0
    assert tokenfile.tokens_at(tokenfile.write(cases.empty(spark)), spark.createDataFrame([(1,)], "position long")).count() == 0
