"""The pipeline against its stages' plain versions on the smallest tables."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from vellum.llm import decontam, langid, mixing, tokenfile

from .test_decontam import edits
from .test_neardup import groups

SF = "/root/testdata/sf0.001"


def test_every_stage(spark):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, [tuple(r) for r in docs.collect()]
    model = langid.train(docs)
    rows = [r for r in rows if r[1] and langid.has_letter(r[1]) and not langid.decode(model, langid.features(r[1]) @ model.weights + model.bias)[2]]
    assert len(rows) > 0.97 * docs.count()
    rows = [r for r, least in zip(rows, groups([r[:2] for r in rows]), strict=True) if least == r[0]]
    items = [decontam.normal(r.text).strip() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def held(text):
        raw = decontam.normal(text)
        return any(x in raw for x in items) or any(edits(x, raw) <= decontam.budget(len(x)) for x in items if any(x[i : i + 8] in raw for i in range(0, len(x) - 8, 8)) and sum(x[i : i + 8] in raw for i in range(len(x) - 7)) >= len(x) - 7 - 8 * decontam.budget(len(x)))

    rows = [r for r in rows if not held(r[1])]
    kept = mixing.sampled(spark.createDataFrame(rows, docs.schema))
    assert kept.columns == columns
    rows = sorted(tuple(r) for r in kept.collect())
    tokenizer, start, want = Tokenizer.from_file(tokenfile.tokenizer_path()), 0, []
    for r in rows:
        ids = [*tokenizer.encode(r[1], add_special_tokens=False).ids, 0]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and want


def test_registry_has_all_eleven():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op1_quality_rules", "op4_substring_dedup", "op8_chat_format", "op9_mixing"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    found = __spark_entry__.queries()[name](spark, SF)
    assert found.columns == want.columns
    assert sorted(tuple(r) for r in found.collect()) == sorted(want.fetchall())
