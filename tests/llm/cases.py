"""Awkward rows that every operator on documents must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, label string, rep long, component_id long, n long"


def rows() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    long, passage = prose(6000), prose(60)
    texts: list[str | None] = [None, "", " \n\t\x0b\f\r ", "one", "Two words", long, long, long.replace("a", "b", 2), passage, f"{prose(30)} {passage} {prose(40)}", f"{passage} {passage}", "a a a a a a a a a a a a a a a a a a a a a a a a a a a a", "é ß 漢字 \U0001f600 x", "123 456 !!"]
    texts += [prose(rng.randint(1, 120)) for _ in range(40)]
    out = [(i, t, ["en", "de", None][i % 3], f"src{i % 4}", len(t or ""), 1, "x", 2, 3, 4) for i, t in enumerate(texts)]
    return [*out, out[9], out[20], (None, passage, "en", None, 3, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
