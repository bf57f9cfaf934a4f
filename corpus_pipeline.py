"""The corpus pipeline: five operators in order, each on all that its predecessor kept."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import decontam, langid, mixing, neardup, tokenfile
from vellum.llm.common import staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; the others go."""
    return langid.accepted(docs, langid.train(docs.select("doc_id", "text", "lang")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingle sets are similar to 0.8 or more."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics have their target weights."""
    return mixing.sampled(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' rows: place, length and checksum of each document's ids."""
    return tokenfile.documents(tokenfile.write(docs))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing_weights), ("tokens", token_output)]


#: None: SQL has no byte-pair encoding, XXH64 or trained classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return functools.reduce(lambda d, stage: staged(stage[1](spark, d, sf_dir), stage[0]), STAGES, docs)
