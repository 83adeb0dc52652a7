"""Cleaning a corpus in stages, each an operator of ravelin.llm that works on all its predecessor kept.

Odd rows: null and empty texts go through every stage as texts without words, and as near-duplicates of each other one of them stays; very
long texts are read whole in every stage; of repeated rows one stays, that of the least doc_id, a null doc_id only where a class has no
other; null labels and benchmark items are ignored; extra columns, whatever their names, are kept up to the last stage, which
returns doc_id, lang, source, n_tokens and ids; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ravelin.llm import bpe, decontaminate, pii, simhash, toxicity
from ravelin.runtime import materialize


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return simhash.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    coded = bpe.encode(docs, ["doc_id", "lang", "source"])
    return coded.selectExpr("doc_id", "lang", "source", "cast(size(ids) as bigint) as n_tokens", "ids")


STAGES = [
    ("toxicity", civil),
    ("simhash_dedup", distinct),
    ("decontamination", uncontaminated),
    ("pii_redaction", redacted),
    ("bpe_encoding", encoded),
]

#: Learned scores, fingerprints and merges can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
