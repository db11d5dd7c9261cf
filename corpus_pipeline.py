"""A training corpus from ``documents``, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last
return the columns of ``documents``; no stage sees what an earlier one dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslab.llm import bpe, jaccard, ledger, mixing, toxicity
from corpuslab.llm.common import read, saved


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return toxicity.clean(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of links: 5-word shingles, Jaccard similarity of 0.8 or more."""
    return jaccard.representatives(docs, jaccard.Contract(5, 4, 5))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by ``*``."""
    return ledger.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that a mix of sources to target weights takes of each document."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encoded(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("secret_scans", redact_secrets),
          ("source_mixing", mix_sources), ("sentencepiece", encode)]

#: No stage but the third is expressible in SQL; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
