"""A corpus pipeline of five stages, each one operator of tessera.llm over all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, jaccard, langid, mixing, secrets
from tessera.llm._common import Scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some learned language stay; texts that are null, have no letter or fit no language go."""
    return langid.keep_identified(docs, langid.train(docs.filter(~langid.held_out(docs["doc_id"]))))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more stays."""
    return jaccard.keep_one(docs, jaccard.Rule(k=5, num=80, den=100))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verified overlap with a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its secrets replaced by marks."""
    return secrets.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document once for every copy taken, numbered by copy_no."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", deduplicate),
    ("decontamination", drop_benchmark),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
]

#: SQL can't express the first, second and third stages; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written in the shared folder and read again."""
    tmp = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, tmp.save(stage(spark, docs, sf_dir), name)
        tmp.drop(before)
    return docs
