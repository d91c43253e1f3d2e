"""Corpus preparation: each stage takes what the one before kept.

1. quality rules: documents that the standard policy rejects go;
2. SimHash near-dedup: fingerprints propose near copies, whole texts confirm them; one document of each group stays;
3. benchmark decontamination: documents that overlap a benchmark item go;
4. PII: spans are replaced in the texts, all documents stay;
5. mixing: the documents left are packed into blocks, and sources mixed to target weights.

A stage is a function of (spark, docs, sf_dir) whose result is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of documents. ``run`` writes between the stages into the
folder that spark.checkpoint.dir names.

Empty inputs pass through every stage; see the operators for nulls, ties, repeated rows and other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirflow.llm import decontaminate, mixing, pii, quality, simhash
from weirflow.llm.common import cut, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Slots of the mix in blocks of tokens, with the ids of the documents that each holds."""
    return mixing.blocks(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: Fingerprints, spaced seeds and seeded draws have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
