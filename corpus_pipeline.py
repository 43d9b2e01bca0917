"""Training-data pipeline: quality rules, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with all their
columns; the last returns the packed pieces.  STAGES can be run one by one with the
result of each stored as Parquet, or at once by ``run``.

Defined cases: documents with a null or empty text, or with few words, fail the quality rules and
go; null ids, languages and sources stay as they are; of rows of one near-duplicate group the one
with the least id stays, of equal rows any one; very long texts are read whole by every stage; an
empty table goes through all stages; further columns, whatever their names, are kept up to packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import packing, quality_ledger, secret_spans, set_join, spaced_seeds
from ledgerline.llm.shared import materialise

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy v2-all keeps: the ledger is computed beside each row, so nothing is shuffled."""
    return quality_ledger.kept(docs, "v2-all")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links at five words and a similarity of 0.8: the one with the least id."""
    return set_join.deduplicated(docs, percent=80, k=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item."""
    return spaced_seeds.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked and n_chars following the text."""
    return secret_spans.masked(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secrets),
    ("best_fit_packing", packing_stage),
]

#: Tokenizing, the join's components and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents.  What a stage keeps is stored before the next one reads it, several times if it must: no stage is computed twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else materialise(docs), sf_dir)
    return docs
