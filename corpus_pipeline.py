"""Pipeline over a corpus of documents: quality, near-duplicates, PII, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from websift.llm import jaccard, mixing, packing, pii, quality
from websift.llm.common import cut, documents, prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the divergence from their language's references."""
    prepare(spark)
    return quality.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard 0.8 or more)."""
    prepare(spark)
    return jaccard.keep_one(docs)


def private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with format-preserving pseudonyms instead of personal data and secrets."""
    prepare(spark)
    return pii.pseudonymise(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    prepare(spark)
    return mixing.mix_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("private values", private_values),
          ("mixture", mixture), ("packing", packed)]

#: Shingles, keyed permutations and token ids have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written as Parquet and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
