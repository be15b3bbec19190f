"""The corpus pipeline: quality rules, near-dedup, secrets, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table; all but the last
keep the columns of ``documents``. Quality rules drop what they reject; near-dedup
leaves the smallest id of each group; secrets are replaced in the text and
``n_chars`` counted anew; mixing repeats or drops rows to meet the sources'
weights; packing gives each token piece its sequence and offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import mixing, packing, quality, secrets, simhash
from quire.plans.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # short documents are clean as long as they have words
    return quality.drop_rejected(docs, quality.rules(min_words=1))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.vocabulary_path(), ranks_path=packing.vocabulary_path(packing.RANKS))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Near-dedup, secret spans and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each on a checkpoint of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if at == 0 else cut_lineage(docs), sf_dir)
    return docs
