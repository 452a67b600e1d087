"""The corpus pipeline: STAGES in order over documents, each stage's output written and read by the next.

All stages but the last return the columns of documents, whatever else those hold. A null text is no
language and is rejected by the first stage.
"""

from pyspark.sql import DataFrame, SparkSession

from cellmorph.llm import language, packing, pii, simhash, toxicity
from cellmorph.llm.common import crc_mod, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language; those without a letter go."""
    return language.accepted(docs, language.train(docs.where(crc_mod("doc_id", language.FOLDS) != 0)))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score below the threshold; learns from the labels of those that arrive."""
    return toxicity.accepted(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group with similarity 0.8 or more over five-word shingles."""
    return simhash.keep_one(docs)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in every text by its kind."""
    return pii.redact(docs, pii.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document in windows of 2048 tokens: one row per piece, with its ids."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("toxicity", toxicity_filter), ("near_dedup", near_dedup), ("pii", pii_redaction), ("packing", pack)]

#: Trained models and fingerprints take part: SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
