"""A training corpus from documents: quality rules, toxicity, near-duplicates, personal data, packing.

Each stage works on everything its predecessor kept; what it decides takes effect. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import neardup, packing, pii, quality, toxicity
from spanloom.llm.common import staged, table
from spanloom.llm.queries import END_OF_TEXT_PACK, tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_documents(docs, "v1")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_documents(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact_documents(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit(docs, tokenizer_path("word_bpe_49k.json"), END_OF_TEXT_PACK)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("neardup", neardup_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: Models and packing can't be expressed in SQL; tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
