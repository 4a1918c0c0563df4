"""Sinks: BIO files, label lists, statistics, redacted texts, audit stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import dictionaries as D


def write_bio(chunked: DataFrame, path: str) -> None:
    """Tab-separated token lines with an empty line after each chunk; a chunk stays in one file."""
    lines = F.array_sort(F.collect_list(F.struct("token_no", F.concat_ws("\t", "token", "label").alias("line"))))
    out = chunked.groupBy("doc_id", "chunk_no").agg(F.concat(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit("\n")).alias("value"))
    out.repartitionByRange("doc_id", "chunk_no").sortWithinPartitions("doc_id", "chunk_no").select("value").write.text(path)


def write_labels(spark, path: str) -> None:
    spark.createDataFrame([(i, x) for i, x in enumerate(D.BIO_LABELS)], "id int, value string").coalesce(1).sortWithinPartitions("id").select("value").write.text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def append_store(df: DataFrame, path: str, engine: str) -> None:
    """Appends to an audit, document or metadata store, with when and by what; the last row of a key is its state."""
    df.withColumn("engine", F.lit(engine)).withColumn("timestamp", F.current_timestamp()).write.mode("append").parquet(path)


def write_redacted(df: DataFrame, path: str) -> None:
    """Redacted texts of unlocked documents only."""
    df.where("safety_status = 'UNLOCKED'").select("doc_id", "redacted_text").write.parquet(path)
