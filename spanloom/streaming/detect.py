"""A streaming front: detection is stateless, so a stream of texts goes through the same engine; audits are appended by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import audit, detect


def detections(stream: DataFrame, engine: str = "standard") -> DataFrame:
    return detect.ENGINES[engine](stream)


def append_audits(stream: DataFrame, path: str, checkpoint: str):
    """Starts the query; each micro-batch's audits carry its number, so that one that is run again can be told apart."""

    def write(batch: DataFrame, number: int) -> None:
        audit.audits(detections(batch)).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_counts(audit_stream: DataFrame, at: str = "timestamp", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Documents by status in windows of time, with a watermark."""
    return audit_stream.withWatermark(at, late).groupBy(F.window(at, width), "safety_status").agg(F.count(F.lit(1)).alias("n"))
