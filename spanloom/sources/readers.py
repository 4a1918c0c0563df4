"""Sources: PDF folders, pages, BIO files, label lists, reports, model registries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENGINES = ("standard", "custom_biobert")


def pdf_files(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Files of a folder by name; `limit` files at most if it isn't 0. Empty files have a row too, with length 0 and no content.

    Spark's scan leaves empty files out, but plans with a list of all; that list is joined with what was read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  the list and the scan write the scheme differently
    names = spark.createDataFrame([(f,) for f in files.inputFiles()], "path string").select(plain("path").alias("path"))
    # the list holds escaped names, the scan plain ones
    names = names.withColumn("path", F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))))
    out = names.join(files.withColumn("path", plain("path")), "path", "left").withColumn("length", F.coalesce("length", F.lit(0)))
    return out.orderBy("path").limit(limit) if limit else out


def intake(files: DataFrame, engine: str = "standard", available: tuple[str, ...] = ("standard",)) -> DataFrame:
    """Adds why a file is rejected (null: accepted): not a .pdf, an unknown engine, a missing model, an empty file."""
    reason = F.when(~F.lower("path").endswith(".pdf"), "NOT_PDF")
    if engine not in ENGINES and engine not in available:
        reason = reason.otherwise("UNKNOWN_ENGINE")
    elif engine not in available:
        reason = reason.otherwise("MODEL_NOT_AVAILABLE")
    else:
        reason = reason.when(F.col("length") == 0, "EMPTY")
    return files.withColumn("rejected", reason)


def outcomes(taken: DataFrame, audit_rows: DataFrame, key: str = "path") -> DataFrame:
    """What a client sees of each file: success (unlocked), locked, or error with the reason that it was rejected for."""
    out = taken.select(key, "rejected").join(audit_rows.select(key, "safety_status"), key, "left")
    state = F.when(F.col("rejected").isNotNull() | F.col("safety_status").isNull(), "error").when(F.col("safety_status") == "UNLOCKED", "success").otherwise("locked")
    return out.select(key, state.alias("state"), F.coalesce("rejected", F.when(F.col("safety_status").isNull(), "NOT_PROCESSED")).alias("detail"))


def extract_pages(files: DataFrame, reader: Callable[[bytes], list[str]]) -> DataFrame:
    """Pages of accepted files through a pluggable reader (bytes -> texts). A reader's failure becomes a page status, not an empty page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    out += [(path, i + 1, t, "NATIVE") for i, t in enumerate(reader(content))]
                except Exception as e:  # noqa: BLE001 - any reader may fail in its own way
                    out.append((path, 0, "", f"FAILED: {type(e).__name__}"))
            yield pd.DataFrame(out, columns=["doc_name", "page_number", "text", "page_status"])

    return files.select("path", "content").mapInPandas(run, "doc_name string, page_number int, text string, page_status string")


def corpus_text(pages: DataFrame) -> DataFrame:
    """A document's page texts, stripped, with an empty line between them."""
    listed = F.array_sort(F.collect_list(F.struct("page_number", F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("text"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda p: p["text"]), "\n\n").alias("text"))


def read_bio(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of BIO files: a blank line ends a sentence; lines without exactly one tab are dropped. Each file is one value."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    blank = F.when(F.trim("line") == "", 1).otherwise(0)
    lines = lines.withColumn("gap", F.sum(blank).over(Window.partitionBy("file").orderBy("line_no")))
    parts = F.split("line", "\t")
    kept = lines.where((F.trim("line") != "") & (F.size(parts) == 2)).select("file", "gap", "line_no", parts[0].alias("token"), parts[1].alias("label"))
    number = F.dense_rank().over(Window.partitionBy("file").orderBy("gap")) - 1
    return kept.select("file", number.alias("sentence_no"), F.row_number().over(Window.partitionBy("file", "gap").orderBy("line_no")).alias("token_no"), "token", "label")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the lines of a label list that aren't blank; a list of a few labels, so one window will do."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "label")).select("n", F.trim("label").alias("label")).where("label <> ''")
    return lines.select((F.row_number().over(Window.orderBy("n")) - 1).alias("id"), "label")


def read_report(spark: SparkSession, path: str) -> DataFrame | None:
    """A training report, or nothing if there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.json(path, multiLine=True)


def model_status(report: DataFrame | None, available: bool) -> dict:
    """Whether the model is there and how good its report says it is; 0 for what the report doesn't have."""
    names = {"f1": "eval_f1", "precision": "eval_precision", "recall": "eval_recall"}
    out = {"available": available, **{k: 0.0 for k in names}}
    if report is not None and "eval_metrics" in report.columns:
        row = report.select("eval_metrics.*").first()
        out |= {k: float(row[n]) for k, n in names.items() if n in row and row[n] is not None}
    out["sentences"] = (report.first()["eval_sentences"] or 0) if report is not None and "eval_sentences" in report.columns else 0
    return out


def model_available(spark: SparkSession, folder: str) -> bool:
    """A model counts as there only if its settings, label map and weights are, and the weights aren't a pointer of a few bytes."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, least in (("config.json", 1), ("label_map.json", 1), ("model.safetensors", 10_000)):
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        fs = p.getFileSystem(conf)
        if not fs.exists(p) or fs.getFileStatus(p).getLen() < least:
            return False
    return True


def token_classifier(load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]], size: int = 150, stride: int = 30):
    """An engine of word predictions from a model that `load` brings to each worker once; long texts go through in overlapping windows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        predict = load()
        for f in frames:
            out = []
            for key, text in zip(f["doc_id"], f["text"]):
                words = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\S+", text or "")]
                for at in range(0, max(1, len(words)), size):
                    lo, hi = max(0, at - stride), min(len(words), at + size + stride)
                    got = predict([w for w, _, _ in words[lo:hi]])
                    out += [(key, i, *words[i], *got[i - lo]) for i in range(at, min(at + size, len(words)))]
            yield pd.DataFrame(out, columns=["doc_id", "pos", "word", "char_start", "char_end", "label", "score"])

    return lambda docs: docs.select("doc_id", "text").mapInPandas(run, "doc_id long, pos long, word string, char_start long, char_end long, label string, score double")
