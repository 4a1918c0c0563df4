"""Audit rows, the confidence gate, reviews and exports over detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import dictionaries as D
from spanloom.functions import text as X


def audits(detected: DataFrame, key: str = "doc_id", threshold: float = D.SAFETY_THRESHOLD, failed: str | None = None, exact: bool = False) -> DataFrame:
    """One row for each document, from its `detections` array: no shuffle. The gate compares the mean before it is rounded.

    failed: a boolean column; documents whose engine or pages failed are locked whatever their mean (they fail closed).
    exact: also gives the mean before it is rounded, as mean_confidence.
    """
    masked = F.filter("detections", lambda d: d["action"] == "MASKED")
    total = F.aggregate(masked, F.lit(0.0), lambda a, d: a + d["score"])
    mean = F.when(F.size(masked) > 0, total / F.size(masked)).otherwise(F.lit(1.0))
    out = detected.withColumn("__mean", mean).withColumn("__masked", F.size(masked))
    unlocked = F.col("__mean") >= threshold
    if failed:
        unlocked = unlocked & ~F.coalesce(F.col(failed), F.lit(True))
    return out.select(
        key,
        F.size("detections").cast("long").alias("total_entities_detected"),
        F.col("__masked").cast("long").alias("total_entities_masked"),
        (F.size("detections") - F.col("__masked")).cast("long").alias("total_entities_kept"),
        *([F.col("__mean").alias("mean_confidence")] if exact else []),
        F.round("__mean", 4).alias("ensemble_mean_confidence"),
        F.when(unlocked, F.lit("UNLOCKED")).otherwise(F.lit("LOCKED")).alias("safety_status"),
    )


def audit_id(key: str = "doc_id", engine: str = "standard"):
    """Twelve hex digits that depend on the document and engine only."""
    return F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(engine))), 1, 12)


def of_pages(pages: DataFrame) -> DataFrame:
    """Documents of several pages (doc_id, page_number, detections, is_ocr, page_status) with their detections in page order, the pages processed,
    whether any came from OCR, and whether any failed, for audits(failed="failed")."""
    listed = F.array_sort(F.collect_list(F.struct("page_number", "detections")))
    bad = F.bool_or(F.col("page_status").startswith("OCR_FAILED") | F.col("page_status").startswith("FAILED"))
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages_processed"), F.bool_or("is_ocr").alias("ocr_used"), F.coalesce(bad, F.lit(False)).alias("failed"), F.flatten(F.transform(listed, lambda p: p["detections"])).alias("detections")
    )


def whatif(audit_rows: DataFrame, presets: list[float]) -> DataFrame:
    """How many documents each threshold would unlock, by the mean before it is rounded (audits(exact=True)): a few sums in one pass, not a join."""
    sums = [F.count_if(F.col("mean_confidence") >= p).alias(f"u{i}") for i, p in enumerate(presets)]
    one = audit_rows.agg(F.count(F.lit(1)).alias("n"), *sums)
    each = F.array(*[F.struct(F.lit(p).alias("threshold"), F.col(f"u{i}").cast("long").alias("unlocked"), (F.col("n") - F.col(f"u{i}")).cast("long").alias("locked"), F.lit(p < D.SAFETY_THRESHOLD).alias("non_production")) for i, p in enumerate(presets)])
    return one.select(F.inline(each))


def threshold_of(requests: DataFrame, at: str, value: str, default: float = D.SAFETY_THRESHOLD) -> DataFrame:
    """The threshold in force after a log of requests: the last one, cut to 0..1; one row. Rows of audits keep the status of their own time."""
    last = requests.agg(F.max_by(value, at).alias("v"))
    return last.select(X.clamp(F.coalesce(F.col("v").cast("double"), F.lit(default))).alias("threshold"))


def latest(store: DataFrame, key: str, at: str) -> DataFrame:
    """A keyed upsert over an append-only table: the last row of each key."""
    columns = [c for c in store.columns if c != key]
    return store.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(at)).alias("__last")).select(key, "__last.*")


def reviewed(audit_rows: DataFrame, events: DataFrame, key: str = "doc_id") -> DataFrame:
    """Review events unlock audits; unlocking twice changes nothing, and events on unknown documents are dropped. The trace of the review stays."""
    done = events.groupBy(key).agg(F.count(F.lit(1)).alias("reviews"))
    out = audit_rows.join(done, key, "left")
    return out.withColumn("reviews", F.coalesce("reviews", F.lit(0)).cast("long")).withColumn("final_status", F.when(F.col("reviews") > 0, F.lit("UNLOCKED")).otherwise(F.col("safety_status")))


def downloads(audit_rows: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """What a download of each wanted id gives: 404 unknown, 403 locked, 200 otherwise."""
    out = wanted.join(audit_rows.select(key, "safety_status"), key, "left")
    return out.select(key, F.when(F.col("safety_status").isNull(), 404).when(F.col("safety_status") != "UNLOCKED", 403).otherwise(200).cast("long").alias("http_status"))


def metadata(detected: DataFrame, key: str = "doc_id", raw: bool = False) -> DataFrame:
    """Rows of the metadata export: one for each detection, and one with nulls for a document without any. Original text only where it is
    asked for; snippets otherwise."""
    d = detected.select(key, F.posexplode_outer("detections").alias("seq", "d"))
    text = F.col("d.text") if raw else X.safe_snippet(F.col("d.text"))
    return d.select(key, F.col("seq").cast("long").alias("seq"), "d.entity_type", text.alias("original_text"), F.round("d.score", 4).alias("confidence_score"), "d.action", "d.detected_by")


def metadata_json(audited: DataFrame, name: str = "document_name", raw: bool = False) -> DataFrame:
    """One JSON payload for each document, whether it is locked or not: the audit's fields and its list of detections, empty if there are none.

    audited: audit_id, document name, timestamp (text), the columns of audits(), pages_processed, ocr_used and detections.
    """
    shown = lambda d: d["text"] if raw else X.safe_snippet(d["text"])
    each = F.transform(
        "detections",
        lambda d: F.struct(d["entity_type"].alias("entity_type"), shown(d).alias("original_text"), F.round(d["score"], 4).alias("confidence_score"), d["action"].alias("action"), d["detected_by"].alias("detected_by")),
    )
    counts = ["total_entities_detected", "total_entities_masked", "total_entities_kept", "pages_processed"]
    payload = F.struct("audit_id", F.col(name).alias("document_name"), "timestamp", "safety_status", "ensemble_mean_confidence", *counts, "ocr_used", F.lit(False).alias("gpu_accelerated"), each.alias("detections"))
    file = F.concat(F.lit("phi_metadata_"), F.replace(F.col(name).cast("string"), F.lit(".pdf"), F.lit("")), F.lit(".json"))
    return audited.select("audit_id", file.alias("file_name"), F.to_json(payload).alias("payload"))


def decided(detection_rows: DataFrame, decisions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Detections with a reviewer's last word on each (PENDING where there is none). decisions: key, seq, at, decision (confirmed or rejected)."""
    last = decisions.groupBy(key, "seq").agg(F.max_by("decision", "at").alias("decision"))
    return detection_rows.join(last, [key, "seq"], "left").withColumn("decision", F.coalesce("decision", F.lit("PENDING")))


def log_lines(audit_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One line for each document, with no personal data in it."""
    line = F.concat_ws(" ", F.lit("AUDIT"), F.col(key).cast("string"), F.concat(F.lit("detected="), "total_entities_detected"), F.concat(F.lit("masked="), "total_entities_masked"), F.concat(F.lit("status="), "safety_status"))
    return audit_rows.select(key, line.alias("line"))


def detection_lines(detected: DataFrame, key: str = "doc_id") -> DataFrame:
    """One line for each detection, with a snippet only."""
    d = detected.select(key, F.posexplode_outer("detections").alias("seq", "d")).where(F.col("seq").isNotNull())
    line = F.concat_ws(" ", F.lit("DETECTION"), F.col(key).cast("string"), "d.entity_type", F.concat(F.col("d.start").cast("string"), F.lit("-"), F.col("d.end").cast("string")), "d.action", X.safe_snippet(F.col("d.text")))
    return d.select(key, F.col("seq").cast("long").alias("seq"), line.alias("line"))


def message(status):
    return F.when(status == "UNLOCKED", F.lit("Document passed the confidence gate.")).otherwise(F.lit("Confidence below threshold: manual review required."))


def band(score):
    return F.when(score >= 0.9, F.lit("high")).when(score >= 0.7, F.lit("mid")).otherwise(F.lit("low"))


#: What two engines are compared by, and whether more is better.
METRICS = {"total_entities_detected": True, "total_entities_masked": True, "ensemble_mean_confidence": True, "processing_time_ms": False}


def compare_engines(a: DataFrame, b: DataFrame, key: str = "doc_id", metrics: dict[str, bool] | None = None) -> DataFrame:
    """Two engines' audits side by side, a row for each metric that both have: difference, and whether it is better."""
    chosen = {m: up for m, up in (metrics or METRICS).items() if m in a.columns and m in b.columns}
    side = lambda df, n: df.select(key, *[F.col(m).cast("double").alias(f"{n}_{i}") for i, m in enumerate(chosen)])
    both = side(a, "a").join(side(b, "b"), key)
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(up).alias("up"), F.col(f"a_{i}").alias("standard"), F.col(f"b_{i}").alias("custom"), F.round(F.col(f"b_{i}") - F.col(f"a_{i}"), 4).alias("difference")) for i, (m, up) in enumerate(chosen.items())])
    out = both.select(key, F.inline(each))
    return out.withColumn("verdict", F.when(F.col("difference") == 0, F.lit("same")).when((F.col("difference") > 0) == F.col("up"), F.lit("better")).otherwise(F.lit("worse"))).drop("up")
