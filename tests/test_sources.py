from pyspark.sql import functions as F

from spanloom.operators import audit, bio, detect
from spanloom.sources import readers, writers
from spanloom.streaming import detect as stream


def test_bio_files_go_round(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Dr. Rao met Sharma"), (2, "SSN 123-45-6789 here")], "doc_id long, text string")
    labelled = bio.chunk(bio.label(detect.standard(docs)), 2)
    writers.write_bio(labelled, f"{tmp_path}/bio")
    back = readers.read_bio(spark, f"{tmp_path}/bio")
    want = sorted((r["token"], r["label"]) for r in labelled.collect())
    assert sorted((r["token"], r["label"]) for r in back.collect()) == want
    assert ("Rao", "B-DoctorName") in want


def test_labels_go_round(spark, tmp_path):
    writers.write_labels(spark, f"{tmp_path}/labels")
    got = readers.read_labels(spark, f"{tmp_path}/labels").orderBy("id").collect()
    assert [r["label"] for r in got][:3] == ["O", "B-Name", "I-Name"] and len(got) == 21


def test_intake_of_names_with_special_characters(spark, tmp_path):
    for name in ("a b.pdf", "c+d.pdf", "100%.pdf", "é.pdf"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "empty one.pdf").write_bytes(b"")
    got = {r["path"].rsplit("/", 1)[1]: (r["length"], r["rejected"]) for r in readers.intake(readers.pdf_files(spark, str(tmp_path))).collect()}
    assert got == {"a b.pdf": (1, None), "c+d.pdf": (1, None), "100%.pdf": (1, None), "é.pdf": (1, None), "empty one.pdf": (0, "EMPTY")}


def test_intake_and_pages(spark, tmp_path):
    for name, data in (("a.pdf", b"one\ftwo"), ("b.PDF", b""), ("c.txt", b"x"), ("d.pdf", b"bad")):
        (tmp_path / name).write_bytes(data)
    files = readers.intake(readers.pdf_files(spark, str(tmp_path)))
    why = {r["path"].rsplit("/", 1)[1]: r["rejected"] for r in files.collect()}
    assert why == {"a.pdf": None, "b.PDF": "EMPTY", "c.txt": "NOT_PDF", "d.pdf": None}
    assert [r["path"].rsplit("/", 1)[1] for r in readers.pdf_files(spark, str(tmp_path), 2).collect()] == ["a.pdf", "b.PDF"]
    done = files.where("path like '%a.pdf'").select("path", F.lit("UNLOCKED").alias("safety_status"))
    state = {r["path"].rsplit("/", 1)[1]: (r["state"], r["detail"]) for r in readers.outcomes(files, done).collect()}
    assert state == {"a.pdf": ("success", None), "b.PDF": ("error", "EMPTY"), "c.txt": ("error", "NOT_PDF"), "d.pdf": ("error", "NOT_PROCESSED")}
    row = spark.createDataFrame([("b.PDF", 0)], "path string, length long")
    assert [readers.intake(row, e).first()["rejected"] for e in ("standard", "custom_biobert", "other")] == ["EMPTY", "MODEL_NOT_AVAILABLE", "UNKNOWN_ENGINE"]

    def reader(data):
        if data == b"bad":
            raise ValueError
        return data.decode().split("\f")

    pages = readers.extract_pages(files.where("rejected is null"), reader).collect()
    assert sorted((r["page_number"], r["page_status"]) for r in pages) == [(0, "FAILED: ValueError"), (1, "NATIVE"), (2, "NATIVE")]


def test_missing_report_and_model(spark, tmp_path):
    assert readers.read_report(spark, f"{tmp_path}/none.json") is None
    assert not readers.model_available(spark, str(tmp_path))
    assert readers.model_status(None, False) == {"available": False, "f1": 0.0, "precision": 0.0, "recall": 0.0, "sentences": 0}


def test_report_and_model(spark, tmp_path):
    (tmp_path / "report.json").write_text('{"eval_sentences": 67, "eval_metrics": {"eval_f1": 0.85, "eval_precision": 0.8}}')
    got = readers.model_status(readers.read_report(spark, f"{tmp_path}/report.json"), True)
    assert got == {"available": True, "f1": 0.85, "precision": 0.8, "recall": 0.0, "sentences": 67}
    for name, size in (("config.json", 2), ("label_map.json", 2), ("model.safetensors", 20_000)):
        (tmp_path / name).write_bytes(b"x" * size)
    assert readers.model_available(spark, str(tmp_path))


def test_stores_and_outputs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a [PERSON]", "UNLOCKED"), (2, "b", "LOCKED")], "doc_id long, redacted_text string, safety_status string")
    writers.write_redacted(df, f"{tmp_path}/red")
    assert [r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/red").collect()] == [1]
    for engine in ("standard", "custom_biobert"):
        writers.append_store(df, f"{tmp_path}/store", engine)
    back = spark.read.parquet(f"{tmp_path}/store")
    assert back.count() == 4 and {r["engine"] for r in audit.latest(back, "doc_id", "timestamp").collect()} == {"custom_biobert"}
    writers.write_json(df, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2


def test_classifier_windows(spark):
    engine = readers.token_classifier(lambda: lambda words: [("B-Name" if w == "Rao" else "O", 0.5) for w in words], size=3, stride=1)
    docs = spark.createDataFrame([(1, "a b c Rao d e f g"), (2, "")], "doc_id long, text string")
    assert [(r["start"], r["end"]) for r in bio.decode(engine(docs)).collect()] == [(6, 9)]


def test_stream_appends_audits(spark, tmp_path):
    spark.createDataFrame([(1, "Aadhaar 1234 5678 9012")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    stream.append_audits(s, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").first()["total_entities_masked"] == 1


def test_status_by_windows_of_time(spark, tmp_path):
    rows = [("2000-01-01 00:01:00", "LOCKED"), ("2000-01-01 00:02:00", "LOCKED"), ("2000-01-01 00:07:00", "UNLOCKED")]
    spark.createDataFrame(rows, "timestamp string, safety_status string").select(F.to_timestamp("timestamp").alias("timestamp"), "safety_status").write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("timestamp timestamp, safety_status string").parquet(f"{tmp_path}/in")
    q = stream.status_counts(s).writeStream.format("memory").queryName("statuses").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["safety_status"], r["n"]) for r in spark.table("statuses").collect()) == [("LOCKED", 2), ("UNLOCKED", 1)]


def test_another_engine_goes_through_the_same_steps(spark):
    predict = readers.token_classifier(lambda: lambda words: [("B-Name" if w == "Rao" else "B-Age" if w == "95" else "O", 0.99) for w in words])
    detect.register_engine("custom_biobert", bio.engine(predict))
    docs = spark.createDataFrame([(1, "Patient Rao is 95 today"), (2, "nothing"), (3, None)], "doc_id long, text string")
    out = {r["doc_id"]: r["detections"] for r in detect.ENGINES["custom_biobert"](docs).collect()}
    assert [(d["text"], d["entity_type"], d["action"], d["detected_by"]) for d in out[1]] == [("Rao", "PERSON", "MASKED", "custom_biobert"), ("95", "AGE", "AGE_AGGREGATED", "custom_biobert")]
    assert out[2] == out[3] == []
    assert {r["doc_id"]: r["safety_status"] for r in audit.audits(detect.ENGINES["custom_biobert"](docs)).collect()} == {1: "UNLOCKED", 2: "UNLOCKED", 3: "UNLOCKED"}
    del detect.ENGINES["custom_biobert"]


def test_upsert_keeps_the_last(spark):
    df = spark.createDataFrame([("a", 1, "LOCKED"), ("a", 2, "UNLOCKED"), ("b", 1, "LOCKED")], "id string, at int, status string")
    assert {r["id"]: r["status"] for r in audit.latest(df, "id", "at").collect()} == {"a": "UNLOCKED", "b": "LOCKED"}
    assert df.select(audit.band(F.lit(0.8)).alias("b")).first()["b"] == "mid"
