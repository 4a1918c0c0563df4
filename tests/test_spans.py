import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators import audit, bio, detect, geometry

SPAN = detect.SPAN


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def merged(spark, *spans):
    rows = [(s, e, t, p, b, "x" * (e - s), "p") for t, s, e, p, b in spans]
    df = spark.createDataFrame([(rows,)], f"s array<{SPAN}>")
    return [(r["entity_type"], r["start"], r["end"], r["score"], r["detected_by"]) for r in df.select(detect.merge(F.col("s")).alias("m")).first()["m"]]


@pytest.mark.parametrize(
    "spans,expected",
    [
        ([("PERSON", 0, 8, 0.99, "presidio"), ("MEDICAL_CONDITION", 3, 6, 0.5, "presidio")], [("MEDICAL_CONDITION", 3, 6, 0.5, "presidio")]),
        ([("PERSON", 0, 3, 0.9, "presidio"), ("PERSON", 0, 8, 0.8, "presidio")], [("PERSON", 0, 8, 0.9, "presidio")]),
        ([("PERSON", 0, 8, 0.8, "presidio"), ("PERSON", 1, 8, 0.9, "presidio")], [("PERSON", 0, 8, 0.9, "presidio")]),
        ([("US_SSN", 0, 9, 0.75, "presidio"), ("PERSON", 4, 12, 0.85, "presidio")], [("PERSON", 4, 12, 0.85, "presidio")]),
        ([("US_SSN", 0, 9, 0.85, "presidio"), ("PERSON", 4, 12, 0.75, "presidio")], [("US_SSN", 0, 9, 0.85, "presidio")]),
        ([("DIAGNOSIS", 0, 5, 0.92, "openbioner"), ("MEDICAL_CONDITION", 0, 5, 0.95, "presidio")], [("MEDICAL_CONDITION", 0, 5, 0.95, "ensemble")]),
        ([], []),
    ],
)
def test_merge_rules(spark, spans, expected):
    assert merged(spark, *spans) == expected


@pytest.mark.parametrize("text", ["", "a1b22c333", "é😀 12 x\n34", "no digits", "7"])
def test_offsets_as_python_has_them(spark, text):
    got = one(spark, X.spans_of(F.col("t"), "[0-9]+"), t=text)
    assert [(s["start"], s["end"], s["text"]) for s in got] == [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", text)]


@pytest.mark.parametrize("text", ["", "a1b22c333", "é😀 12 x\n34", "7 " * 300])
def test_offsets_as_sql(spark, text):
    got = one(spark, F.expr(X.spans_sql("t", "[0-9]+")), t=text)
    assert [(s["start"], s["end"], s["text"]) for s in got] == [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", text)]


def test_offsets_in_a_long_text(spark):
    text = "ab é " * 20_000
    got = one(spark, X.tokens(F.col("t")), t=text)
    assert [(s["start"], s["end"]) for s in got] == [m.span() for m in re.finditer(r"\S+", text)]


def test_spans_within_spans_by_brute_force(spark):
    R = random.Random(4)
    for _ in range(20):
        spans = [(a, a + R.randint(1, 9), R.choice("AB"), R.choice([0.4, 0.5, 0.9]), "presidio", "x", f"p{i}") for i, a in enumerate(R.randint(0, 20) for _ in range(R.randint(0, 150)))]
        held = lambda s: any(o is not s and o[2] == s[2] and o[0] <= s[0] and o[1] >= s[1] and (o[3] > s[3] or o[3] == s[3] and (o[1] - o[0] > s[1] - s[0] or o[6] < s[6])) for o in spans)  # noqa: B023, E731
        df = spark.createDataFrame([(spans,)], f"s array<{SPAN}>")
        got = df.select(detect.without_contained(F.col("s")).alias("x")).first()["x"]
        assert sorted(r["pattern_name"] for r in got) == sorted(s[6] for s in spans if not held(s))


def test_merge_of_many_spans_by_brute_force(spark):
    R = random.Random(6)
    med = {"MEDICAL_CONDITION", "DIAGNOSIS"}
    for _ in range(10):
        spans = [(a, a + R.randint(1, 6), R.choice(["PERSON", "US_SSN", *sorted(med)]), R.choice([0.5, 0.8, 0.9]), R.choice(["presidio", "openbioner"]), "x", f"p{i:03}") for i, a in enumerate(R.randint(0, 400) for _ in range(R.randint(100, 300)))]
        kept = []
        for x in sorted(spans, key=lambda s: (s[0], -s[3], s[4] != "presidio", s[2], s[1], s[6])):
            y = kept[-1] if kept else None
            if y is None or x[0] >= y[1] or x[1] <= y[0]:
                kept.append(x)
                continue
            nx, ny, best = x[1] - x[0], y[1] - y[0], max(x[3], y[3])
            if (x[2] in med) != (y[2] in med):
                w = x if x[2] in med else y
            elif x[2] == y[2] and nx != ny:
                w = x if nx > ny else y
                w = (*w[:3], best, *w[4:])
            else:
                w = x if x[3] > y[3] else y
            kept[-1] = (*w[:4], "ensemble" if x[4] != y[4] else w[4], *w[5:])
        df = spark.createDataFrame([(spans,)], f"s array<{SPAN}>")
        got = [(r["start"], r["end"], r["entity_type"], r["score"], r["detected_by"], r["pattern_name"]) for r in df.select(detect.merge(F.col("s")).alias("m")).first()["m"]]
        assert got == [(*k[:5], k[6]) for k in kept]


def test_context_words_far_back_in_a_text_of_long_words(spark):
    long = "x" * 500
    df = spark.createDataFrame([(1, f"ssn {long} 123-45-6789"), (2, f"ssn {long} a b c d e 123-45-6789"), (3, "ss # 123-45-6789"), (4, "years old 123-45-6789")], "doc_id long, text string")
    got = {r["doc_id"]: r["s"][0]["score"] for r in df.select("doc_id", detect.analyzed("text").alias("s")).collect()}
    assert got == {1: 1.0, 2: 0.75, 3: 1.0, 4: 0.75}


def test_the_default_engine_masks_general_kinds(spark):
    text = "Patient Rao mail a@b.org host 10.0.0.1 on 2020-01-02 ssn 123-45-6789, see https://x.org/y, card 4111 1111 1111 1111, IBAN GB82WEST12345698765432"
    df = detect.standard(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    red = df.select(detect.redact(F.col("text"), F.col("detections")).alias("r")).first()["r"]
    assert red == "Patient [PERSON] mail [EMAIL_ADDRESS] host [IP_ADDRESS] on [DATE_TIME] ssn [US_SSN], see [URL], card [CREDIT_CARD], IBAN [IBAN_CODE]"
    for secret in ("a@b.org", "10.0.0.1", "2020", "6789", "x.org", "4111", "GB82"):
        assert secret not in red


def test_a_model_for_names_can_be_plugged_in(spark):
    named = lambda text: F.transform(X.spans_of(text, "Zed"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("LOCATION").alias("entity_type"), F.lit(0.85).alias("score"), F.lit("presidio").alias("detected_by"), s["text"].alias("text"), F.lit("model").alias("pattern_name")))
    df = detect.standard(spark.createDataFrame([(1, "from Zed"), (2, None), (3, "  ")], "doc_id long, text string"), named=named)
    assert {r["doc_id"]: [d["entity_type"] for d in r["detections"]] for r in df.collect()} == {1: ["LOCATION"], 2: [], 3: []}


@pytest.mark.parametrize("step", ["rows", "label", "audits", "lines", "redact"])
def test_detection_stands_once_in_each_plan(spark, step):
    df = detect.standard(spark.createDataFrame([(1, "a")], "doc_id long, text string").repartition(2))
    out = {"rows": detect.rows, "label": bio.label, "audits": audit.audits, "lines": audit.detection_lines, "redact": lambda d: d.select(detect.redact(F.col("text"), F.col("detections")))}[step](df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MR#") == 3  # a test, the matches and the pieces between them


def test_labels_by_brute_force(spark):
    R = random.Random(2)
    rows = []
    for i in range(40):
        words = [R.choice(["Rao", "Dr", "x", "123-45-6789", "a@b.org", "diabetes", "Kumar,"]) for _ in range(R.randint(0, 30))]
        rows.append((i, R.choice([" ", "  ", "\n"]).join(words)))
    df = detect.standard(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    got = {(r["doc_id"], r["token_no"]): (r["token"], r["label"]) for r in bio.label(df).collect()}
    stems = {}
    for r in bio.stems(df).collect():
        stems.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["stem"]))
    want = {}
    for i, text in rows:
        tokens = [(m.start(), m.end(), m.group()) for m in re.finditer(r"\S+", text)]
        labels = ["O"] * len(tokens)
        for s, e, stem in sorted(stems.get(i, [])):
            for k, n in enumerate([n for n, t in enumerate(tokens) if t[0] < e and t[1] > s]):
                labels[n] = ("I-" if k else "B-") + stem
        want |= {(i, n): (t[2], labels[n]) for n, t in enumerate(tokens)}
    assert got == want and any(x[1].startswith("I-") for x in want.values()) or got == want


def test_pages_that_failed_lock_their_document(spark):
    rows = [(1, 1, "fine", False, "NATIVE"), (1, 2, "", True, "OCR_FAILED"), (2, 1, "fine", True, "OCR"), (3, 0, "", False, "FAILED: ValueError")]
    pages = detect.standard(spark.createDataFrame(rows, "doc_id long, page_number int, text string, is_ocr boolean, page_status string"))
    whole = audit.of_pages(pages)
    assert {r["doc_id"]: (r["pages_processed"], r["ocr_used"], r["failed"]) for r in whole.collect()} == {1: (2, True, True), 2: (1, True, False), 3: (1, False, True)}
    assert {r["doc_id"]: r["safety_status"] for r in audit.audits(whole, failed="failed").collect()} == {1: "LOCKED", 2: "UNLOCKED", 3: "LOCKED"}


def test_the_gate_and_the_presets_use_the_mean_before_rounding(spark):
    rows = [(i, [(0, 1, "PERSON", s, "presidio", "x", "p", "MASKED")]) for i, s in enumerate([0.97996, 0.98, 0.85])]
    df = spark.createDataFrame(rows, f"doc_id long, detections array<{SPAN[:-1]},action:string>>")
    a = audit.audits(df, exact=True)
    assert {r["doc_id"]: (r["ensemble_mean_confidence"], r["safety_status"]) for r in a.collect()} == {0: (0.98, "LOCKED"), 1: (0.98, "UNLOCKED"), 2: (0.85, "LOCKED")}
    assert {r["threshold"]: r["unlocked"] for r in audit.whatif(a, [0.98, 0.85, 0.9]).collect()} == {0.98: 1, 0.85: 3, 0.9: 2}


def test_thresholds_are_cut_to_0_and_1(spark):
    log = spark.createDataFrame([(1, -1.0), (2, 2.0)], "at int, v double")
    assert [audit.threshold_of(x, "at", "v").first()["threshold"] for x in (log, log.where("at = 1"), log.limit(0))] == [1.0, 0.0, 0.98]


def test_metadata_payload(spark):
    import json

    df = detect.standard(spark.createDataFrame([(1, "Aadhaar 1234 5678 9012"), (2, "")], "doc_id long, text string"))
    both = audit.audits(df.withColumn("k", F.struct("doc_id", "detections")), key="k")
    both = both.select(audit.audit_id("k.doc_id").alias("audit_id"), F.concat(F.col("k.doc_id").cast("string"), F.lit(".pdf")).alias("document_name"), F.lit("t").alias("timestamp"), "total_entities_detected", "total_entities_masked", "total_entities_kept", "ensemble_mean_confidence", "safety_status", F.lit(1).alias("pages_processed"), F.lit(False).alias("ocr_used"), "k.detections")
    got = {r["file_name"]: json.loads(r["payload"]) for r in audit.metadata_json(both).collect()}
    assert set(got) == {"phi_metadata_1.json", "phi_metadata_2.json"} and all(len(p) == 12 for p in got.values())
    assert got["phi_metadata_2.json"]["detections"] == [] and got["phi_metadata_1.json"]["detections"][0]["original_text"] == "1234***"
    assert json.loads(audit.metadata_json(both, raw=True).where("file_name like '%1.json'").first()["payload"])["detections"][0]["original_text"] == "1234 5678 9012"


def test_search_for_what_has_no_place(spark):
    words = geometry.word_offsets(spark.createDataFrame([(1, 1, i, w, 10.0 * i, 0.0, 10.0 * i + 9, 9.0) for i, w in enumerate("Mr Rao (A+B) met rao\\E x".split())], "doc_id long, page_number int, word_no int, word string, x0 double, y0 double, x1 double, y1 double"))
    rows = [(1, 1, s, 900, 910, "PERSON", t, "MASKED") for s, t in enumerate(["rao", "met Zoe", "zz", "(a+b)", "Rao\\E"])] + [(1, 1, 9, 0, 2, "PERSON", "Mr", "MASKED"), (1, 1, 8, 900, 910, "AGE", "Mr", "KEPT")]
    got = geometry.fallback(spark.createDataFrame(rows, "doc_id long, page_number int, seq long, start long, end long, entity_type string, text string, action string"), words).collect()
    assert sorted((r["seq"], r["located_by"], -1 if r["word_no"] is None else r["word_no"]) for r in got) == [(0, "WHOLE", 1), (0, "WHOLE", 4), (1, "WORDS", 3), (2, "UNLOCATED", -1), (3, "WHOLE", 2), (4, "WHOLE", 4)]


def test_reviewers_last_word(spark):
    d = spark.createDataFrame([(1, 0, "PERSON"), (1, 1, "AGE")], "doc_id long, seq long, entity_type string")
    said = spark.createDataFrame([(1, 0, 1, "confirmed"), (1, 0, 2, "rejected"), (7, 0, 1, "confirmed")], "doc_id long, seq long, at int, decision string")
    assert {r["seq"]: r["decision"] for r in audit.decided(d, said).collect()} == {0: "rejected", 1: "PENDING"}


@pytest.mark.parametrize("text,shown", [("abcd", "****"), ("abcde", "abcd***"), ("", "")])
def test_snippet(spark, text, shown):
    assert one(spark, X.safe_snippet(F.col("t")), t=text) == shown


@pytest.mark.parametrize("text,shown", [("901", "90+"), ("089", "089"), ("0090", "90+"), ("age 90", "age 90+"), ("aged 89", "aged 89")])
def test_ages(spark, text, shown):
    assert one(spark, X.aggregate_age(F.col("t")), t=text) == shown


def test_first_line(spark):
    assert one(spark, X.first_line(F.col("t")), t="A B \nC") == "A B"
    assert one(spark, X.first_line(F.col("t")), t="\nC") == "\nC"


def test_kinship_window(spark):
    near, far = "S/O a b c d Rao", "D/O a b c d e Rao"  # the context of five words reaches as far, but raises to 1 at most
    for text, boosted in ((near, True), (far, False), ("Mr. Sen", False)):
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        d = [x for x in detect.standard(df).first()["detections"] if x["entity_type"] == "PERSON"]
        assert (d[0]["detected_by"] == "ensemble") == boosted, text


def test_smoke_sentence(spark):
    text = "Patient Rao S/O Subramaniam, Aadhaar 1234 5678 9012, PAN ABCDE1234F, phone +919876543210, Male, has diabetes at the cardiology department. Age 95 years old"
    df = detect.standard(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    out = {d["text"]: d for d in df.first()["detections"]}
    assert out["Rao"]["score"] == 1.0 and out["diabetes"]["detected_by"] == "ensemble" and out["diabetes"]["action"] == "KEPT"
    assert out["+919876543210"]["score"] == 0.9 and out["Male"]["action"] == "KEPT"
    assert any(d["action"] == "AGE_AGGREGATED" for d in out.values())
    red = df.select(detect.redact(F.col("text"), F.col("detections")).alias("r")).first()["r"]
    assert "9876543210" not in red and "ABCDE1234F" not in red and "90+" in red
    a = audit.audits(df).first()
    assert a["total_entities_masked"] + a["total_entities_kept"] == a["total_entities_detected"]


def test_nothing_masked_unlocks_but_failures_lock(spark):
    df = detect.standard(spark.createDataFrame([(1, "diabetes"), (2, "")], "doc_id long, text string")).withColumn("bad", F.col("doc_id") == 2)
    assert {r["safety_status"] for r in audit.audits(df).collect()} == {"UNLOCKED"}
    assert {r["doc_id"]: r["safety_status"] for r in audit.audits(df, failed="bad").collect()} == {1: "UNLOCKED", 2: "LOCKED"}


@pytest.mark.parametrize("check,good,bad", [("luhn", "4111 1111 1111 1111", "4111111111111112"), ("octets", "1.2.3.255", "1.2.3.256"), ("mod97", "GB82WEST12345698765432", "GB82WEST12345698765433"), ("mod11", "9434765919", "9434765918"), ("dea", "AB1234563", "AB1234564"), ("nine", "+1 212 555 1234", "+1 212 555"), ("groups", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7"), ("groups", "fe80::1", "1:2:3:4:5:6::7:8")])
def test_checks(spark, check, good, bad):
    assert one(spark, F.expr(X.passes(check, "t")), t=good) and not one(spark, F.expr(X.passes(check, "t")), t=bad)


def test_bio_decoding(spark):
    def run(labels):
        rows = [(1, i, "w", 10 * i, 10 * i + 5, x, 0.5) for i, x in enumerate(labels)]
        df = spark.createDataFrame(rows, "doc_id long, pos long, word string, char_start long, char_end long, label string, score double")
        return [(r["start"], r["end"], r["entity_type"]) for r in bio.decode(df).orderBy("start").collect()]

    assert run(["I-Name", "O"]) == []
    assert run(["B-Name", "I-Date"]) == [(0, 5, "PERSON"), (10, 15, "DATE_TIME")]
    assert run(["B-Name", "O", "I-Name"]) == [(0, 5, "PERSON")]
    assert run(["B-Name", "I-Name", "B-Name"]) == [(0, 15, "PERSON"), (20, 25, "PERSON")]
