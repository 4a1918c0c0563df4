import re

from pyspark.sql import functions as F

import __spark_entry__
from spanloom.functions import text as X
from spanloom.operators import geometry

SMALL = "/root/testdata/sf0.001"


def plan(spark, name):
    return __spark_entry__.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def filters(text):
    return [x for x in text.splitlines() if x.lstrip(" :+-").startswith("Filter")]


def test_forms_are_recognized_once(spark):
    found = plan(spark, "analyze_forms")
    assert "RLIKE" in found and not [x for x in filters(found) if "RLIKE" in x]


def test_notes_are_recognized_and_merged_once(spark):
    found = plan(spark, "detect_merge")
    assert "RLIKE" in found and not [x for x in filters(found) if "RLIKE" in x]


def test_offsets_of_one_match_and_of_many_blocks_as_sql(spark):
    for text in ("é😀 7 x", "7", "é 1 " * 200):
        df = spark.createDataFrame([(text,)], "t string")
        for column in (X.spans_of(F.col("t"), "[0-9]+"), F.expr(X.spans_sql("t", "[0-9]+"))):
            got = df.select(column.alias("x")).first()["x"]
            assert [(s["start"], s["end"], s["text"]) for s in got] == [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", text)]


def odd_pages(spark):
    texts = ["", "  ", None, "Dr Rao é😀 saw 123-45-6789.  Rao again", "\n".join(f"w{i} Rao" for i in range(150)), "x"]
    kinds = [("PERSON", "MASKED"), ("AGE", "AGE_AGGREGATED"), ("DIAGNOSIS", "KEPT")]
    found = [[(i * 7, i * 7 + 1 + i % 9, *kinds[i % 3], ["rao", "zz saw 123-45", "qq", ""][i % 4]) for i in range(n)] for n in (1, 0, 1, 8, 400, 0)]
    rows = [(i, 1, t, f) for i, (t, f) in enumerate(zip(texts, found))]
    return spark.createDataFrame(rows, "doc_id long, page_number int, text string, detections array<struct<start:bigint,end:bigint,entity_type:string,action:string,text:string>>")


def both(spark):
    pages = odd_pages(spark)
    words = geometry.word_offsets(geometry.explode_words(pages)).withColumns({"x0": F.col("start") * 6.0, "y0": F.lit(0.0), "x1": F.col("end") * 6.0, "y1": F.lit(10.0)})
    entities = pages.select("doc_id", "page_number", F.posexplode("detections").alias("seq", "d")).select("doc_id", "page_number", F.col("seq").cast("long").alias("seq"), "d.*")
    return pages, geometry.page_words(F.col("text"), lambda w: [w["start"] * 6.0, F.lit(0.0), w["end"] * 6.0, F.lit(10.0)]), entities, words


def joins(text):
    return [x for x in text.splitlines() if " Join " in x or "Aggregate" in x or "Window" in x]


def same(mine, other):
    assert mine.count() > 0
    assert sorted(map(str, mine.collect())) == sorted(map(str, other.select(*mine.columns).collect()))


def test_boxes_of_pages(spark):
    pages, placed, entities, words = both(spark)
    same(geometry.boxes_of_pages(pages, placed), geometry.union_boxes(entities, words))
    assert not joins(plan(spark, "union_bbox"))


def test_annotations_of_pages(spark):
    pages, placed, entities, words = both(spark)
    same(geometry.annotations_of_pages(pages, placed), geometry.annotations(entities, words))
    assert not joins(plan(spark, "mask_annotations"))


def test_fallback_of_pages(spark):
    pages, placed, entities, words = both(spark)
    same(geometry.fallback_of_pages(pages, placed), geometry.fallback(entities, words))
    assert not joins(plan(spark, "fallback_rects"))
