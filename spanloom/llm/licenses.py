"""License scans by diagonal voting.

Every rolling k-gram of every document's words is hashed and joined with the positions of the templates' k-grams. A hit votes for the
offset diagonal (document position minus template position) that it lies on; the template positions met are collected by diagonal
as bits of a long (a template has fewer than 64), neighbouring
diagonals of a template are merged (words put in or left out), and a merged span is verified: the words of
each hit are compared, the words covered (by all hits of the merged diagonals) must make up enough of the template, and the span must not be
much longer than it. Templates share phrases, so a span that overlaps another template's verified span with more words covered (of equal ones,
the earlier template's) isn't labelled. Base places always stay.

The templates are the fixed list below, so their side of the join is broadcast: its size doesn't depend on the data. Only hits are
shuffled. Null text has no words. Documents without hits get a row with no labels. Repeated rows are documents of their
own; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import ids_and_texts

K = 3
#: Phrases whose every place counts, and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Further texts that the method looks for.
TEMPLATES = [
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("licensed under the creative commons attribution noncommercial", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
]
#: Diagonals so near belong together; so many percent of a template must be covered; a span may have so many percent of its length.
NEAR, COVERED, STRETCH = 4, 60, 150
#: The word pattern, on text whose letters A-Z needn't be lower-cased yet.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEAD = -1  # the entry that every document meets once


def templates() -> list[tuple[list[str], str, bool]]:
    return [(t.split(), label, base) for kind, base in ((PHRASES, True), (TEMPLATES, False)) for t, label in kind]


def _positions(spark: SparkSession) -> DataFrame:
    rows = [(i, p, " ".join(words[p : p + K])) for i, (words, _, _) in enumerate(templates()) for p in range(len(words) - K + 1)]
    grams = spark.createDataFrame(rows, "template int, place int, gram string")
    parts = [F.element_at(F.split("gram", " "), i + 1) for i in range(K)]
    head = spark.createDataFrame([(_HEAD, 0, "", 0)], "template int, place int, gram string, h long")
    return grams.withColumn("h", F.xxhash64(*parts)).unionByName(head)


def hits(docs: DataFrame) -> DataFrame:
    """A row for each k-gram of a document that stands in a template, and one head row (template -1) for each document."""
    spark = docs.sparkSession
    words = F.regexp_extract_all(F.col("text"), F.lit(_WORD), F.lit(0))
    own = ids_and_texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("words"))
    low = F.transform("words", lambda w: F.lower(w))
    grams = F.element_at(
        F.transform(F.array(low), lambda ws: F.transform(ws, lambda w, i: F.xxhash64(w, *[F.get(ws, i + j) for j in range(1, K)]))), 1
    )
    own = own.withColumn("grams", F.concat(F.array(F.lit(0).cast("long")), grams))
    each = own.select("row", "doc_id", "words", F.posexplode("grams").alias("pos", "h"))
    met = each.join(F.broadcast(_positions(spark)), "h")
    gram = F.translate(F.array_join(F.slice("words", F.greatest(F.col("pos"), F.lit(1)), K), " "), _UPPER, _LOWER)
    same = (F.col("template") == _HEAD) & (F.col("pos") == 0) | (F.col("template") != _HEAD) & (F.col("pos") > 0) & (gram == F.col("gram"))
    return met.where(same).select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "template", "place", (F.col("pos") - 1).alias("pos"))


_RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def resolve(votes: list[dict], texts: list[tuple[list[str], str, bool]]) -> tuple:
    """From a document's votes (template, diagonal, places: a bit for each template position met) to its labels."""
    places, base, verified, score, spans = [], set(), [], 0.0, set()
    by: dict[int, list[tuple[int, list[int]]]] = {}
    for v in votes:
        if v["template"] >= 0:
            by.setdefault(v["template"], []).append((v["diagonal"], [p for p in range(v["places"].bit_length()) if v["places"] >> p & 1]))
    for i in sorted(by):
        words, label, is_base = texts[i]
        merged: list[list[tuple[int, list[int]]]] = []
        for diagonal, met in sorted(by[i]):
            if is_base and len(met) == len(words) - K + 1:
                places.append(diagonal)
                base.add(label)
                spans.add((diagonal, diagonal + len(words), label))
            if merged and diagonal - merged[-1][-1][0] <= NEAR:
                merged[-1].append((diagonal, met))
            else:
                merged.append([(diagonal, met)])
        for group in merged:
            # the words of each hit; a replaced word is a gap between hits
            covered = len({q for _, met in group for p in met for q in range(p, p + K)})
            start, end = min(d + met[0] for d, met in group), max(d + met[-1] + K for d, met in group)
            score = max(score, covered / len(words))
            if 100 * covered >= COVERED * len(words) and 100 * (end - start) <= STRETCH * len(words):
                verified.append((start, end, (covered, -i), label))
    verified.sort()
    longest = max((v[1] - v[0] for v in verified), default=0)
    beaten = set()
    for a, x in enumerate(verified):
        for b in range(a + 1, len(verified)):
            y = verified[b]
            if y[0] >= x[0] + longest:
                break
            if y[0] < x[1] and x[2][1] != y[2][1]:
                beaten.add(a if x[2] < y[2] else b)
    found = [v for a, v in enumerate(verified) if a not in beaten]
    spans.update((start, end, label) for start, end, _, label in found)
    labels = sorted(base | {v[3] for v in found})
    return len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), round(score, 6), ",".join(f"{x}:{a}:{b}" for a, b, x in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of each document."""
    diagonal = (F.col("pos") - F.col("place")).cast("long")
    votes = hits(docs).groupBy("row", "doc_id", "n_words", "template", diagonal.alias("diagonal")).agg(F.expr("bit_or(shiftleft(1L, place))").alias("places"))
    each = votes.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list(F.struct("template", "diagonal", "places")).alias("votes"))

    def run(batches):
        texts = templates()
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string())])
        for batch in batches:
            rows = [(d, n, *resolve(v, texts)) for d, n, v in zip(batch.column("doc_id").to_pylist(), batch.column("n_words").to_pylist(), batch.column("votes").to_pylist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return each.select("doc_id", "n_words", "votes").mapInArrow(run, _RESULT)
