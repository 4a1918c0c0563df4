"""Small tests of the training-data operators: brute force, round trips, hard rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import common, licenses, media, neardup, packing, pii, quality, queries, spiece, tokenstore, toxicity, warc
from spanloom.llm.queries import tokenizer_path
from spanloom.llm.wordbpe import WordBpe

WORDS = tokenizer_path("word_bpe_49k.json")
LONG = "lorem ipsum dolor sit amet " * 4000
TEXTS = ["", None, "one", "a b c", "The cat sat on the mat and the cat sat on the mat again and again today", "É ñ 中文 🙂 x@y.org", LONG, "same text with more than four words", "same text with more than four words", "line\nline\nline two", "under the MIT License. Apache License, Version 2; CC BY-NC"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", i, "x") for i, t in enumerate(TEXTS)] + [(None, "no id at all in this row", "x", 0, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int, label string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 3 % 2, i % 2) for i in range(len(TEXTS))], "doc_id long, low_quality int, toxic int")


def random_texts(n, alphabet="ab'c1 .é\nstx", seed=3):
    R = random.Random(seed)
    return ["".join(R.choice(alphabet) for _ in range(R.randint(0, 40))) for _ in range(n)]


def test_every_operator_takes_hard_rows_and_empty_tables(spark, docs, empty, labels):
    path = tokenizer_path("piece_bpe_32k.model")
    chain = toxicity.train(docs, labels)
    for op in (lambda d: toxicity.score(d, chain), media.media_columns, pii.find, quality.ledger, lambda d: tokenstore.store(d, WORDS, 2), lambda d: spiece.digests(d, path), licenses.scan, neardup.near_duplicates):
        assert op(docs).count() == len(TEXTS) + 1
        assert op(empty).count() == 0
    assert packing.best_fit(empty, WORDS, 1).count() == 0
    for keep in (quality.keep_documents, neardup.keep_documents, pii.redact_documents, lambda d: toxicity.keep_documents(d, chain)):
        assert keep(docs).columns == docs.columns and keep(empty).count() == 0


def test_training_without_both_labels(spark, docs, labels):
    for none in (labels.where("toxic = 0"), labels.where("toxic is null")):
        assert toxicity.score(docs, toxicity.train(docs, none)).where("toxic").count() == 0
    assert toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 1"))).where("not toxic").count() == 0


def test_labels_of_any_id_and_of_the_table(spark):
    docs = spark.createDataFrame([(i, "bad words here" if i % 2 else "good words there") for i in range(-40, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2, i % 2) for i in range(-40, 40)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, toxicity.table_labels(labels))
    assert chain.categories == ["low_quality", "toxic"] and len(chain.weights) == 2 and len(chain.weights[1]) == len(chain.weights[0]) + 1
    assert {r["toxic"] for r in toxicity.score(docs, chain).where("doc_id % 2 = 0").collect()} == {False}
    assert {r["toxic"] for r in toxicity.score(docs, chain).where("doc_id % 2 <> 0").collect()} == {True}
    assert toxicity.table_labels(labels.drop("quality")).columns == ["doc_id", "toxic"]


def test_thresholds_by_brute_force():
    R = random.Random(3)
    for _ in range(200):
        p = np.array([R.choice([0.1, 0.2, 0.4, 0.7, 0.9]) for _ in range(R.randint(2, 12))])
        y = np.array([R.randint(0, 1) for _ in p])
        if y.min() == y.max():
            continue
        f1 = lambda t: 2 * (y * (p >= t)).sum() / ((p >= t).sum() + y.sum())  # noqa: B023, E731
        assert f1(toxicity.best_threshold(p, y)) == max(f1(t) for t in p)


def test_scores_of_the_chain_by_brute_force(spark):
    """Each category's probability from its weights, one text and one link of the chain at a time."""
    texts = random_texts(200, "abcd ", 12)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("ab" in t), int("cd" in t)) for i, t in enumerate(texts)], "doc_id long, a int, b int")
    chain = toxicity.train(df, labels)
    for r in toxicity.score(df, chain).collect():
        known = [chain.vocabulary[f] for f in toxicity.features(texts[r["doc_id"]]) if f in chain.vocabulary]
        before = []
        for w in chain.weights:
            z = sum(w[k] for k in known) + sum(p * w[len(chain.vocabulary) + i] for i, p in enumerate(before)) + w[-1]
            before.append(1 / (1 + math.exp(-z)))
        assert (r["p_a"], r["p_b"]) == pytest.approx(before, abs=1e-6) and r["toxic"] == (round(before[-1], 9) >= chain.threshold) == (not r["kept"])

def test_chain_on_held_out_rows(spark):
    R = random.Random(5)
    words = ["".join(R.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = []
    for i in range(900):
        bad = i % 5 == 0
        rows.append((i, " ".join(R.choices(words, k=30) + ([R.choice(["idiot", "grumwort", "grumlich", "grumpel"])] if bad else [])), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    chain = toxicity.train(df, df.where("doc_id < 600").select("doc_id", "toxic"))
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score(df.where("doc_id >= 600"), chain).collect()}
    assert sum(got[i] == bool(t) for i, _, t in rows[600:]) >= 295


def test_png_round_trip_and_damage():
    for t in ("", "x" * 576, "é" * 1000):
        n, payload = media.payload_of(t)
        png = media.encode_png(payload)
        assert media.decode_png(png).tobytes() == payload and payload.rstrip(b"\xff").decode() == t
        with pytest.raises(ValueError):
            media.decode_png(png[:50] + bytes([png[50] ^ 1]) + png[51:])


def test_all_row_filters():
    R = np.random.RandomState(1)
    image = R.randint(0, 256, (12, 20)).astype(np.uint8)
    kinds = np.array([0, 1, 2, 3, 4, 4, 3, 2, 2, 1, 1, 0], np.uint8)
    raw = np.zeros_like(image)
    for r in range(12):
        for x in range(20):
            a, b, c = (int(image[r, x - 1]) if x else 0), (int(image[r - 1, x]) if r else 0), (int(image[r - 1, x - 1]) if r and x else 0)
            p = a + b - c
            paeth = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            raw[r, x] = (int(image[r, x]) - [0, a, b, (a + b) // 2, paeth][kinds[r]]) % 256
    assert (media.unfilter(raw, kinds) == image).all()
    assert (media.filtered(image, kinds)[0] == raw).all()


def test_the_writer_chooses_filters_and_the_reader_undoes_them():
    text = "abcdefgh" * 72 + "abcdefgh" * 72 + "a" * 576 + "".join(chr(33 + i * 7 % 90) for i in range(576))
    payload = media.payload_of(text)[1]
    png = media.encode_png(payload)
    data = zlib.decompress(b"".join(d for k, d in media.png_chunks(png) if k == b"IDAT"))
    assert {data[0], data[577], data[1154]} == {1, 2} and media.decode_png(png).tobytes() == payload
    for width in (1, 2, 33):
        image = np.random.RandomState(width).randint(0, 256, (30, width)).astype(np.uint8)
        for kinds in itertools.product(range(5), repeat=2):
            assert (media.decode_png(media.encode_png(image.tobytes(), width, 1, np.array(kinds * 15, np.uint8))) == image).all()


def test_base_spans_by_brute_force():
    def brute(x):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
        return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15])

    for x in random_texts(20000, "a@.1+ 2-()4x%é0"):
        assert pii.base_spans(x) == brute(x)


def test_semi_crf_on_held_out_sentences():
    crf, hit, wrong, missed = pii.model(), 0, 0, 0
    for text, gold in pii.training_data(200, 77):
        got = {s for i in pii.islands(text) for s in crf.decode(text, i)}
        hit, wrong, missed = hit + len(got & set(gold)), wrong + len(got - set(gold)), missed + len(set(gold) - got)
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.95


def test_quality_measures_by_brute_force(spark):
    texts = random_texts(300, "ab \n#|!", 4) + ["a b c d e f g h i " * 3, "x " * 50]

    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = quality.ledger(df).collect()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(texts[r["doc_id"]])
    a = {(r["policy"], r["rule"]): r for r in quality.ablations(quality.ledger(df)).collect()}
    assert a["v1", "few_words"]["failing"] == sum(r["failed"] & 1 for r in rows)
    assert a["v1", "few_words"]["only"] == sum(r["failed"] == 1 for r in rows)


def test_word_ids_as_the_library_has_them():
    bpe = WordBpe(WORDS)
    texts = random_texts(4000) + random_texts(2000, "aB'''stmdrevl9 \n.!éÉ²½ª\xa0\x85µß中Σ<|endoftext|>", 9)
    assert bpe.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in bpe.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_store_gives_the_ids_back(spark, docs):
    bpe, path = WordBpe.get(WORDS), tokenstore.scratch(spark, "test")
    tokenstore.write_store(docs.where("doc_id is not null"), path, WORDS, 2)
    want, start = {}, 0
    for i, t in enumerate(TEXTS):
        ids = bpe.encode([t or ""])[0] + struct.pack("<I", 2)
        want[i] = (start, len(ids) // 4, zlib.crc32(ids), list(np.frombuffer(ids, "<u4")))
        start += len(ids) // 4
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenstore.read_back(spark, path).collect()} == {k: v[:3] for k, v in want.items()}
    assert {r["doc_id"]: r["ids"] for r in tokenstore.reconstruct(spark, path).collect()} == {k: v[3] for k, v in want.items()}
    assert all(r["intact"] for r in tokenstore.verify(spark, path).collect())
    c = tokenstore.chunks(spark, path)
    assert c.count() == c.select("digest").distinct().count()


def test_a_damaged_store_raises(spark, docs, tmp_path):
    def damaged(name, change):
        path = f"file://{tmp_path}/{name}"
        tokenstore.write_store(docs, path, WORDS, 2)
        for folder, columns in (("recipes", "doc_id"), ("raw", "kind")):
            df = spark.read.parquet(f"{path}/{folder}")
            change(folder, df).write.partitionBy(*(["kind"] if folder == "raw" else [])).parquet(f"{path}/{folder}-new")
            common.removed(spark, f"{path}/{folder}")
            (tmp_path / name / f"{folder}-new").rename(tmp_path / name / folder)
        return path

    tokenstore.read_back(spark, damaged("whole", lambda f, df: df)).collect()
    lost = lambda f, df: df.where("doc_id is null or doc_id <> 4") if f == "recipes" else df
    swapped = lambda f, df: df.withColumn("doc_id", F.when(F.col("doc_id") == 2, 3).otherwise(F.col("doc_id"))).withColumn("local", -F.col("local")) if f == "recipes" else df
    changed = lambda f, df: df.withColumn("payload", F.when(F.col("payload").isNotNull(), F.concat(F.col("payload"), F.lit(b"\0\0")))) if f == "raw" else df
    gone = lambda f, df: df.where("kind = 'recipe'") if f == "raw" else df
    for name, change in (("lost", lost), ("swapped", swapped), ("changed", changed), ("gone", gone)):
        with pytest.raises(Exception, match="don't hold|doesn't hold|doesn't have"):
            tokenstore.read_back(spark, damaged(name, change)).collect()


def test_merkle_roots_don_t_depend_on_batches():
    for n in range(40):
        leaves = [bytes([i]) * 16 for i in range(n)]
        level = leaves or [tokenstore.merkle([])]
        while len(level) > 1:
            level = [hashlib.blake2b(b"\x01" + level[i] + level[i + 1], digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        assert tokenstore.merkle(leaves) == level[0]

def test_warc_segments_and_revisits(spark, tmp_path):
    rows = [(1, "http://a", "x" * 100), (2, "http://b c", "x" * 100), (3, None, None), (4, "http://d", "é\r\n\r\n" * 9000), (5, "u", ""), (None, "n", "q")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(df, f"{tmp_path}/w", segment=1000)
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_pages(spark, f"{tmp_path}/w").collect()}
    assert got == {1: (100, "revisit", 2), 2: (100, "response", None), 3: (0, "revisit", 5), 4: (54000, "response", None), 5: (0, "response", None), None: (1, "response", None)}
    with pytest.raises(ValueError):
        warc.assemble([(1, None, b"a"), (3, 2, b"b")])
    with pytest.raises(ValueError):
        warc.assemble([(1, None, b"a"), (2, 3, b"b")])
    for data in (b"", b"a" * 20000):
        assert warc.unchunked(warc.chunked(data)) == data


def test_warc_of_repeated_pages(spark, tmp_path):
    """Equal ids with different and equal long texts, null ids, negative ids, extra columns of clashing names."""
    a, b = "a" * 50_000, "b" * 70_000
    rows = [(7, "u", a), (7, "u", b), (7, "u", b), (-3, "u", b), (None, "u", a), (None, "u", a), (None, None, None), (8, "u", "short"), (8, "u", "short"), (2, "u", "short")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, sha string, holder int").repartition(3)
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in warc.archive(df).collect()), key=str)
    want = [(7, 50000, "response", 0), (7, 70000, "response", 0), (7, 70000, "response", 0), (-3, 70000, "revisit", 7), (0, 50000, "response", 0), (0, 50000, "response", 0), (0, 0, "response", 0), (8, 5, "response", 0), (8, 5, "response", 0), (2, 5, "revisit", 8)]
    assert got == sorted(want, key=str)
    path = f"{tmp_path}/w"
    warc.write_archives(df, path)
    names = [r["name"] for r in warc.read_records(spark, path).collect()]
    assert len(names) == len(set(names))
    assert warc.archive(df.limit(0)).count() == 0


def test_packing_is_whole_and_gapless(spark, docs):
    rows = packing.best_fit(docs, WORDS, 1).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows) and {r["doc_id"] for r in rows} == {None, *range(len(TEXTS))}


def test_packed_pieces_are_the_library_s_ids(spark, docs):
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in packing.best_fit(docs.where("doc_id is not null"), WORDS, 1).collect()}
    want = {}
    for i, t in enumerate(TEXTS):
        ids = np.array(WordBpe.get(WORDS).tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for p, at in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = ids[at : at + packing.CAPACITY]
            want[i, p] = (at, len(part), zlib.crc32(part.tobytes()))
    assert got == want


def fewest(items, capacity):
    """The least number of bins, by trying every place for every item."""
    best = len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in {v: k for k, v in enumerate(bins) if v + items[i] <= capacity}.values():
            bins[k] += items[i]
            place(i + 1, bins)
            bins[k] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best


def test_plans_are_the_best_ones():
    R, gained = random.Random(8), 0
    for _ in range(250):
        capacity = R.choice([20, 30, 50, 100])
        items = sorted((R.randint(capacity // 6, capacity * 2 // 3) for _ in range(R.randint(3, 11))), reverse=True)
        plan = packing.plan(collections.Counter(items), capacity)
        assert sorted(x for f, t in plan for x in f * t) == sorted(items) and all(sum(f) <= capacity for f, _ in plan)
        used = sum(t for _, t in plan)
        assert used == fewest(items, capacity), (items, capacity)
        gained += used < sum(t for _, t in packing._best_fit(collections.Counter(items), capacity))
    assert gained > 0
    # the node limit leaves the incumbent
    assert packing.plan({7: 2, 6: 2, 4: 3, 3: 1}, 13, nodes=0) == packing._best_fit({7: 2, 6: 2, 4: 3, 3: 1}, 13)


def test_undominated_fillings_by_brute_force():
    """No filling that is left out can be better than one that is given: of every set of documents some given filling holds at least as much, part by part."""
    R = random.Random(3)
    for _ in range(60):
        left = dict(collections.Counter(R.randint(1, 12) for _ in range(R.randint(1, 6))))
        room = R.randint(1, 20)
        items = [s for s, n in left.items() for _ in range(n)]
        every = {tuple(sorted(c, reverse=True)) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room}
        given = [f for f, _ in packing.fillings(left, room, room)]
        assert len(given) == len(set(given)) and set(given) <= every

        def holds(big, small):  # can the documents of `small` be put into places of the sizes of `big`?
            if not small:
                return True
            return any(holds([*big[:i], big[i] - small[0], *big[i + 1 :]], small[1:]) for i in range(len(big)) if big[i] >= small[0])

        assert all(any(holds(list(g), f) for g in given) for f in every)


def test_a_table_where_the_search_beats_best_fit(spark):
    # the first random table on which best-fit needs more sequences than the lengths add up to
    lengths = next([*x] for x in ([R.randint(15, 60) for _ in range(9)] for R in map(random.Random, range(3000))) if sum(t for _, t in packing._best_fit(collections.Counter(x), 90)) > -(-sum(x) // 90) == fewest(sorted(x, reverse=True), 90))
    rows = common.staged(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long").repartition(3), "test")
    got = packing.pack(rows, 90).collect()
    assert len({r["sequence_id"] for r in got}) == -(-sum(lengths) // 90) and sorted(r["doc_id"] for r in got) == list(range(len(lengths)))
    ends = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == sum(ends[r["sequence_id"]])
        ends[r["sequence_id"]].append(r["length"])
    assert max(map(sum, ends.values())) <= 90


def test_pieces_as_the_library_has_them():
    bpe = spiece.PieceBpe.get(tokenizer_path("piece_bpe_32k.model"))
    texts = random_texts(3000, "aBeth  \n.é中▁🙂ing==\t", 2) + ["", " ", "a" * 50]
    assert bpe.encode(texts) == [np.array(x, "<u4").tobytes() for x in bpe.library.encode(texts, add_bos=True, add_eos=True)]


def test_decoded_text_as_the_library_has_it(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    texts = [t or "" for t in TEXTS] + random_texts(200, "aBeth  \n.é中▁🙂ing==\t", 5)
    library = spiece.PieceBpe.get(path).library
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in spiece.digests(df, path).collect():
        ids = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_license_places_by_brute_force(spark):
    R = random.Random(6)
    vocabulary = "under the mit license apache version 2 cc by nc x".split()
    texts = [R.choice([" ", ", ", "\n"]).join(R.choice([str.upper, str])(R.choice(vocabulary)) for _ in range(R.randint(0, 60))) for _ in range(300)] + ["Under the MIT License", "K cc-by-nc 4.0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(df).collect():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]])
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = sorted((i, x) for p, x in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(sorted({x for _, x in hits})))


def test_templates_with_one_word_replaced(spark):
    want = []
    for words, label, _ in licenses.templates():
        for at in range(len(words)):
            hits = [p for p in range(len(words) - licenses.K + 1) if not p <= at < p + licenses.K]
            covered = {q for p in hits for q in range(p, p + licenses.K)}
            text = [*words[:at], "zzz", *words[at + 1 :]]
            if 100 * len(covered) >= licenses.COVERED * len(words):
                want.append((" ".join(["aaa", "bbb", *text, "ccc"]), label, 2 + min(covered), 3 + max(covered), len(covered) / len(words)))
            else:
                assert len(words) < 12
    df = spark.createDataFrame([(i, w[0]) for i, w in enumerate(want)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    for i, (text, label, start, end, share) in enumerate(want):
        assert got[i]["labels"] == label, text
        assert f"{label}:{start}:{end}" in got[i]["spans"].split(","), text
        assert got[i]["score"] >= round(share, 6), text


def test_whole_templates_have_their_label_only(spark):
    texts = [(" ".join(words), label) for words, label, _ in licenses.templates()]
    df = spark.createDataFrame([(i, f"x {t} y {t.upper()}") for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    for r in licenses.scan(df).collect():
        assert r["labels"] == texts[r["doc_id"]][1] and r["score"] == 1


def test_labels_and_spans_against_sql(spark):
    import duckdb

    R = random.Random(9)
    pool = [words for words, _, _ in licenses.templates()]
    texts = [None, ""]
    for _ in range(250):
        words = []
        for _ in range(R.randint(1, 5)):
            part = list(R.choice(pool))
            for _ in range(R.randint(0, 4)):
                at = R.randrange(len(part))
                part[at : at + R.randint(0, 2)] = R.choices(["zz", "the", "license"], k=R.randint(0, 3))
                part = part or ["x"]
            words += part[R.randint(0, 2) :]
        texts.append(R.choice([" ", ", "]).join(R.choice([w, w.upper()]) for w in words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = duckdb.connect()
    base.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    base.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    found = base.execute(queries.oracle_sql()["op9_licenses"])
    columns = [c[0] for c in found.description]
    want = sorted(found.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in licenses.scan(df).collect()) == want
    assert len({r[columns.index("labels")] for r in want}) > 20


@pytest.mark.parametrize("size", [4, neardup.SIZE])
def test_near_duplicates_by_brute_force(spark, size):
    R = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], [R.choices(vocabulary, k=60) for _ in range(20)]
    for i in range(240):
        w = list(base[i % 20])
        for _ in range(R.randint(0, 6)):
            w[R.randrange(60)] = R.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(240, "a b"), (241, "A  b"), (242, ""), (243, None), (244, None)]
    sets = {i: {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()) for i, w in ((i, (t or "").lower().split()) for i, t in rows)}
    comp = {i: i for i in sets}
    for _ in range(10):
        for a in sets:
            for b in sets:
                if sets[a] and a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=size).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), comp[i]) for i in sets}


def edited(words, places, mark):
    return [f"{mark}x{i}" if i in places else w for i, w in enumerate(words)]


def test_links_of_a_hub_with_thousands_of_copies(spark, monkeypatch):
    """Each copy is at the threshold to its base and far below it to the others: its only link is the one to the base. Some have a copy of their own."""
    monkeypatch.setattr(neardup, "BLOCK_SETS", 300)  # regions are dealt out as blocks
    R = random.Random(11)
    base = [f"w{i}" for i in range(184)]  # 180 shingles of five words: four replaced words leave 160 of 200
    rows = [(0, " ".join(base))]
    for k in range(1, 2501):
        places = [R.randrange(a, a + 35) for a in (5, 50, 95, 140)]
        copy = edited(base, places, f"c{k}")
        rows.append((k, " ".join(copy)))
        if k % 10 == 0:
            own = [(p + 20 if p + 20 < 180 else p - 20) for p in places]
            rows.append((10_000 + k, " ".join(edited(copy, own, f"d{k}"))))
    rows.append((20_000, " ".join(f"v{i}" for i in range(184))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = collections.Counter(r["component_id"] for r in neardup.near_duplicates(df).collect())
    assert got == {0: len(rows) - 1, 20_000: 1}


def test_regions_however_the_rows_are_dealt():
    """Rows that share the first components of a tree's order, by brute force, whatever the batches."""
    import pyarrow as pa

    R = random.Random(2)
    for _ in range(200):
        rows = sorted((R.randint(0, 1), R.randint(0, 2), R.randint(0, 2), R.randint(0, 3), 0, i) for i in range(R.randint(1, 12)))
        cuts = sorted(R.choices(range(len(rows) + 1), k=3))
        got = []
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in p], pa.int32() if i == 0 else pa.int64()) for i in range(6)], names=["tree", "p1", "p2", "p3", "p4", "rep"]) for p in parts]
        for b in neardup._regions(iter(batches)):
            got += list(zip(b.column("rep").to_pylist(), b.column("open").to_pylist(), b.column("region").to_pylist()))
        count = collections.Counter(r[:3] for r in rows)
        ends = {rows[0][5], rows[-1][5]}
        assert {(r, o) for r, o, _ in got} == {(r[5], count[r[:3]] == 1) for r in rows if count[r[:3]] > 1 or r[5] in ends} and len(got) == len({r for r, _, _ in got})
        names = {r: n for r, _, n in got}
        assert all((names[a[5]] == names[b[5]]) == (a[:3] == b[:3]) for a in rows for b in rows if a[5] in names and b[5] in names)


def test_crowded_regions_by_brute_force(spark, monkeypatch):
    """Over 256 near copies of each of two texts, in a table where most sets of a region aren't linked: every link counts."""
    monkeypatch.setattr(neardup, "BLOCK_SETS", 100)
    R, rows = random.Random(21), []
    for g in range(2):
        base = [f"g{g}w{i}" for i in range(64)]
        for _ in range(400):
            w = list(base)
            for at in R.sample(range(64), R.randint(0, 4)):
                w[at] = f"r{R.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    comp = list(range(len(rows)))

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            comp[y] = x
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) for i in range(len(rows))}
    assert len({find(i) for i in range(len(rows))}) > 20


def test_joins_of_heavy_keys_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_ROWS", 20)
    rows = [(0 if i % 3 == 0 else None if i % 7 == 0 else i % 40, i % 5) for i in range(3000)] + [(77, 1)] * 200  # equal rows too
    many = spark.createDataFrame(rows, "k long, v int").repartition(5)
    one = spark.createDataFrame([(i, i * 10) for i in range(30)] + [(77, 770), (None, -1)], "k long, w int")
    heavy = common.heavy_keys(many, "k")
    assert max(n for _, n in heavy) > 30
    for given in (None, heavy, common.Heavy()):
        for how in ("inner", "left"):
            got = collections.Counter(tuple(r) for r in common.skew_join(many, one, "k", how, given).select("k", "v", "w").collect())
            assert got == collections.Counter(tuple(r) for r in many.join(one, "k", how).select("k", "v", "w").collect())
    spread = common.skew_join(many, one, "k", heavy=heavy).where("k = 77").count()
    assert spread == 200
    assert dict(heavy.with_more(common.Heavy([(-1, 5), (heavy[0][0], 1)]))) == dict(heavy) | {-1: 5}


def test_the_filter_never_loses_a_key(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BITS", 1 << 10)
    for kind in ("int", "string"):
        df = spark.range(2000).select(F.col("id").cast(kind).alias("k")).unionByName(spark.createDataFrame([(None,)], f"k {kind}"))
        ids = spark.range(0, 2000, 50).select(F.col("id").alias("x"))
        got = {r["k"]: r["__possible"] for r in common.with_possible(df, "k", ids).collect()}
        assert len(got) == 2001 and all(v for k, v in got.items() if k is not None and int(k) % 50 == 0)
        assert sum(got.values()) < 300


def test_staged_tables_go_when_a_result_stands(spark, monkeypatch):
    gone = []
    monkeypatch.setattr(common, "removed", lambda s, p, f=common.removed: (gone.append(p), f(s, p)))
    df = spark.range(10)
    out = common.settled(spark, "out", lambda: common.staged(common.staged(df, "a"), "b"))
    assert out.count() == 10 and len(gone) == 2


def test_repeated_ids_are_one_document(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, "other words stand in this one")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert sorted(r["doc_id"] for r in neardup.keep_documents(df).collect()) == [1, 4]


def test_blocks_of_large_regions():
    R = np.random.RandomState(2)
    base = R.randint(0, 2**60, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 100 - i % 4], R.randint(0, 2**60, i % 4).astype(np.uint64)])) for i in range(30)] + [np.unique(R.randint(0, 2**60, 50).astype(np.uint64))]
    links = neardup.local_links(list(range(31)), sets, 0)
    assert len(links) == 29 and all(30 not in x for x in links)
    assert len(neardup.local_links(list(range(31)), sets, 10)) <= 30


def test_pipeline_end_to_end(spark, tmp_path):
    import corpus_pipeline

    R = random.Random(1)
    words = ["".join(R.choice("aeioulmnrst") for _ in range(6)) for _ in range(500)]
    clean = [(i, " ".join(R.choices(words, k=80)) + (" from 10.1.2.3 or +1 (212) 555-1234" if i % 9 == 0 else "")) for i in range(40)]
    rows = [*clean, (40, clean[0][1]), (41, "too short"), (42, clean[1][1] + " mail me at bob.smith@mail.example.com"), *[(50 + i, " ".join(R.choices(words, k=40)) + " you idiot moron") for i in range(20)]]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 50)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # copies, the short one and toxic ones are gone; of the rest every piece is the library's ids of the redacted text
    want = set()
    for i, t in clean:
        ids = np.array(WordBpe.get(WORDS).tokenizer.encode(pii.redact(t, pii.all_spans(t, pii.model())), add_special_tokens=False).ids + [1], "<u4")
        want.add((i, 0, 0, len(ids), zlib.crc32(ids.tobytes())))
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == sum(by[r["sequence_id"]])
        by[r["sequence_id"]].append(r["length"])
    assert len(by) == -(-sum(w[3] for w in want) // packing.CAPACITY)


def test_digests_are_of_the_text(spark, docs):
    for r in media.media_columns(docs).where("doc_id is not null").collect():
        n, payload = media.payload_of(TEXTS[r["doc_id"]] or "")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
