"""The operators' registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import licenses, media, neardup, packing, pii, quality, spiece, tokenstore, toxicity, warc
from spanloom.llm.common import table

END_OF_TEXT_STORE, END_OF_TEXT_PACK = 2, 1

#: Words of a shingle in op10_neardup's contract; the operator itself and the pipeline take neardup.SIZE.
SHINGLE_WORDS = 4


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, toxicity.table_labels(table(spark, sf_dir, "labels"))))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    rows = quality.apply_policy(rows, quality.BASE, "base_kept")
    rows = quality.apply_policy(rows, quality.POLICIES["v1"])
    return rows.selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "not base_kept as base_failed", "kept", "failed")


def op5_tokenstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.store(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), END_OF_TEXT_STORE)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), END_OF_TEXT_PACK)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiece.digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=SHINGLE_WORDS)


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_media, op3_pii, op4_quality, op5_tokenstore, op6_warc, op7_packing, op8_sentencepiece, op9_licenses, op10_neardup)}


_OP4 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM g) WHERE c > 1),
q AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM r) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(q.n, 0)::BIGINT AS n_repeat_words,
         len(l)::BIGINT AS n_lines, (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaims,
         (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals
  FROM d LEFT JOIN q USING (doc_id)),
f AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words AND n_symbols >= 5 THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 2 * n_exclaims > n_words OR 2 * n_capitals > word_chars THEN 16 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 25 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""

_OP6 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
b AS (
  SELECT page_id, x, strlen(h)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY x) AS holder,
    array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', x[i])]), '') AS bits
  FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT]), '') AS payload_digest,
  CASE WHEN holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN holder = page_id THEN NULL ELSE holder END AS refers_to
FROM b
"""

def _op9() -> str:
    """Diagonal voting in SQL: hits by a join of k-grams, diagonals merged by a running sum, overlaps settled by NOT EXISTS."""
    rows = ", ".join(f"({i}, '{' '.join(words)}', '{label}', {str(base).lower()})" for i, (words, label, base) in enumerate(licenses.templates()))
    k = licenses.K
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT template, string_split(words, ' ') AS tw, label, base, len(string_split(words, ' ')) AS n FROM (VALUES {rows}) v(template, words, label, base)),
tg AS (SELECT template, p - 1 AS p, array_to_string(tw[p:p + {k - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, n - {k - 2})) AS p FROM t)),
dg AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + {k - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM d WHERE len(w) >= {k})),
v AS (SELECT doc_id, template, pos - p AS diagonal, list(p ORDER BY p) AS met FROM dg JOIN tg USING (g) GROUP BY ALL),
b AS (SELECT doc_id, label, diagonal, diagonal + n AS past FROM v JOIN t USING (template) WHERE base AND len(met) = n - {k - 1}),
m AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS line FROM (
    SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {licenses.NEAR} THEN 0 ELSE 1 END AS fresh FROM v)),
g AS (
  SELECT doc_id, template, label, n, covered, start, past FROM (
    SELECT doc_id, template, line, len(list_distinct(flatten(list(flatten(list_transform(met, lambda p: range(p, p + {k}))))))) AS covered, min(diagonal + met[1]) AS start, max(diagonal + met[-1] + {k}) AS past
    FROM m GROUP BY ALL) JOIN t USING (template)),
f AS (SELECT * FROM g WHERE 100 * covered >= {licenses.COVERED} * n AND 100 * (past - start) <= {licenses.STRETCH} * n),
x AS (
  SELECT * FROM f WHERE NOT EXISTS (
    SELECT 1 FROM f o WHERE o.doc_id = f.doc_id AND o.template <> f.template AND (o.covered > f.covered OR o.covered = f.covered AND o.template < f.template) AND o.start < f.past AND f.start < o.past)),
s AS (SELECT doc_id, string_agg(label || ':' || start || ':' || past, ',' ORDER BY start, past, label) AS spans, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, start, past, label FROM x UNION SELECT doc_id, diagonal, past, label FROM b) GROUP BY doc_id),
bb AS (SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
gg AS (SELECT doc_id, max(covered::DOUBLE / n) AS score FROM g GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, round(coalesce(score, 0), 6)::DOUBLE AS score, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN bb USING (doc_id) LEFT JOIN gg USING (doc_id)
"""


_OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] ELSE range(1, greatest(len(w) - 3, 1) + 1) END) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
l AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM l JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.c + nb.c - k)),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_quality": _OP4, "op6_warc": _OP6, "op9_licenses": _op9(), "op10_neardup": _OP10}
