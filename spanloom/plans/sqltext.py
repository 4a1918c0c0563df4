"""Builds the SQL that says the same as the engine's plans, for a database without this package."""

from __future__ import annotations

from spanloom.functions import dictionaries as D

#: Clinical notes made from customers; the same text in Spark SQL and elsewhere.
NOTES = """SELECT CAST(c_custkey AS BIGINT) AS doc_id,
  'Patient ' || s1 || (CASE WHEN c_custkey % 3 = 0 THEN ' with ' ELSE ' S/O ' END) || s2
  || ' seen in cardiology ward. Age: ' || CAST(20 + c_custkey % 80 AS STRING)
  || '. MRN: ' || lpad(CAST(c_custkey AS STRING), 8, '0')
  || '. SSN ' || CAST(100 + c_custkey % 900 AS STRING) || '-' || CAST(10 + c_custkey % 90 AS STRING) || '-' || CAST(1000 + c_custkey % 9000 AS STRING)
  || '. PAN: ABCDE' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') || 'F'
  || '. Aadhaar: 1234 5678 ' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')
  || '. Diagnosed with ' || dx || (CASE WHEN c_custkey % 11 = 0 THEN '_x' ELSE '' END) || '; prescribed ' || rx || ' after MRI'
  || '. Device AB-' || lpad(CAST(c_custkey AS STRING), 7, '0')
  || '. Phone: +91' || CAST(9000000000 + c_custkey AS STRING)
  || '. Sex: ' || (CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END)
  || '. Email p' || CAST(c_custkey AS STRING) || '@mail' || CAST(c_custkey % 7 AS STRING) || '.example'
  || '. Host 10.0.' || CAST(c_custkey % 256 AS STRING) || '.' || CAST(c_custkey % 200 AS STRING) || '.' AS text
FROM (SELECT c_custkey,
  CASE c_custkey % 4 WHEN 0 THEN 'Sharma' WHEN 1 THEN 'Rao' WHEN 2 THEN 'Patel' ELSE 'Das' END AS s1,
  CASE c_custkey % 5 WHEN 0 THEN 'Kumar' WHEN 1 THEN 'Gupta' WHEN 2 THEN 'Iyer' WHEN 3 THEN 'Nair' ELSE 'Sen' END AS s2,
  CASE c_custkey % 4 WHEN 0 THEN 'type 2 diabetes' WHEN 1 THEN 'hypertension' WHEN 2 THEN 'asthma' ELSE 'heart failure' END AS dx,
  CASE c_custkey % 3 WHEN 0 THEN 'metformin' WHEN 1 THEN 'aspirin' ELSE 'insulin' END AS rx
  FROM {customer}) t"""

#: Administrative forms made from customers: numbers with and without right checksums, addresses, names of firms and groups.
FORMS = """SELECT CAST(c_custkey AS BIGINT) AS doc_id,
  'IBAN GB' || lpad(CAST(2 + c_custkey % 97 AS STRING), 2, '0') || 'WEST' || lpad(CAST(c_custkey % 50 AS STRING), 14, '7')
  || '. NHS number ' || CAST(943 + c_custkey % 7 AS STRING) || ' ' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '4') || ' ' || CAST(1000 + c_custkey % 9000 AS STRING)
  || '. DEA A' || (CASE WHEN c_custkey % 2 = 0 THEN 'B' ELSE '9' END) || lpad(CAST(1234560 + c_custkey % 1000 AS STRING), 7, '0')
  || '. Gateway 2001:db8::' || CAST(c_custkey % 10000 AS STRING) || ' or fe80:0:0:0:1:2:3:' || CAST(c_custkey % 100 AS STRING)
  || '. Lives at ' || CAST(1 + c_custkey % 300 AS STRING) || (CASE WHEN c_custkey % 3 = 0 THEN ' Mahatma Gandhi Road' ELSE ' Church Street' END)
  || '; insured by ' || (CASE WHEN c_custkey % 4 = 0 THEN 'Star Health Insurance' WHEN c_custkey % 4 = 1 THEN 'Acme Widgets Ltd' ELSE 'nobody' END)
  || ', an ' || (CASE WHEN c_custkey % 5 = 0 THEN 'Indian' WHEN c_custkey % 5 = 1 THEN 'Italian' ELSE 'unknown' END) || ' national. Account '
  || lpad(CAST(c_custkey AS STRING), 10, '5') || ', driver license D' || lpad(CAST(c_custkey AS STRING), 7, '1') || ', passport ' || lpad(CAST(c_custkey AS STRING), 9, '3') || '. Call +1 (212) 555-' || CAST(1000 + c_custkey % 9000 AS STRING) || '.' AS text
FROM {customer}"""

NOTES_SQL = NOTES.replace("{customer}", "customer")
FORMS_SQL = FORMS.replace("{customer}", "customer")
DOCS_SQL = "SELECT doc_id, text FROM documents"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Letters and digits beyond ASCII, which RE2's word border doesn't know as such.
_FOREIGN = r"[\x{AA}\x{B2}\x{B3}\x{B5}\x{B9}\x{BA}\x{BC}-\x{BE}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2C1}\x{300}-\x{1FFF}\x{2C00}-\x{2DFF}\x{3041}-\x{D7FF}\x{F900}-\x{FDFF}]"


def spans(docs: str, regex: str) -> str:
    """doc_id, start, "end", text of a pattern's matches in a query (doc_id, text). They are looked for where an underscore, a word's character too,
    stands for each foreign letter."""
    r = quoted(regex)
    size = "list_transform({}, lambda x: length(x))"
    start = f"(coalesce(list_sum({size.format('g[1:i]')}), 0) + coalesce(list_sum({size.format('m[1:i - 1]')}), 0))::BIGINT"
    plain = f"SELECT doc_id, text, regexp_replace(text, {quoted(_FOREIGN)}, '_', 'g') AS plain FROM ({docs})"
    inner = f"SELECT doc_id, text, regexp_extract_all(plain, {r}) AS m, string_split_regex(plain, {r}) AS g FROM ({plain})"
    return f"SELECT doc_id, start, (start + n)::BIGINT AS \"end\", substr(text, start + 1, n) AS text FROM (SELECT doc_id, text, {start} AS start, length(m[i]) AS n FROM (SELECT doc_id, text, m, g, unnest(range(1, len(m) + 1)) AS i FROM ({inner})))"


_COLUMNS = 'doc_id, start, "end", entity_type, score, detected_by, text, pattern_name'


def recognized(docs: str, patterns: list[D.Pattern]) -> str:
    each = [f"SELECT doc_id, start, \"end\", '{p.entity}' AS entity_type, {p.score}::DOUBLE AS score, 'presidio' AS detected_by, text, '{p.name}' AS pattern_name FROM ({spans(docs, p.regex)})" for p in patterns]
    return " UNION ALL ".join(each)


_DIGITS = "regexp_replace(text, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({_DIGITS})[i]::INT ELSE (2 * reverse({_DIGITS})[i]::INT) // 10 + (2 * reverse({_DIGITS})[i]::INT) % 10 END)) % 10 = 0"
_TURNED = "(substr(text, 5) || substr(text, 1, 4))"
_CODES = f"array_to_string(list_transform(range(1, length({_TURNED}) + 1), lambda i: CASE WHEN {_TURNED}[i] BETWEEN '0' AND '9' THEN {_TURNED}[i] ELSE (ascii({_TURNED}[i]) - 55)::VARCHAR END), '')"
_MOD97 = f"list_reduce(list_transform(range(1, length({_CODES}) + 1), lambda i: {_CODES}[i]::BIGINT), lambda a, c: (a * 10 + c) % 97) = 1"
_MOD11 = f"(11 - list_sum(list_transform(range(1, 10), lambda i: (11 - i) * {_DIGITS}[i]::INT)) % 11) % 11 = {_DIGITS}[10]::INT"
_DEA = " + ".join(f"{n} * substr(text, {i}, 1)::INT" for i, n in zip(range(3, 9), [1, 2] * 3))
_CHECKS = {
    None: "true", "octets": "len(list_filter(string_split(text, '.'), lambda x: x::INT > 255)) = 0", "luhn": _LUHN, "nine": f"length({_DIGITS}) BETWEEN 9 AND 15", "mod97": _MOD97, "mod11": _MOD11,
    "groups": "CASE WHEN contains(text, '::') THEN len(list_filter(string_split(text, ':'), lambda x: x <> '')) <= 7 ELSE len(list_filter(string_split(text, ':'), lambda x: x <> '')) = 8 END",
    "dea": f"({_DEA}) % 10 = substr(text, 9, 1)::INT",
}


def general(docs: str, names: list[str]) -> str:
    out = []
    for n in names:
        p, check = D.GENERAL[n]
        out.append(f"SELECT {_COLUMNS} FROM ({recognized(docs, [p])}) WHERE {_CHECKS[check]}")
    return " UNION ALL ".join(out)


def swept(docs: str) -> str:
    terms = ", ".join(f"({quoted(t)}, '{entity}', {score}::DOUBLE)" for ts, entity, score in D.GAZETTEERS for t in ts)
    return f"""SELECT doc_id, start::BIGINT AS start, (start + length(term))::BIGINT AS "end", entity_type, score, 'openbioner' AS detected_by, substr(text, start + 1, length(term)) AS text, 'gazetteer' AS pattern_name
FROM (SELECT *, (coalesce(list_sum(list_transform(parts[1:i], lambda x: length(x))), 0) + (i - 1) * length(term))::BIGINT AS start
  FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM (
    SELECT doc_id, text, term, entity_type, score, string_split(lower(text), term) AS parts
    FROM ({docs}) d, (VALUES {terms}) v(term, entity_type, score) WHERE contains(lower(text), term))))
WHERE NOT regexp_matches(lower(substr(text, greatest(start, 1)::BIGINT, CASE WHEN start > 0 THEN 1 ELSE 0 END)), '[\\pL\\pN]') AND NOT regexp_matches(lower(substr(text, (start + length(term) + 1)::BIGINT, 1)), '[\\pL\\pN]')"""


def in_context(found: str, docs: str) -> str:
    """Scores raised by words or phrases of a recognizer among the five words before its match."""
    known = ", ".join(f"({quoted(p.name)}, {quoted(p.context)})" for p in [*D.PATTERNS, *(p for p, _ in D.GENERAL.values())])
    words = "list_reverse(list_reverse(regexp_extract_all(lower(substr(d.text, 1, f.start)), '[a-z0-9/#]+'))[1:5])"
    near = f"len(list_filter(string_split(w.phrases, ','), lambda p: p <> '' AND contains(' ' || array_to_string({words}, ' ') || ' ', ' ' || p || ' '))) > 0"
    score = f"CASE WHEN {near} THEN greatest({D.CONTEXT_FLOOR}::DOUBLE, least(1.0::DOUBLE, f.score + {D.CONTEXT_BOOST}::DOUBLE)) ELSE f.score END"
    return f"""SELECT f.doc_id, f.start, f."end", f.entity_type, {score} AS score, f.detected_by, f.text, f.pattern_name
FROM ({found}) f JOIN ({docs}) d ON d.doc_id = f.doc_id JOIN (VALUES {known}) w(pattern_name, phrases) ON w.pattern_name = f.pattern_name"""


def without_contained(found: str) -> str:
    return f"""WITH c AS MATERIALIZED ({found}) SELECT x.* FROM c x WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.doc_id = x.doc_id AND o.entity_type = x.entity_type AND o.start <= x.start AND o."end" >= x."end"
  AND (o.score > x.score OR o.score = x.score AND (o."end" - o.start > x."end" - x.start OR o.pattern_name < x.pattern_name)))"""


def analyzed(docs: str) -> str:
    """What the first source finds."""
    found = f"SELECT {_COLUMNS} FROM ({recognized(docs, D.PATTERNS)}) UNION ALL SELECT {_COLUMNS} FROM ({general(docs, list(D.GENERAL))})"
    return without_contained(f"SELECT * FROM ({in_context(found, docs)}) WHERE score >= {D.SCORE_THRESHOLD}")


def trimmed(found: str) -> str:
    """Spans that run over a line's end keep their first line."""
    line = "rtrim(split_part(text, chr(10), 1))"
    return f"""SELECT doc_id, start, (start + length(t))::BIGINT AS "end", entity_type, score, detected_by, t AS text, pattern_name
FROM (SELECT *, CASE WHEN contains(text, chr(10)) AND {line} <> '' THEN {line} ELSE text END AS t FROM ({found}))"""


def merged(found: str) -> str:
    """The fold over spans in order: doc_id and the same columns, disjoint spans."""
    med = ", ".join(quoted(t) for t in D.MEDICAL_TYPES)
    x, y = "w[1]", "acc[len(acc)]"
    takes = f"""CASE WHEN {x}.t IN ({med}) AND {y}.t NOT IN ({med}) THEN true WHEN {y}.t IN ({med}) AND {x}.t NOT IN ({med}) THEN false
      WHEN {x}.t = {y}.t AND {x}.e - {x}.s > {y}.e - {y}.s THEN true WHEN {x}.t = {y}.t AND {x}.e - {x}.s < {y}.e - {y}.s THEN false ELSE {x}.p > {y}.p END"""
    best = f"CASE WHEN {x}.t = {y}.t AND {x}.e - {x}.s <> {y}.e - {y}.s THEN greatest({x}.p, {y}.p) WHEN {takes} THEN {x}.p ELSE {y}.p END"
    pick = lambda f: f"CASE WHEN {takes} THEN {x}.{f} ELSE {y}.{f} END"
    winner = f"{{'s': {pick('s')}, 'e': {pick('e')}, 't': {pick('t')}, 'p': {best}, 'b': CASE WHEN {x}.b <> {y}.b THEN 'ensemble' ELSE {pick('b')} END, 'c': {pick('c')}, 'n': {pick('n')}}}"
    return f"""SELECT doc_id, u.s AS start, u.e AS "end", u.t AS entity_type, u.p AS score, u.b AS detected_by, u.c AS text, u.n AS pattern_name FROM (
  SELECT doc_id, unnest(list_reduce(list_transform(l, lambda z: [z]), lambda acc, w: CASE WHEN {x}.s >= {y}.e OR {x}.e <= {y}.s THEN list_concat(acc, w) ELSE list_concat(acc[1:len(acc) - 1], [{winner}]) END)) AS u
  FROM (SELECT doc_id, list({{'s': start, 'e': "end", 't': entity_type, 'p': score, 'b': detected_by, 'c': text, 'n': pattern_name}} ORDER BY start, -score, detected_by <> 'presidio', entity_type, "end", pattern_name) AS l
    FROM ({found}) GROUP BY doc_id))"""


def word_number(text: str, position: str) -> str:
    return f"greatest(0, len(regexp_extract_all(substr({text}, 1, ({position} + 1)::BIGINT), '\\S+')) - 1)"


def boosted(found: str, docs: str) -> str:
    keys = f"SELECT s.doc_id, list({word_number('d.text', 's.start')}) AS k FROM ({spans(docs, D.KINSHIP)}) s JOIN ({docs}) d USING (doc_id) GROUP BY s.doc_id"
    near = f"f.entity_type = 'PERSON' AND k.k IS NOT NULL AND len(list_filter(k.k, lambda q: abs(q - {word_number('d.text', 'f.start')}) <= {D.KINSHIP_WORDS})) > 0"
    return f"""SELECT f.doc_id, f.start, f."end", f.entity_type, CASE WHEN {near} THEN least(1.0::DOUBLE, f.score + {D.KINSHIP_BOOST}::DOUBLE) ELSE f.score END AS score, CASE WHEN {near} THEN 'ensemble' ELSE f.detected_by END AS detected_by, f.text, f.pattern_name
FROM ({found}) f JOIN ({docs}) d ON d.doc_id = f.doc_id LEFT JOIN ({keys}) k ON k.doc_id = f.doc_id"""


def shielded(found: str) -> str:
    med = ", ".join(quoted(t) for t in D.MEDICAL_TYPES)
    return f"""SELECT f.* FROM ({found}) f WHERE f.entity_type IN ({med}) OR NOT EXISTS (SELECT 1 FROM ({found}) m WHERE m.doc_id = f.doc_id AND m.entity_type IN ({med}) AND f.start < m."end" AND f."end" > m.start)"""


def tokens(docs: str) -> str:
    """doc_id, token_no, token, before (the token before it), start of texts whose white space is single blanks."""
    at = "coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x) + 1)), 0)::BIGINT"
    return f"SELECT doc_id, (i - 1)::BIGINT AS token_no, w[i] AS token, CASE WHEN i > 1 THEN w[i - 1] END AS before, {at} AS start FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM ({docs})))"


def decoded(predictions: str) -> str:
    """Entities of word labels (doc_id, pos, char_start, char_end, label, score)."""
    stems = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in D.STEM_ENTITIES.items())
    return f"""SELECT doc_id, start, "end", coalesce(entity, 'DEVICE_ID') AS entity_type, score FROM (
  WITH a AS (SELECT *, label <> 'O' AS inside, substr(label, 3) AS stem, sum(CASE WHEN label = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS seg FROM ({predictions})),
  b AS (SELECT *, max(CASE WHEN label LIKE 'B-%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, seg ORDER BY pos) AS opened FROM a),
  c AS (SELECT *, CASE WHEN label LIKE 'B-%' OR stem IS DISTINCT FROM lag(stem) OVER (PARTITION BY doc_id, seg ORDER BY pos) THEN 1 ELSE 0 END AS fresh FROM b WHERE inside AND opened = 1),
  e AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, seg ORDER BY pos) AS ent FROM c)
  SELECT doc_id, min(char_start)::BIGINT AS start, max(char_end)::BIGINT AS "end", any_value(stem) AS stem, round(avg(score), 4) AS score FROM e GROUP BY doc_id, seg, ent) LEFT JOIN (VALUES {stems}) v(stem, entity) USING (stem)"""


def custom(predictions: str, docs: str) -> str:
    """Detections of the token classifier's engine."""
    return classified(f"""SELECT d.doc_id, p.start, p."end", p.entity_type, p.score, 'custom_biobert' AS detected_by, substr(d.text, p.start + 1, p."end" - p.start) AS text, 'bio' AS pattern_name
FROM ({decoded(predictions)}) p JOIN ({docs}) d ON d.doc_id = p.doc_id""")


def classified(found: str) -> str:
    keep = ", ".join(quoted(t) for t in D.KEEP_TYPES)
    high = f"len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda n: n::HUGEINT > {D.AGE_LIMIT})) > 0"
    return f"SELECT *, CASE WHEN entity_type = 'AGE' AND {high} THEN 'AGE_AGGREGATED' WHEN entity_type IN ({keep}) THEN 'KEPT' ELSE 'MASKED' END AS action FROM ({found})"


def both_sources(docs: str) -> str:
    return f"SELECT {_COLUMNS} FROM ({analyzed(docs)}) UNION ALL SELECT {_COLUMNS} FROM ({swept(docs)})"


def detections(docs: str, found: str | None = None) -> str:
    """The standard engine, or everything after recognition. Merged spans are disjoint, so nothing is left for the shield to drop."""
    return classified(boosted(merged(trimmed(found or both_sources(docs))), docs))


NOTES_FOUND = f"SELECT {_COLUMNS} FROM ({recognized(NOTES_SQL, D.PATTERNS)}) UNION ALL SELECT {_COLUMNS} FROM ({swept(NOTES_SQL)})"
NOTES_DETECTIONS = detections(NOTES_SQL)
FORMS_DETECTIONS = detections(FORMS_SQL)
DOCS_DETECTIONS = detections(DOCS_SQL)


def audits(docs: str, found: str, threshold: float = D.SAFETY_THRESHOLD, more: str = "") -> str:
    mean = "coalesce(avg(score) FILTER (WHERE action = 'MASKED'), 1.0)"
    masked = "count(*) FILTER (WHERE action = 'MASKED')"
    return f"""SELECT d.doc_id, count(f.doc_id)::BIGINT AS total_entities_detected, ({masked})::BIGINT AS total_entities_masked, (count(f.doc_id) - {masked})::BIGINT AS total_entities_kept,
  round({mean}, 4)::DOUBLE AS ensemble_mean_confidence, CASE WHEN {mean} >= {threshold} THEN 'UNLOCKED' ELSE 'LOCKED' END AS safety_status{more.replace('{mean}', mean)}
FROM ({docs}) d LEFT JOIN ({found}) f ON f.doc_id = d.doc_id GROUP BY d.doc_id"""
