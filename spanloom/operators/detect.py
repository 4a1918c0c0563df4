"""From texts to merged, boosted and classified detections. All built-in expressions; nothing is shuffled before the audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import dictionaries as D
from spanloom.functions import text as X

#: An engine turns a table (doc_id, text) into one with `detections`; others can be added.
Detector = Callable[[DataFrame], DataFrame]
#: A model for names, places and the like: from a text column to one of arrays of SPAN (say, a pandas UDF).
Named = Callable[[Column], Column]

#: Pattern names whose general recognizers are on in the standard engine: all.
GENERAL = list(D.GENERAL)
SPAN = "struct<start:bigint,end:bigint,entity_type:string,score:double,detected_by:string,text:string,pattern_name:string>"


_NONE = f"cast(array() as array<{SPAN}>)"
_PARTS = "array<struct<p:struct<entity:string,score:double,name:string,check:string>,f:array<string>,g:array<string>>>"


def _found(text: str, p: D.Pattern, check: str | None = None) -> str:
    """SQL: a recognizer's matches and the pieces between them as an array of one, empty without a match. A cheap test of the pattern spares the rest."""
    about = f"named_struct('entity', '{p.entity}', 'score', {p.score}D, 'name', '{p.name}', 'check', '{check or ''}')"
    return f"if({text} rlike {X.literal(X.java(p.regex, p.first))}, array(named_struct('p', {about}, {X.parts_sql(text, p.regex, p.first)})), cast(array() as {_PARTS}))"


def _all(text: str, chosen: list[tuple[D.Pattern, str | None]]) -> Column:
    """The spans of several recognizers; what they need is tested once for all that need the same. Offsets and checks stand once for all of them."""
    groups: dict[str, list[str]] = {}
    for p, check in chosen:
        groups.setdefault(p.needs, []).append(_found(text, p, check))
    none = f"cast(array() as {_PARTS})"
    parts = [f"if({text} rlike {X.literal(needs)}, concat({', '.join([none, *each])}), {none})" if needs else f"concat({', '.join([none, *each])})" for needs, each in groups.items()]
    checks = sorted({check for _, check in chosen if check})
    spans = X.placed_sql("x")
    if checks:
        whens = " ".join(f"when '{c}' then {X.passes(c, 's.text')}" for c in checks)
        spans = f"filter({spans}, s -> case x.p.check {whens} else true end)"
    span = "named_struct('start', s.start, 'end', s.end, 'entity_type', x.p.entity, 'score', x.p.score, 'detected_by', 'presidio', 'text', s.text, 'pattern_name', x.p.name)"
    return F.expr(f"concat({_NONE}, flatten(transform(concat({', '.join([none, *parts])}), x -> transform({spans}, s -> {span}))))")


def recognized(text: str, patterns: list[D.Pattern] | None = None) -> Column:
    """Spans of the pattern recognizers in a text column, as an array."""
    return _all(text, [(p, None) for p in (D.PATTERNS if patterns is None else patterns)])


def general(text: str, names: list[str]) -> Column:
    """Spans of general recognizers (e-mail, IP, card, ...) that pass their check."""
    return _all(text, [D.GENERAL[n] for n in names])


def _quoted(term: str) -> str:
    return "".join("\\" + c if c in "-.+" else c for c in term)


def _whole(pattern: str) -> str:
    """A pattern between characters that are no letters or digits; an underscore is none either."""
    return rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{pattern})(?![\p{{L}}\p{{N}}])"


def swept(text: Column) -> Column:
    """Every whole occurrence of each dictionary term (nested ones too), as the second source.

    The dictionaries are one array of literals. One pattern of all terms tells texts without any; in the others only terms that the text
    contains are looked for.
    """
    sql = lambda x: "'" + x.replace("\\", "\\\\") + "'"
    terms = ", ".join(f"named_struct('term', {sql(t)}, 'regex', {sql(_whole(_quoted(t)))}, 'entity', '{entity}', 'score', {score}D)" for ts, entity, score in D.GAZETTEERS for t in ts)
    empty = F.expr(f"cast(array() as array<{SPAN}>)")

    def found(t: Column) -> Column:
        return F.transform(
            X.spans_of(text, t["regex"]),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), t["entity"].alias("entity_type"), t["score"].alias("score"), F.lit("openbioner").alias("detected_by"), s["text"].alias("text"), F.lit("gazetteer").alias("pattern_name")),
        )

    every = X.bind(F.lower(text), lambda low: F.flatten(F.transform(F.filter(F.expr(f"array({terms})"), lambda t: F.contains(low, t["term"])), found)))
    return F.when(text.rlike(D.MEDICAL), every).otherwise(empty)


#: Characters before a span in which its context words are looked for first, then second; a text whose words are longer is read from its start.
NEARBY = (80, 400)


def context_boost(spans: Column, text: Column, patterns: list[D.Pattern] | None = None) -> Column:
    """Raises the score of a span that has one of its pattern's context words or phrases among the words before it."""
    known = [*D.PATTERNS, *(p for p, _ in D.GENERAL.values())] if patterns is None else patterns
    phrases = F.create_map(*[x for p in known for x in (F.lit(p.name), F.split(F.lit(p.context), ","))])

    def words_before(s: Column) -> Column:
        at = s["start"].cast("int")
        words = lambda x: F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9/#]+"), F.lit(0))
        def out(cuts: tuple[int, ...]) -> Column:
            if not cuts:
                return words(F.substring(text, F.lit(1), at))
            few = words(F.substring(text, F.greatest(at - (cuts[0] - 1), F.lit(1)), F.least(at, F.lit(cuts[0]))))
            # the first word of a cut may be cut itself
            return X.bind(few, lambda w: F.when((at <= cuts[0]) | (F.size(w) > D.CONTEXT_WORDS), w).otherwise(out(cuts[1:])))

        return out(NEARBY)

    def boosted(s: Column) -> Column:
        near = X.bind(words_before(s), lambda w: F.concat(F.lit(" "), F.array_join(F.slice(w, F.greatest(F.size(w) - (D.CONTEXT_WORDS - 1), F.lit(1)), F.lit(D.CONTEXT_WORDS)), " "), F.lit(" ")))
        own = F.try_element_at(phrases, s["pattern_name"])
        hit = X.bind(near, lambda n: F.coalesce(F.exists(own, lambda p: (p != "") & F.contains(n, F.concat(F.lit(" "), p, F.lit(" ")))), F.lit(False)))
        return s.withField("score", F.when(hit, F.greatest(F.lit(D.CONTEXT_FLOOR), F.least(F.lit(1.0), s["score"] + D.CONTEXT_BOOST))).otherwise(s["score"]))

    return F.transform(spans, boosted)


def without_contained(spans: Column) -> Column:
    """Without spans that lie within one of the same kind that is at least as sure (of equal ones, the first by name stays).

    In order of start and falling end only earlier spans of a run that hangs together can hold a span.
    """
    key = lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), (-s["score"]).alias("c"), s["pattern_name"].alias("d"), s.alias("s"))
    ordered = F.transform(F.array_sort(F.transform(spans, key)), lambda k: k["s"])

    def alone(run: Column) -> Column:
        def held(x: Column, i: Column) -> Column:
            return F.exists(F.slice(run, F.lit(1), i), lambda o: (o["entity_type"] == x["entity_type"]) & (o["end"] >= x["end"]) & (o["score"] >= x["score"]))

        return F.filter(run, lambda x, i: ~held(x, i))

    return X.bind(ordered, lambda o: F.when(F.size(o) <= X.BLOCK, alone(o)).otherwise(F.flatten(F.transform(X.islands(o), alone))))


def over_threshold(spans: Column, threshold: float = D.SCORE_THRESHOLD) -> Column:
    return F.filter(spans, lambda s: s["score"] >= threshold)


def trim_newlines(spans: Column) -> Column:
    def one(s: Column) -> Column:
        line = X.first_line(s["text"])
        return s.withField("text", line).withField("end", s["start"] + F.length(line))

    return F.transform(spans, one)


def _medical(t: Column) -> Column:
    return t.isin(*D.MEDICAL_TYPES)


def merge(spans: Column) -> Column:
    """Sequential overlap removal in order of start, then falling score; ties by source, kind, end and name.

    Sorted by start, a span can overlap only the last one kept, so the fold looks at that one only. Medical kinds win; of one kind the
    longer stays with the higher score; else the higher score wins. A span that two sources saw is an ensemble's.
    """
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["score"]).alias("b"), (s["detected_by"] != "presidio").alias("c"), s["entity_type"].alias("d"), s["end"].alias("e"), s["pattern_name"].alias("f"), s.alias("s")))
    ordered = F.transform(F.array_sort(keyed), lambda k: k["s"])

    def step(acc: Column, x: Column) -> Column:
        y = F.try_element_at(acc, F.lit(-1))
        apart = (F.size(acc) == 0) | (x["start"] >= y["end"]) | (x["end"] <= y["start"])
        mx, my = _medical(x["entity_type"]), _medical(y["entity_type"])
        nx, ny = x["end"] - x["start"], y["end"] - y["start"]
        same = x["entity_type"] == y["entity_type"]
        best = F.greatest(x["score"], y["score"])
        winner = (
            F.when(mx & ~my, x).when(my & ~mx, y).when(same & (nx > ny), x.withField("score", best)).when(same & (ny > nx), y.withField("score", best)).when(x["score"] > y["score"], x).otherwise(y)
        )
        both = X.bind(winner, lambda v: v.withField("detected_by", F.when(x["detected_by"] != y["detected_by"], F.lit("ensemble")).otherwise(v["detected_by"])))
        return F.when(apart, F.concat(acc, F.array(x))).otherwise(F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(both)))

    # of many spans, runs that hang together are folded one by one, so that a fold's state stays small; few ones are a single run
    none = F.expr(_NONE)
    runs = X.bind(ordered, lambda o: F.when(F.size(o) <= X.BLOCK, F.array(o)).otherwise(X.islands(o)))
    return F.flatten(F.transform(runs, lambda run: F.aggregate(run, none, step)))


def kinship_words(text: Column) -> Column:
    """Word numbers of kinship and honorific keywords."""
    return F.transform(X.spans_of(text, D.KINSHIP), lambda s: word_number(text, s["start"]))


def word_number(text: Column, position: Column) -> Column:
    """The last white-space token that begins at or before a position."""
    return F.greatest(F.lit(0), F.size(F.regexp_extract_all(F.substring(text, F.lit(1), (position + 1).cast("int")), F.lit(r"\S+"), F.lit(0))) - 1)


def kinship_boost(spans: Column, text: Column) -> Column:
    """Persons within some words of a keyword get a higher score, once."""

    def one(s: Column, keys: Column) -> Column:
        near = F.when(s["entity_type"] == "PERSON", X.bind(word_number(text, s["start"]), lambda at: F.exists(keys, lambda k: F.abs(k - at) <= D.KINSHIP_WORDS))).otherwise(F.lit(False))
        raised = s.withField("score", F.least(F.lit(1.0), s["score"] + D.KINSHIP_BOOST)).withField("detected_by", F.lit("ensemble"))
        return F.when(near, raised).otherwise(s)

    return X.bind(kinship_words(text), lambda keys: F.when(F.size(keys) > 0, F.transform(spans, lambda s: one(s, keys))).otherwise(spans))


def shield(spans: Column) -> Column:
    """Without spans that overlap a medical one (an interval anti-join within a document); medical ones stay."""

    def without(every: Column, medical: Column) -> Column:
        return F.filter(every, lambda s: _medical(s["entity_type"]) | ~F.exists(medical, lambda m: (s["start"] < m["end"]) & (s["end"] > m["start"])))

    return X.bind(spans, lambda every: X.bind(F.filter(every, lambda m: _medical(m["entity_type"])), lambda medical: without(every, medical)))


def classify(spans: Column) -> Column:
    """Adds `action`: kinds to keep are KEPT, ages over the limit AGE_AGGREGATED, all else MASKED."""
    t = lambda s: s["entity_type"]
    return F.transform(
        spans,
        lambda s: s.withField("action", F.when((t(s) == "AGE") & X.has_high_age(s["text"]), F.lit("AGE_AGGREGATED")).when(t(s).isin(*D.KEEP_TYPES), F.lit("KEPT")).otherwise(F.lit("MASKED"))),
    )


def analyzed(text: str, extra: list[str] | None = None, named: Named | None = None) -> Column:
    """What the first source finds: all recognizers, raised by context, over the threshold, without spans held by others of their kind."""
    own = _all(text, [*((p, None) for p in D.PATTERNS), *(D.GENERAL[n] for n in (GENERAL if extra is None else extra))])
    found = F.concat(own, *([named(F.col(text))] if named else []))
    return X.bind(found, lambda f: without_contained(over_threshold(context_boost(f, F.col(text)))))


def standard(docs: DataFrame, extra: list[str] | None = None, named: Named | None = None) -> DataFrame:
    """The standard engine: adds `detections` to a table (doc_id, text). Null and blank texts have none.

    extra: names of general recognizers (all of them by default); named: a model for names and places beside the rules.
    Each step is a projection of its own, so that a step's result is made once.
    """
    text, none = F.col("text"), F.expr(f"cast(array() as array<{SPAN}>)")
    given = F.length(F.trim(text)) > 0
    out = docs.withColumn("__found", F.when(given, F.concat(analyzed("text", extra, named), swept(text))).otherwise(none))
    out = out.withColumn("__found", merge(trim_newlines(F.col("__found"))))
    out = out.withColumn("__found", classify(shield(kinship_boost(F.col("__found"), F.coalesce(text, F.lit(""))))))
    return out.withColumnRenamed("__found", "detections")


def rows(detected: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each detection. An outer explode: from a plain one the optimizer infers a test of the array's size, and
    pushed below the engine's projections that test would take a copy of the whole detection along."""
    out = detected.select(key, F.posexplode_outer("detections").alias("seq", "d")).where(F.col("seq").isNotNull())
    return out.select(key, F.col("seq").cast("long").alias("seq"), "d.*")


ENGINES: dict[str, Detector] = {"standard": standard}


def register_engine(name: str, engine: Detector) -> None:
    """Adds an engine, such as a token classifier (see bio.engine); it must add the same `detections` column."""
    ENGINES[name] = engine


def redact(text: Column, detections: Column) -> Column:
    """Masked spans become [KIND], aggregated ages lose their number, the rest stays. Spans are disjoint and sorted, as merge() leaves them."""
    def part(d: Column, i: Column) -> Column:
        past = F.coalesce(F.get(detections, i - 1)["end"], F.lit(0))  # where the one before ends
        gap = F.substring(text, (past + 1).cast("int"), (d["start"] - past).cast("int"))
        return F.concat(gap, F.when(d["action"] == "MASKED", F.concat(F.lit("["), d["entity_type"], F.lit("]"))).when(d["action"] == "AGE_AGGREGATED", X.aggregate_age(d["text"])).otherwise(d["text"]))

    tail = F.substring(text, (F.coalesce(F.get(detections, F.size(detections) - 1)["end"], F.lit(0)) + 1).cast("int"), F.length(text))
    return F.concat(F.array_join(F.transform(detections, part), ""), tail)
