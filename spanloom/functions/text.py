"""Scalar column functions over text: spans of a pattern, checks, snippets, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.dictionaries import AGE_LIMIT

SPANS = "array<struct<start:bigint,end:bigint,text:string>>"


def bind(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body looks at it, also within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: A fold's state is copied at each step, so a state that grows with a text would make its time grow with the square. Running sums and the
#: like are therefore made in blocks of so many items, and then over the blocks.
BLOCK = 64


def java(regex: str, first: str = "") -> str:
    """A pattern as Java should read it: word borders and blanks as Unicode has them, whatever the version. A look at the first character
    comes before the costlier test of a border."""
    return f"(?U)(?=[{first}]){regex}" if first else f"(?U){regex}"


def spans_of(text: Column, regex: str | Column) -> Column:
    """All matches of a pattern with their offsets (0-based, half-open, code points), without Python.

    The pieces between matches come from split(); lengths are added up in blocks.
    """
    pattern = F.lit(java(regex)) if isinstance(regex, str) else regex
    none = F.expr(f"cast(array() as {SPANS})")
    start = F.struct(F.lit(0).cast("bigint").alias("p"), none.alias("o"))

    def offsets(found: Column, gaps: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            begin = acc["p"] + F.length(F.get(gaps, i))
            end = begin + F.length(F.get(found, i))
            return F.struct(end.alias("p"), F.concat(acc["o"], F.array(F.struct(begin.alias("start"), end.alias("end"), F.get(found, i).alias("text")))).alias("o"))

        def moved(blocks: Column) -> Column:
            def one(x: Column, b: Column) -> Column:
                base = F.aggregate(F.slice(blocks, F.lit(1), b), F.lit(0).cast("bigint"), lambda n, y: n + y["p"])
                return bind(base, lambda n: F.transform(x["o"], lambda s: F.struct((s["start"] + n).alias("start"), (s["end"] + n).alias("end"), s["text"].alias("text"))))

            return F.flatten(F.transform(blocks, one))

        last = F.size(found) - 1
        blocks = F.transform(F.sequence(F.lit(0), F.floor(last / BLOCK).cast("int")), lambda b: F.aggregate(F.sequence(b * BLOCK, F.least(b * BLOCK + BLOCK - 1, last)), start, step))
        return bind(blocks, moved)

    def alone(found: Column, gaps: Column) -> Column:  # most patterns match once, if at all
        begin = F.length(F.get(gaps, F.lit(0))).cast("bigint")
        return F.array(F.struct(begin.alias("start"), (begin + F.length(F.get(found, F.lit(0)))).alias("end"), F.get(found, F.lit(0)).alias("text")))

    each = lambda found: bind(F.split(text, pattern, -1), lambda g: F.when(F.size(found) == 1, alone(found, g)).otherwise(offsets(found, g)))
    return bind(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(F.size(found) > 0, each(found)).otherwise(none))


def literal(text: str) -> str:
    """A string as Spark SQL writes it."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def parts_sql(text: str, regex: str, first: str = "") -> str:
    """SQL: f, all matches of a pattern, and g, the pieces before, between and after them, as fields for a struct."""
    r = literal(java(regex, first))
    return f"'f', regexp_extract_all({text}, {r}, 0), 'g', split({text}, {r}, -1)"


def placed_sql(x: str) -> str:
    """SQL: spans_of() from a struct of parts_sql() that has a match. It stands once for however many patterns, so that plans stay small."""
    f, g, none = f"{x}.f", f"{x}.g", f"cast(array() as {SPANS})"
    n, m = f"length(get({g}, i))", f"length(get({f}, i))"
    step = f"named_struct('p', a.p + {n} + {m}, 'o', concat(a.o, array(named_struct('start', a.p + {n}, 'end', a.p + {n} + {m}, 'text', get({f}, i)))))"
    block = f"aggregate(sequence(b * {BLOCK}, least(b * {BLOCK} + {BLOCK - 1}, size({f}) - 1)), named_struct('p', 0L, 'o', {none}), (a, i) -> {step})"
    moved = "transform(y.o, s -> named_struct('start', s.start + n, 'end', s.end + n, 'text', s.text))"
    each = f"element_at(transform(array(aggregate(slice(k, 1, b), 0L, (n, z) -> n + z.p)), n -> {moved}), 1)"
    blocks = f"element_at(transform(array(transform(sequence(0, (size({f}) - 1) div {BLOCK}), b -> {block})), k -> flatten(transform(k, (y, b) -> {each}))), 1)"
    alone = f"array(named_struct('start', cast(length({g}[0]) as bigint), 'end', cast(length({g}[0]) + length({f}[0]) as bigint), 'text', {f}[0]))"
    return f"if(size({f}) = 1, {alone}, {blocks})"


def spans_sql(text: str, regex: str, first: str = "") -> str:
    """spans_of() as SQL text: one long expression is parsed far sooner than it is put together call by call."""
    found = f"{text} rlike {literal(java(regex, first))}"
    return f"if({found}, element_at(transform(array(named_struct({parts_sql(text, regex, first)})), x -> {placed_sql('x')}), 1), cast(array() as {SPANS}))"


def islands(spans: Column) -> Column:
    """Spans in order of start, cut into runs that don't meet: a run begins where no span before it reaches."""
    least = F.lit(-1).cast("bigint")
    top = lambda xs: F.coalesce(F.array_max(xs), least)
    end = lambda s: s["end"]

    def cut(o: Column) -> Column:
        n = F.size(o)
        tops = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.array_max(F.transform(F.slice(o, b * BLOCK + 1, F.lit(BLOCK)), end)))

        def begins(before: Column) -> Column:
            def fresh(i: Column) -> Column:
                own = F.slice(o, i - i % BLOCK + 1, i % BLOCK)  # the spans before it in its block
                return F.get(o, i)["start"] >= F.greatest(F.get(before, F.floor(i / BLOCK).cast("int")), top(F.transform(own, end)))

            return F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | fresh(i))

        runs = lambda at: F.transform(at, lambda i, j: F.slice(o, i + 1, F.coalesce(F.get(at, j + 1), n) - i))
        return bind(bind(bind(tops, lambda t: F.transform(t, lambda _, b: top(F.slice(t, F.lit(1), b)))), begins), runs)

    return bind(spans, lambda o: F.when(F.size(o) > 1, cut(o)).otherwise(F.array(o)))


def first_line(text: Column) -> Column:
    """What is left of a span's text that runs over a line's end: the first line without blanks at its end; the whole if that is empty."""
    line = F.regexp_replace(F.substring_index(text, "\n", 1), r"(?U)\s+$", "")
    return F.when((F.instr(text, "\n") > 0) & (F.length(line) > 0), line).otherwise(text)


def safe_snippet(text: Column, shown: int = 4) -> Column:
    """Stars for short texts, else the first characters and three stars."""
    return F.when(F.length(text) <= shown, F.repeat(F.lit("*"), F.length(text).cast("int"))).otherwise(F.concat(F.substring(text, 1, shown), F.lit("***")))


def aggregate_age(text: Column) -> Column:
    """Every number over the limit becomes 90+; leading zeros go with it."""
    return F.regexp_replace(text, r"0*([1-9][0-9]{2,}|9[0-9])", "90+")


def has_high_age(text: Column, limit: int = AGE_LIMIT) -> Column:
    return F.exists(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), lambda n: n.cast("decimal(38,0)") > limit)


_DIGITS = "regexp_replace({t}, '[^0-9]', '')"
_NTH = "cast(substring({t}, %d, 1) as int)"
#: The tests that a general recognizer's match must pass, as SQL over {t}.
CHECKS = {
    "octets": "forall(split({t}, '[.]'), p -> cast(p as int) <= 255)",
    "luhn": f"luhn_check({_DIGITS})",
    "nine": f"length({_DIGITS}) between 9 and 15",
    "mod97": "aggregate(transform(split(concat(substring({t}, 5), substring({t}, 1, 4)), ''), c -> if(c rlike '[0-9]', cast(c as int), ascii(c) - 55)), 0, (a, c) -> if(c > 9, (a * 100 + c) % 97, (a * 10 + c) % 97)) = 1",
    "mod11": f"(11 - aggregate(sequence(1, 9), 0, (a, i) -> a + (11 - i) * cast(substring({_DIGITS}, i, 1) as int)) % 11) % 11 = cast(substring({_DIGITS}, 10, 1) as int)",
    "groups": "if(contains({t}, '::'), size(filter(split({t}, ':'), g -> g <> '')) <= 7, size(filter(split({t}, ':'), g -> g <> '')) = 8)",
    "dea": "(" + " + ".join(f"{n} * {_NTH % i}" for i, n in zip(range(3, 9), [1, 2] * 3)) + f") % 10 = {_NTH % 9}",
}


def passes(check: str | None, text: str) -> str:
    """SQL: does this text, an SQL expression, pass a check?"""
    return "true" if check is None else CHECKS[check].replace("{t}", text)


def tokens(text: Column) -> Column:
    """Runs of characters other than white space, with offsets."""
    return spans_of(text, r"\S+")


def clamp(value: Column | float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value if isinstance(value, Column) else F.lit(float(value))))
