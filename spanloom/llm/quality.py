"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once for each document; the ledger keeps its measurements and one long with a bit for
each rule that failed. A policy is a versioned mask: applying it is one bitwise AND, so policies can be changed, compared and
ablated without reading a text again. Ablations count rows by their failure bits first (at most 2 ** rules groups, summed
on the map side).

Null text counts as empty: no words, so it fails the rule on few words. Texts of any length are measured whole; repeated rows and null
doc_ids keep their rows; an empty table gives an empty ledger. Repeated windows are told by a 64-bit hash of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import ids_and_texts

WINDOW = 8
_BLANK = r"[\x20\x09-\x0D]+"

#: Bit by rule, in order. The first two make up the base.
RULES = ["few_words", "repeated_windows", "many_symbols", "repeated_lines", "shouting", "odd_word_length"]
BASE = 0b000011
#: Versioned policies: which rules reject a document.
POLICIES = {"base": BASE, "v1": 0b111111}


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _BLANK, -1), lambda w: w != "")


def _windows(words: Column) -> Column:
    """The hash of each window of words."""
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, WINDOW)]))
    return F.slice(hashes, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))


def _covered(hashes: Column) -> Column:
    """How many words lie in windows whose hash occurs twice or more. Linear but for sorting."""
    numbered = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))

    def repeated(s: Column) -> Column:
        near = F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["p"]))
        return F.sort_array(F.filter(near, lambda p: p.isNotNull()))

    # within array(...) so that the sorted list is made once, not for each look at a neighbour
    places = F.element_at(F.transform(F.array(F.sort_array(numbered)), repeated), 1)
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(places, start, lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + (p + WINDOW - F.greatest(p, a["end"]))).alias("n")), lambda a: a["n"])


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def measure(docs: DataFrame, beside: list[str] | None = None) -> DataFrame:
    """doc_id and the measurements that rules look at; with `beside`, docs has doc_id and text already, and these columns go along."""
    text = F.col("text")
    own = (docs if beside else ids_and_texts(docs)).withColumn("__words", _words(text))
    own = own.withColumn("__windows", _windows(F.col("__words")))
    own = own.withColumn("__lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    unique = F.size(F.array_distinct("__windows")) == F.size("__windows")
    return own.select(
        "doc_id",
        *(beside or []),
        F.size("__words").cast("long").alias("n_words"),
        (F.length(text) - F.length(F.regexp_replace(text, _BLANK, F.lit("")))).cast("long").alias("__blank"),
        F.length(text).cast("long").alias("n_chars"),
        _count(text, "#*$%&|<>").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(unique, F.lit(0).cast("long")).otherwise(_covered(F.col("__windows"))).alias("n_repeat_words"),
        _count(text, "!").alias("n_exclaims"),
        _count(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
    ).withColumn("word_chars", F.col("n_chars") - F.col("__blank")).drop("__blank")


def failures() -> list[Column]:
    """Whether each rule fails, in the order of RULES, over the columns of measure()."""
    n = F.col("n_words")
    return [
        n < 20,
        100 * F.col("n_repeat_words") > 30 * n,
        # more than one symbol for ten words (and a handful at least, so that short clean texts pass)
        (10 * F.col("n_symbols") > n) & (F.col("n_symbols") >= 5),
        # clean texts repeat some lines too
        100 * F.col("n_dup_lines") > 60 * F.col("n_lines"),
        # an exclamation mark on every other word, or mostly capitals
        (2 * F.col("n_exclaims") > n) | (2 * F.col("n_capitals") > F.col("word_chars")),
        (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 25 * n),
    ]


def ledger(docs: DataFrame, beside: list[str] | None = None) -> DataFrame:
    """The measurements and `failed`: bit i is set if rule i failed."""
    bits = [F.when(f, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, f in enumerate(failures())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measure(docs, beside).withColumn("failed", failed)


def apply_policy(rows: DataFrame, mask: int, name: str = "kept") -> DataFrame:
    return rows.withColumn(name, F.col("failed").bitwiseAND(F.lit(mask).cast("long")) == 0)


def ablations(rows: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """For each policy and rule: how many documents the policy rejects, the rule fails, only that rule rejects, and are rejected without it."""
    spark = rows.sparkSession
    policies = policies or POLICIES
    table = spark.createDataFrame([(p, m, r, 1 << i) for p, m in policies.items() for i, r in enumerate(RULES) if m >> i & 1], "policy string, mask long, rule string, bit long")
    groups = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))  # at most 2 ** len(RULES) rows
    f, m, b = F.col("failed"), F.col("mask"), F.col("bit")
    rejected = f.bitwiseAND(m)
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return (
        groups.join(F.broadcast(table), F.lit(True))
        .groupBy("policy", "rule")
        .agg(count(rejected != 0).alias("rejected"), count(f.bitwiseAND(b) != 0).alias("failing"), count(rejected == b).alias("only"), count(rejected.bitwiseAND(F.bitwise_not(b)) != 0).alias("without"))
    )


def keep_documents(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents that a policy keeps, with all their columns, in one pass without a shuffle."""
    own = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = apply_policy(ledger(own, ["__row"]), POLICIES[policy], "__kept")
    # not a filter: pushed below the measurements it would take a copy of each of them
    return rows.select(F.explode(F.when(F.col("__kept"), F.array("__row"))).alias("__row")).select("__row.*")
