"""Rule bitmask ledger (operator 8), DataFrame functions only.

``ledger`` evaluates every rule once and stores the measurements and one failure
bit per rule. Policies are versioned bit masks: ``apply_policy`` and
``ablation`` read the ledger alone and never the texts again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """A named failure condition over the measurements, stored as one bit."""

    name: str
    bit: int
    fails: str


RULES = [
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", 2, "100 * n_symbols > 50 * n_words"),
    Rule("repeated_lines", 3, "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", 4, "word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 20 * n_words"),
    Rule("many_words", 6, "n_words > 100000"),
]

#: version -> rules in force
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "web-1": ("few_words", "repeated_words", "many_symbols", "repeated_lines", "short_words", "long_words"),
    "strict-1": tuple(r.name for r in RULES),
}


def mask(policy: str, policies=None, rules=None) -> int:
    """The bits of a policy's rules."""
    names = (policies or POLICIES)[policy]
    return sum(1 << r.bit for r in (rules or RULES) if r.name in names)


def _repeats(df: DataFrame, bits: str = "length(bin(size(g)))") -> DataFrame:
    """n_repeat_words from ``words``: words inside 3-word windows that occur twice or more.

    A window's position takes as many low bits of a long as the text needs, its hash the
    others, so that a sort of longs brings equal windows together. Where windows agree in these bits alone,
    the found ones are sorted again by their whole hashes."""
    n = F.size("words")
    df = df.withColumn("g", F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(3)]))))
    df = df.withColumn("twice", F.size(F.array_distinct("g")) < F.size("g")).withColumn("b", F.expr(bits)).drop("words")
    df = df.withColumn("packed", F.expr(
        "if(twice, sort_array(transform(g, (h, i) -> shiftleft(shiftright(h, b), b) | bigint(i))), array())"))
    near = "shiftright(x ^ coalesce(get(packed, j {} 1), ~x), b) = 0"
    df = df.withColumn("found", F.expr(f"filter(packed, (x, j) -> {near.format('+')} or {near.format('-')})")).drop("packed")
    df = df.withColumn("at", F.expr("transform(found, x -> int(x & (shiftleft(1L, b) - 1)))"))
    df = df.withColumn("full", F.expr("transform(at, p -> get(g, p))")).drop("g")
    same = "size(array_distinct(full)) = size(array_distinct(transform(found, x -> shiftright(x, b))))"
    df = df.withColumn("whole", F.expr(f"if({same}, array(), sort_array(arrays_zip(full, at)))"))
    alike = "coalesce(get(whole, j {} 1).full = x.full, false)"
    alone = f"transform(filter(whole, (x, j) -> {alike.format('+')} or {alike.format('-')}), x -> x.at)"
    df = df.withColumn("at", F.expr(f"sort_array(if(size(whole) = 0, at, {alone}))")).drop("found", "full", "whole", "b", "twice")
    return df.withColumn("n_repeat_words", F.expr(
        "aggregate(transform(at, (p, j) -> bigint(coalesce(least(3, get(at, j + 1) - p), 3))), 0L, (s, x) -> s + x)")).drop("at")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each whole text, a row per row.

    n_words and word_chars (code points) of words, runs of anything but ASCII
    blanks; n_symbols of ``#*$%&|<>``; n_lines with a word, n_dup_lines of them
    equal to an earlier one; n_repeat_words. Null or empty text: all 0. Nulls
    and repeats in doc_id stay as they are; other columns are not read."""
    t = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", t.alias("t"))
    bare = F.translate("t", BLANKS, "")
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    df = df.select(
        "doc_id", F.char_length(bare).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(F.char_length(bare) > 0, F.split(F.btrim("t", F.lit(BLANKS)), r"[\x20\x09-\x0D]+")).otherwise(
            F.array().cast("array<string>")).alias("words"))
    df = df.withColumn("n_words", F.size("words").cast("long")).withColumn("n_lines", F.size("lines").cast("long"))
    df = df.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("lines"))).drop("lines")
    return _repeats(df).select("doc_id", *MEASURES)


def ledger(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, the measurements and ``failed``, whose bit r is set when rule r
    fails. Map side only: one pass over the texts, no shuffle."""
    bits: Column = F.lit(0).cast("long")
    for r in rules or RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs).withColumn("failed", bits)


def apply_policy(rows: DataFrame, policy: str, policies=None, rules=None, column: str = "kept") -> DataFrame:
    """The ledger's rows with ``column``: true when no rule of the policy failed."""
    return rows.withColumn(column, F.col("failed").bitwiseAND(F.lit(mask(policy, policies, rules))) == 0)


def ablation(rows: DataFrame, policy: str, policies=None, rules=None) -> DataFrame:
    """For each rule of a policy: rows it fails, rows that it alone fails (those
    kept if it were left out) and the rows kept without it. Rules are counted in
    one aggregation of the ledger's distinct bit patterns; an empty ledger
    gives zeros."""
    rules = rules or RULES
    whole = mask(policy, policies, rules)
    hit = F.col("failed").bitwiseAND(F.lit(whole))
    seen = rows.select(hit.alias("hit")).groupBy("hit").agg(F.count("*").alias("n"))
    aggs, names = [], [r for r in rules if whole >> r.bit & 1]
    for r in names:
        bit, total = 1 << r.bit, lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
        aggs.append(F.struct(F.lit(r.name).alias("rule"), total(F.col("hit").bitwiseAND(F.lit(bit)) != 0).alias("n_failed"),
                             total(F.col("hit") == bit).alias("n_only"),
                             total(F.col("hit").bitwiseAND(F.lit(whole & ~bit)) == 0).alias("n_kept_without")))
    return seen.agg(F.array(*aggs).alias("x")).select(F.lit(policy).alias("policy"), F.inline("x"))
