"""Benchmark decontamination by winnowing (operator 1), DataFrame functions only.

An item's windows are its runs of ``span`` consecutive words; an item with
fewer words, but not none, is one window. Winnowing keeps, in every run of
w k-grams, the smallest hash. With w = n - k + 1, equal windows of n words keep
an equal k-gram, so every occurrence of a window shares a kept hash with its
item. Items' windows of each length n are winnowed with their own k and w; the
kept hashes of documents and items are joined, and each hit is extended over
the aligned words, which finds the runs that are equal and drops chance hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, lower_ascii, stage

SPAN, GRAM = 13, 5
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; none of null."""
    cut = F.split(lower_ascii(F.coalesce(text, F.lit(""))), NO_WORD)
    first = F.when(F.element_at(cut, 1) == "", 2).otherwise(1)
    last = F.when(F.element_at(cut, -1) == "", 1).otherwise(0)
    return F.slice(cut, first, F.greatest(F.size(cut) - first - last + 1, F.lit(0)))


def winnow(df: DataFrame, n: int, k: int, out: str) -> DataFrame:
    """Adds ``out``: array of struct(h, at), the smallest k-gram hash of each
    window of n words in ``words`` and its first place there (from 0). Fewer
    than n words: an empty array."""
    size, w = F.size("words"), n - k + 1
    if k == 1:
        df = df.withColumn("h_", F.transform("words", lambda x: F.xxhash64(F.lit(n), x)))
    else:
        df = df.withColumn("h_", F.when(size < n, F.array().cast("array<bigint>")).otherwise(F.transform(
            F.sequence(F.lit(0), size - k), lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(k)]))))
    df = df.withColumn("low_", F.expr(f"if(size(h_) < {w}, array(), transform(sequence(1, size(h_) - {w - 1}), "
                                      f"i -> array_min(slice(h_, i, {w}))))") if w > 1 else F.col("h_"))
    # a new window minimum, or one whose place has left the window, is kept with its first place in the window
    df = df.withColumn("new_", F.expr(
        f"filter(transform(low_, (x, i) -> if(i > 0 and get(low_, i - 1) = x and get(h_, i - 1) <> x, null, "
        f"struct(x as h, int(i + array_position(slice(h_, i + 1, {w}), x) - 1) as at))), s -> s is not null)") if w > 1
        else F.expr("transform(h_, (x, i) -> struct(x as h, i as at))"))
    return df.withColumnRenamed("new_", out).drop("h_", "low_")


def _items(benchmark: DataFrame, span: int) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words"))
    items = items.filter(F.size("words") > 0)
    return items.withColumn("n", F.least(F.size("words"), F.lit(span)))


#: Rows with one doc_id are told apart by their texts; equal rows share their hits.
KEY = "xxhash64(doc_id, text)"


def matches(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Hits of the joined fingerprints: key (of a document), item_ids, n, theirs
    (the item's words), shift (the document's place of the item's first word).
    Items with equal words are one."""
    items = _items(benchmark, span).groupBy("words", "n").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    items = stage(items.withColumn("item", F.xxhash64("words")), "items")
    lengths = sorted(r["n"] for r in items.select("n").distinct().toLocalIterator())  # span of them at most
    empty = "select 0L as key, 0L as item, 0 as n, 0 as shift where false"
    found = docs.sparkSession.sql(empty)
    for n in lengths:
        k = min(gram, n)
        # the outer form: of the inner one Spark infers a filter that holds, and runs, the whole expression again
        theirs = winnow(items.filter(F.col("n") == n), n, k, "f").select("item", "n", F.inline_outer("f").alias("h", "place"))
        ours = docs.select(F.expr(KEY).alias("key"), words(F.col("text")).alias("words"))
        ours = winnow(ours, n, k, "f").select("key", F.inline_outer("f"))
        hits = ours.join(broadcast_if_small(theirs), "h").select("key", "item", "n", (F.col("at") - F.col("place")).alias("shift"))
        found = found.unionByName(hits)
    found = stage(found, "hits").distinct()
    return found.join(broadcast_if_small(items.select("item", "item_ids", F.col("words").alias("theirs"))), "item").drop("item")


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM,
                  keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per row of ``docs``: its columns ``keep``, n_words, n_hit (words inside an
    occurrence of an item's window), item_ids (sorted; those with occurring
    windows), spans (runs of hit words: start, end).

    Two passes over the texts: the first emits kept hashes and joins them with
    the items'; the second extends the hits, joined to the texts by broadcast
    only behind a size check. Null or empty text, or no items: nothing is hit.
    An item with a null id hits like any other and is not listed.
    Rows that share a doc_id, also null, are judged each by its own text.
    Other columns are not read; no rows: no rows."""
    own = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]  # no name of theirs meets one of ours
    by_doc = stage(matches(docs, benchmark, span, gram).groupBy("key").agg(
        F.collect_list(F.struct("item_ids", "n", "shift", "theirs")).alias("hits")), "hits-of-documents")
    rows = docs.select(*own, F.expr(KEY).alias("key"), words(F.col("text")).alias("words"))
    rows = rows.join(broadcast_if_small(by_doc, 50_000), "key", "left")
    rows = rows.withColumn("hits", F.expr(  # from -> equal windows: where they start in the document
        "filter(transform(hits, h -> struct(h.item_ids, h.n, filter(transform(sequence(0, size(h.theirs) - h.n), i -> "
        "if(i + h.shift < 0, null, if(slice(words, i + h.shift + 1, h.n) = slice(h.theirs, i + 1, h.n), i + h.shift, null))), "
        "s -> s is not null) as starts)), h -> size(h.starts) > 0)"))
    rows = rows.withColumn("at", F.expr("sort_array(array_distinct(flatten(transform(hits, h -> flatten(transform(h.starts, "
                                        "s -> sequence(s, s + h.n - 1)))))))"))
    rows = rows.withColumn("starts", F.expr("coalesce(filter(at, (x, j) -> j = 0 or get(at, j - 1) <> x - 1), array())"))
    rows = rows.withColumn("ends", F.expr("filter(at, (x, j) -> coalesce(get(at, j + 1) <> x + 1, true))"))
    return rows.select(
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], F.size("words").cast("long").alias("n_words"),
        F.coalesce(F.when(F.col("at").isNotNull(), F.size("at")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.expr("array_sort(array_distinct(flatten(transform(hits, h -> h.item_ids))))"),
                   F.array().cast("array<string>")).alias("item_ids"),
        F.expr("transform(starts, (a, i) -> struct(a as start, get(ends, i) + 1 as end))").alias("spans"))
