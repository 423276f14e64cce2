"""N-gram Jaccard join by vertical partitioning (operator 4).

Shingles have one global order, from rare to frequent: by the count of their
slot (of ``1 << SLOT_BITS``; counts cover all documents), then by hash. The order
is cut into fragments of equal weight. The overlap of two sets is counted in each fragment
separately and summed per pair.

Which pairs: documents with equal sets are one. Two sets that link share
a shingle among the first n - ceil(threshold n) + 1 of each in the global order. In
the bucket of such a shingle every set meets the one with the fewest rarer
shingles before it, which in a group of near copies is the closest to what they
were copied from; verified links make components. Then pairs of different
components in a bucket are met; the members of a bucket's largest component do not meet each other.
A pair need only meet at the first shingle that both have. What stands before it in either
set is not shared, so its place bounds the sizes that a partner may have: sets are joined by shingle and
band of sizes, and one that has too many own shingles before a shingle meets nothing there, as in pages of one
template that do not link. Parity bits rule out more. So no link between components is lost."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, pieces, scratch, shingles, slices, stage
from .graph import components

SHINGLE, PERCENT = 4, 85
SLOT_BITS, FRAGMENTS, PARITY = 18, 8, 512
KEY = "xxhash64(doc_id, text)"


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return [np.unique(s) for s in pieces(*shingles(texts, k))]


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def slot_counts(docs: DataFrame, k: int = SHINGLE) -> np.ndarray:
    """Shingles of all documents in each slot, summed in the tasks before the
    shuffle; the driver gets one row per slot at most, whatever the input."""

    def run(batches):
        counts = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for part in slices(batch):
                counts += np.bincount(_slot(np.concatenate(shingle_sets(part.column("text"), k))), minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["slot", "n"])

    rows = docs.select("text").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros(1 << SLOT_BITS, np.int64)
    got = rows.toPandas()
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def order_and_fragments(counts: np.ndarray, fragments: int = FRAGMENTS) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each slot in the global order, and its fragment: ranges of the
    order with about equally many shingles."""
    order = np.lexsort((np.arange(len(counts)), counts))
    rank = np.empty(len(counts), np.int32)
    rank[order] = np.arange(len(counts), dtype=np.int32)
    before = np.cumsum(counts[order]) - counts[order]
    cut = np.empty(len(counts), np.int8)
    cut[order] = np.minimum(before * fragments // max(1, int(counts.sum())), fragments - 1)
    return rank, cut


def _sets(docs: DataFrame, rank, cut, k: int, percent: int) -> DataFrame:
    """A row per row of docs: doc_id, key, n, sid (of the set), bits (parities of
    the set's hashes by slot of ``PARITY``), sizes (of its fragments), tokens (its
    prefix, rarest first)."""

    def run(batches):
        order, fragment = rank.value, cut.value
        for batch in batches:
            for part in slices(batch):
                ns, sids, bits, sizes, toks = [], [], [], [], []
                for s in shingle_sets(part.column("text"), k):
                    n = len(s)
                    ns.append(n)
                    sids.append(xxhash.xxh64_intdigest(s.tobytes(), n) - (1 << 63) if n else 0)
                    odd = np.bincount((s & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
                    bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                    sizes.append(np.bincount(fragment[_slot(s)], minlength=FRAGMENTS))
                    first = n + (-percent * n // 100) + 1 if n else 0
                    toks.append(s[np.argsort(order[_slot(s)], kind="stable")[:first]].view(np.int64))
                ends = np.cumsum([0, *map(len, toks)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("key"), pa.array(ns, pa.int64()), pa.array(sids, pa.int64()),
                    pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(bits)), PARITY // 64).cast(pa.list_(pa.int64())),
                    pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(sizes)), FRAGMENTS).cast(pa.list_(pa.int64())),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(toks)))],
                    ["doc_id", "key", "n", "sid", "bits", "sizes", "tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.expr(KEY).alias("key"), "text")
    return rows.mapInArrow(run, "doc_id bigint, key bigint, n bigint, sid bigint, bits array<bigint>, sizes array<bigint>, "
                           "tokens array<bigint>")


def _need(a: Column, b: Column, percent: int) -> Column:
    """Least overlap of linked sets with a and b shingles: 100 o >= percent (a + b - o)."""
    return F.ceil(((a + b) * percent) / F.lit(100 + percent)).cast("long")


def _fits(x: str, y: str, percent: int) -> Column:
    """Lengths, and places of a shared prefix shingle, allow a link."""
    na, nb, pa_, pb = (F.col(f"{s}.{c}") for c in ("n", "pos") for s in (x, y))
    most = F.least(pa_, pb) + 1 + F.least(na - pa_ - 1, nb - pb - 1)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (most >= _need(na, nb, percent))


#: Bands of sizes for each factor of e.
BANDS = 50


def mixed_pairs(at: DataFrame, percent: int) -> DataFrame:
    """The rows x and y of ``at`` (buckets: token, sid, n, pos, comp, main, bits) of different components whose
    sizes allow a link if the token is the first that both have: n - pos is the most that a set can then share."""

    def band(c: str) -> Column:
        return F.floor(F.ln(F.col(c)) * BANDS).cast("int")

    at = at.withColumn("lo", F.expr(f"(n * {percent} + 99) div 100")).withColumn(
        "hi", F.expr(f"least(n * 100 div {percent}, (n - pos) * {100 + percent} div {percent} - n)")).filter("hi >= lo")
    x = at.filter("comp <> main").withColumn("band", F.explode(F.sequence(band("lo"), band("hi")))).alias("x")
    y = at.withColumn("band", band("n")).alias("y")
    return x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.comp") != F.col("y.comp"))
                  & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.sid") < F.col("y.sid")))
                  & F.col("y.n").between(F.col("x.lo"), F.col("x.hi")) & F.col("x.n").between(F.col("y.lo"), F.col("y.hi")))


def _apart() -> Column:
    """At most the shingles that only one of x and y has: parities that differ."""
    return F.expr("aggregate(zip_with(x.bits, y.bits, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)")


def _differ(percent: int) -> Column:
    """Shingles that only one of x and y may have if they link."""
    na, nb = F.col("x.n"), F.col("y.n")
    return na + nb - 2 * _need(na, nb, percent)


def _overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b, o): overlaps of the fragments in ``parts``, counted for each and summed per pair."""
    both = pairs.select("a", "b").join(parts.toDF("a", "f", "of_a"), "a").join(parts.toDF("b", "f", "of_b"), ["b", "f"])
    both = both.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("o"))
    return both.groupBy("a", "b").agg(F.sum("o").alias("o"))


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, repeated: DataFrame, cut, k: int, percent: int) -> DataFrame:
    """The pairs (a, b, of set ids) that link. The first fragment's overlaps are counted
    first; with the sizes of the others they bound the whole overlap, and only
    pairs that may still link have their other fragments counted.

    Only texts of documents that stand for a set in ``pairs`` are read again. Where
    such a row occurs several times (``repeated``: the sids), its fragments count once."""
    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "pair-sets")
    wanted = stage(sets.join(broadcast_if_small(ids), "sid", "left_semi").select("key", "sid", "n", "sizes"), "pair-keys")

    def run(batches):
        fragment = cut.value
        for batch in batches:
            for part in slices(batch):
                sids, fs, arrays = [], [], []
                for sid, s in zip(part.column("sid").to_pylist(), shingle_sets(part.column("text"), k)):
                    of = fragment[_slot(s)]
                    for f in np.unique(of).tolist():
                        sids.append(sid)
                        fs.append(f)
                        arrays.append(s[of == f].view(np.int64))
                if sids:
                    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(sids), pa.array(fs, pa.int32()), pa.ListArray.from_arrays(
                        pa.array(ends), pa.array(np.concatenate(arrays)))], ["sid", "f", "part"])

    texts = docs.select(F.expr(KEY).alias("key"), "text").join(broadcast_if_small(wanted.select("key", "sid")), "key")
    parts = stage(texts.select("sid", "text").mapInArrow(run, "sid bigint, f int, part array<bigint>"), "fragments")
    again = stage(repeated.join(broadcast_if_small(ids), "sid", "left_semi"), "repeated-sets")
    if not again.isEmpty():
        twice = broadcast_if_small(again)
        parts = parts.join(twice, "sid", "left_anti").unionByName(parts.join(twice, "sid", "left_semi").dropDuplicates(["sid", "f"]))
    info = broadcast_if_small(wanted.select("sid", "n", "sizes"))
    sized = pairs.join(info.toDF("a", "na", "sa"), "a").join(info.toDF("b", "nb", "sb"), "b")
    sized = sized.withColumn("need", _need(F.col("na"), F.col("nb"), percent))
    most = F.expr("aggregate(slice(zip_with(sa, sb, (p, q) -> least(p, q)), 2, size(sa)), 0L, (s, v) -> s + v)")
    sized = sized.join(_overlaps(pairs, parts.filter("f = 0")), ["a", "b"], "left").withColumn("o", F.coalesce("o", F.lit(0)))
    left = stage(sized.filter(F.col("o") + most >= F.col("need")).select("a", "b", "need", "o"), "pairs-left")
    more = stage(left.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "pair-sets")
    others = parts.filter("f > 0").join(broadcast_if_small(more), "sid", "left_semi")
    rest = _overlaps(left, others).withColumnRenamed("o", "others")
    return left.join(rest, ["a", "b"], "left").filter(F.col("o") + F.coalesce("others", F.lit(0)) >= F.col("need")).select("a", "b")


def join_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_shingles, component_id (the smallest
    doc_id that links lead to, its own included), key (of the row, by ``KEY``),
    label (the same for rows of one component; null without shingles).

    Words are runs of other than ASCII white space, A-Z lower-cased; fewer
    than ``k`` words are one shingle; null, empty or blank texts have no shingle
    and no link, and component_id is the doc_id. Null doc_ids are
    never the smallest; a component of nulls alone has a null id. Repeated rows
    are rows of one component. Other columns are not read; no rows: no rows."""
    spark = docs.sparkSession
    rank, cut = (spark.sparkContext.broadcast(x) for x in order_and_fragments(slot_counts(docs, k)))
    with scratch(spark) as keep:
        with scratch(spark) as keep_sets:
            rows = stage(_sets(docs, rank, cut, k, percent), "shingle-sets")
            sets = keep_sets(stage(rows.filter("n > 0").groupBy("sid").agg(F.first(F.struct("key", "n", "bits", "sizes", "tokens")).alias("x")).select(
                "sid", "x.*"), "distinct-sets"))
            repeated = rows.filter("n > 0").groupBy("sid", "key").agg(F.count("*").alias("c")).filter("c > 1")
            repeated = keep_sets(stage(repeated.select("sid").distinct(), "repeated-rows"))
            rows = keep_sets(stage(rows.select("doc_id", "key", "n", "sid"), "set-rows"))
        rows = keep(rows)
        label = keep(stage(_components_of_sets(docs, sets, repeated, cut, k, percent, keep), "set-labels"))

        # the smallest doc_id of each component
        rows = rows.join(broadcast_if_small(label.toDF("sid", "label")), "sid", "left")
        rows = rows.withColumn("label", F.coalesce("label", "sid"))
        least = rows.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
        rows = rows.join(broadcast_if_small(keep(stage(least, "component-ids"))), "label", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(
        F.col("doc_id")).alias("component_id"), "key", F.when(F.col("n") > 0, F.col("label")).alias("label"))


def _components_of_sets(docs: DataFrame, sets: DataFrame, repeated: DataFrame, cut, k: int, percent: int, keep_buckets) -> DataFrame:
    """(id, component) of the sets that link with any. Each step's tables go when the next has its own, but
    for the buckets that ``mixed_pairs`` reads, which ``keep_buckets`` gets."""
    spark = docs.sparkSession
    with scratch(spark) as keep_met:
        prefix = sets.select("sid", "n", F.posexplode("tokens").alias("pos", "token"))
        shared = stage(prefix.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token"), "shared-tokens")
        met = keep_met(stage(prefix.join(broadcast_if_small(shared, 2_000_000), "token"), "buckets"))

    # each set with the first of its bucket; of several such sets, the one it meets most often
    with scratch(spark) as keep:
        first = met.groupBy("token").agg(F.min(F.struct("pos", "sid", "n")).alias("r")).select("token", "r.*")
        star = met.alias("x").join(first.alias("y"), "token").filter((F.col("x.sid") != F.col("y.sid")) & _fits("x", "y", percent))
        star = star.groupBy(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).agg(F.count("*").alias("c"))
        star = star.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
        x, y = (sets.select(F.col("sid").alias(c), "n", "bits").alias(t) for c, t in (("a", "x"), ("b", "y")))
        star = star.join(x, "a").join(y, "b").filter(_apart() <= _differ(percent)).select("a", "b")
        star = keep(stage(star, "star-pairs"))
    with scratch(spark) as keep:
        links = keep(stage(verified(star, docs, sets, repeated, cut, k, percent), "star-links"))
    with scratch(spark) as keep:
        label = keep(stage(components(links), "star-labels"))

    # what is left: pairs of different components
    with scratch(spark) as keep_at:
        small = broadcast_if_small(label.toDF("sid", "comp"))
        at = met.join(small, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        per = at.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(
            F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1").drop("comps")
        at = at.join(per, "token").join(sets.select("sid", "bits"), "sid")
        at = keep_at(stage(at, "mixed-buckets"))
    at = keep_buckets(at)
    discard(spark, keep_met.paths)
    with scratch(spark) as keep:
        rest = mixed_pairs(at, percent)
        rest = rest.filter(_apart() <= _differ(percent)).select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b"))
        rest = keep(stage(rest.distinct(), "rest-pairs"))
    with scratch(spark) as keep:
        more = keep(stage(verified(rest, docs, sets, repeated, cut, k, percent), "rest-links"))
    return components(links.unionByName(more))


def one_of_each(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when of each component of ``joined`` only
    the row with the smallest doc_id does (null last; then by key). Of equal
    rows one stays. Rows without shingles stay."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    keys = joined.filter("label is not null").groupBy("label", "key").agg(F.min(order).alias("o"), F.count("*").alias("copies"))
    keys = stage(keys, "component-rows")
    stays = keys.groupBy("label").agg(F.min("o").alias("first"))
    gone = keys.join(stays, "label").filter(F.col("o") != F.col("first")).select(F.col("key").alias("__llm_key"))
    twice = keys.join(stays, "label").filter((F.col("o") == F.col("first")) & (F.col("copies") > 1)).select(F.col("key").alias("__llm_key"))
    gone, twice = (broadcast_if_small(stage(x, "component-keys")) for x in (gone, twice))
    same = F.expr(KEY) == F.col("__llm_key")
    rows = docs.join(gone, same, "left_anti")
    return rows.join(twice, same, "left_anti").unionByName(rows.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))
