"""Hard negatives by angular triangle filtering (operator 11).

Every row stores its norm and its angles to a few reference directions. For an anchor
and a row, the difference of their angles to a direction is at most the angle
between them, and their sum (or what is left of a full turn) at least: so each direction gives an
interval of the cosine. The intersection, times both norms and widened by
more than rounding can be, bounds the score. A row is scored, in integers, only
if its interval reaches what an anchor still looks for: first the score of its last positive so
far, then the window of scores below a positive. Whole blocks of rows are tested first, by the
least and greatest angle and norm in them.

Rows are cleaned, measured and staged once. The anchors meet them in chunks of a bounded size, which are
broadcast: two scans of the staged rows for each chunk. A task keeps the best of what it has read
for each anchor; these are ranked by anchor afterwards."""

from __future__ import annotations

from functools import reduce
from math import pi

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .vectors import matrix, scaled, usable

POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Reference directions, and the rows out of which they are picked. Both only decide how much is filtered.
DIRECTIONS, SAMPLE = 8, 2000
#: Anchors that are broadcast at once, about.
CHUNK = 20_000
#: Anchors and rows whose bounds are held at once.
GROUP, BLOCK = 256, 4096
#: Radians, and share of the norms' product, by which bounds are widened: float32 errs by a hundredth of it.
SLACK = np.float32(3e-5)


def directions(sample: list[np.ndarray], count: int = DIRECTIONS) -> np.ndarray:
    """Unit vectors of the sample that are far apart: each next one has the least
    cosine to the nearest of those before it. Shorter vectors end in zeros."""
    size = max(map(len, sample), default=0)
    rows = np.zeros((len(sample), size))
    for row, x in zip(rows, sample):
        row[:len(x)] = x
    with np.errstate(all="ignore"):
        length = np.sqrt((rows * rows).sum(axis=1))
    fine = (length > 0) & np.isfinite(length)
    rows = rows[fine] / length[fine][:, None]
    picked, nearest = [], np.full(len(rows), -2.0)
    while len(picked) < min(count, len(rows)):
        at = int(nearest.argmin()) if picked else 0
        picked.append(rows[at])
        nearest = np.maximum(nearest, rows @ rows[at])
    return np.array(picked).reshape(len(picked), size)


class Block:
    """Rows of one length: integers, norms, angles to the directions, ids and labels."""

    def __init__(self, uid, vec_id, label, x, norm, angles):
        self.uid, self.vec_id, self.label = uid, vec_id, label
        self.x, self.norm, self.angles = x, norm, angles

    def take(self, at) -> Block:
        return Block(*(a[at] for a in (self.uid, self.vec_id, self.label, self.x, self.norm, self.angles)))

    def __len__(self) -> int:
        return len(self.uid)


def measure(x: np.ndarray, towards: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms and angles to the directions. Missing components are 0. Rows without
    a direction of their own have right angles, which do not matter: their scores are 0."""
    with np.errstate(all="ignore"):
        x = x.astype(float)
        norm = np.sqrt((x * x).sum(axis=1))
        d = min(x.shape[1], towards.shape[1])
        cosine = np.nan_to_num(x[:, :d] @ towards[:, :d].T / norm[:, None], nan=0.0, posinf=1.0, neginf=-1.0)
    return norm, np.arccos(np.clip(cosine, -1, 1)).astype(np.float32)


def blocks(batches):
    """The staged rows as blocks of one length."""
    for batch in batches:
        lengths = np.diff(batch.column("x").offsets.to_numpy())
        for d in np.unique(lengths).tolist():
            part = batch.filter(pa.array(lengths == d))
            for at in range(0, part.num_rows, BLOCK):
                rows = part.slice(at, BLOCK)
                uid, vec_id, label, norm = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "vec_id", "label", "norm"))
                x = scaled(matrix(rows.column("x")).astype(float)) if d else np.zeros((rows.num_rows, 0), np.int64)
                yield Block(uid, vec_id, label, x, norm, matrix(rows.column("angles")) if rows.num_rows else None)


def bounds(a: Block, b: Block, lower: bool = False):
    """Least (if asked for) and greatest possible score of each anchor of ``a`` with each row of ``b``."""
    near = np.zeros((len(a), len(b)), np.float32)
    far = np.full((len(a), len(b)), np.float32(pi)) if lower else None
    for r in range(a.angles.shape[1]):
        p, q = a.angles[:, r][:, None], b.angles[:, r][None, :]
        np.maximum(near, np.abs(p - q), out=near)
        if lower:
            both = p + q
            np.minimum(far, np.minimum(both, np.float32(2 * pi) - both), out=far)
    with np.errstate(all="ignore"):
        size = (a.norm[:, None] * b.norm[None, :]).astype(np.float32)
        known = np.isfinite(size)  # beyond float32 there is no bound
        most = np.where(known, size * (np.cos(np.maximum(near - SLACK, np.float32(0))) + SLACK), np.inf)
        return (np.where(known, size * (np.cos(np.minimum(far + SLACK, np.float32(pi))) - SLACK), -np.inf) if lower else None), most


def reachable(a: Block, b: Block) -> np.ndarray:
    """Per anchor, what no row of the whole block can score above."""
    lo, hi = b.angles.min(axis=0), b.angles.max(axis=0)
    apart = np.maximum(np.maximum(a.angles - hi, lo - a.angles), np.float32(0)).max(axis=1, initial=np.float32(0))
    cosine = np.cos(np.maximum(apart - SLACK, np.float32(0))) + SLACK
    with np.errstate(all="ignore"):
        most = a.norm * b.norm.max()
        return np.where(np.isfinite(most), np.where(cosine > 0, most, a.norm * b.norm.min()) * cosine, np.inf)


def scores(a: Block, b: Block) -> np.ndarray:
    """Exact integer inner products, in a float type that holds them if there is one."""
    d = min(a.x.shape[1], b.x.shape[1])
    x, y = a.x[:, :d], b.x[:, :d]
    most = float(a.norm.max(initial=0)) * float(b.norm.max(initial=0))
    kind = np.float32 if most < 1 << 23 else np.float64 if most < 1 << 52 else object
    return x.astype(kind) @ y.astype(kind).T if d else np.zeros((len(a), len(b)))


def floats(ints: np.ndarray, up: bool = False) -> np.ndarray:
    """Integers of any size as floats; those beyond all floats are the next one below, or above."""
    if ints.dtype != object:
        return ints.astype(float)
    most = np.finfo(float).max
    far = lambda v: (np.inf if up else most) if v > 0 else (-most if up else -np.inf)
    return np.array([float(v) if abs(v) < 1 << 1023 else far(v) for v in ints.ravel().tolist()], float).reshape(ints.shape)


class Best:
    """The best rows of each slot so far: ``k`` by score, then id. ``least`` is the
    score of a slot's last one once it has ``k``, below which nothing is looked for."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.rows = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)]
        self.least = np.full(slots, -np.inf)

    def add(self, slot, score, vec_id, uid) -> None:
        slot, score, vec_id, uid = (np.concatenate([o, n]) for o, n in zip(self.rows, (slot, score, vec_id, uid)))
        by = score if score.dtype != object else np.unique(score, return_inverse=True)[1].ravel()
        order = np.lexsort((uid, vec_id, -by, slot))
        own = slot[order]
        first = np.searchsorted(own, own)
        order = order[np.arange(len(own)) - first < self.k]
        self.rows = [x[order] for x in (slot, score, vec_id, uid)]
        slot, score = self.rows[:2]
        last = np.flatnonzero(np.arange(len(slot)) - np.searchsorted(slot, slot) == self.k - 1)
        self.least[slot[last]] = floats(score[last])

    def batch(self, names: list[str]) -> pa.RecordBatch:
        slot, score, vec_id, _ = self.rows
        kept = [str(int(s)) for s in score.tolist()] if score.dtype == object else score.astype(np.int64).astype(str)
        return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(kept, pa.string()), pa.array(vec_id)], names)


def top_of(block: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the ``k`` greatest of each row's fitting entries are, and those that tie with the last."""
    if block.shape[1] > k:
        held = np.where(fits, block, -np.inf)
        fits = fits & (block >= np.partition(held, block.shape[1] - k, axis=1)[:, -k][:, None])
    return np.nonzero(fits)


def _groups(anchors: list[Block]) -> list[tuple[int, Block]]:
    """Anchors of one length, together with those that are alike, and the number of the first."""
    out, at = [], 0
    for block in anchors:
        for start in range(0, len(block), GROUP):
            out.append((at + start, block.take(slice(start, start + GROUP))))
        at += len(block)
    return out


def _nearest_positives(anchors: list[Block], batches, k: int):
    """Of the rows of one task, the best of each anchor's label."""
    total = sum(map(len, anchors))
    best = Best(total, k)
    for rows in blocks(batches):
        for label in np.unique(rows.label).tolist():
            same = rows.take(np.flatnonzero(rows.label == label))
            for first, group in _groups(anchors):
                own = np.flatnonzero(group.label == label)
                if not len(own):
                    continue
                own = own[~(reachable(group.take(own), same) < best.least[first + own])]
                a = group.take(own)
                if not len(a):
                    continue
                _, most = bounds(a, same)
                open_ = ~(most < best.least[first + own][:, None]) & (a.uid[:, None] != same.uid[None, :])
                some = np.flatnonzero(open_.any(axis=0))
                if not len(some):
                    continue
                found = scores(a, same.take(some))
                i, j = top_of(found, open_[:, some], k)
                best.add(first + own[i], found[i, j], same.vec_id[some[j]], same.uid[some[j]])
    yield best.batch(["slot", "score", "vec_id"])


def _windowed_negatives(anchors: list[Block], positive, batches, k: int, low: int, high: int):
    """Of the rows of one task, the best below each anchor's positives. ``positive``: their scores, a
    row per anchor, None where there are fewer. A score s fits p if low * p <= 100 * s <= high * p."""
    per = positive.shape[1]
    has = np.array([[p is not None for p in row] for row in positive], bool).reshape(positive.shape)
    floor, top = (np.array([[side(p) if p is not None else 0 for p in row] for row in positive], object).reshape(positive.shape)
                  for side in (lambda p: -(-low * p // 100), lambda p: high * p // 100))
    with np.errstate(all="ignore"):
        # what an anchor looks for at all; nothing where there is no positive or only empty windows
        has &= np.array(floor <= top, bool)
        low_, top_ = floats(floor), floats(top, True)
        reach = np.where(has, low_, np.inf).min(axis=1, initial=np.inf)
        ceiling = np.where(has, top_, -np.inf).max(axis=1, initial=-np.inf)
    best = Best(positive.size, k)
    for rows in blocks(batches):
        for first, group in _groups(anchors):
            at = np.arange(first, first + len(group))
            slots = at[:, None] * per + np.arange(per)
            least = np.maximum(reach[at], np.where(has[at], best.least[slots], np.inf).min(axis=1, initial=np.inf))
            own = np.flatnonzero(~(reachable(group, rows) < least) & has[at].any(axis=1))
            if not len(own):
                continue
            a, at, least = group.take(own), at[own], least[own]
            lowest, most = bounds(a, rows, lower=True)
            open_ = ~(most < least[:, None]) & ~(lowest > ceiling[at][:, None]) & (a.label[:, None] != rows.label[None, :])
            some = np.flatnonzero(open_.any(axis=0))
            if not len(some):
                continue
            found, open_ = scores(a, rows.take(some)), open_[:, some]
            for p in range(per):
                line = np.flatnonzero(has[at, p])
                if not len(line):
                    continue
                slot = at[line] * per + p
                lo, hi = (side[at[line], p][:, None] for side in ((floor, top) if found.dtype == object else (low_, top_)))
                s = found[line]
                fits = open_[line] & (s >= lo) & (s <= hi) & ~(s < best.least[slot][:, None])
                i, j = top_of(s, fits, k)
                best.add(slot[i], s[i, j], rows.vec_id[some[j]], rows.uid[some[j]])
    yield best.batch(["slot", "score", "vec_id"])


def _falling(score: str) -> Column:
    """Integers written as text, of any size, from the greatest on."""
    c = F.col(score)
    size, digits, below = F.length(c), "0123456789", c.startswith("-")
    return F.struct(F.when(below, -size).otherwise(size), F.when(below, F.translate(c, digits, digits[::-1])).otherwise(c)).desc()


def index(rows: DataFrame, anchor: Column, count: int = DIRECTIONS) -> DataFrame:
    """uid, vec_id, label, anchor, x, norm, angles of the rows that take part, staged.
    The directions come from ``SAMPLE`` rows, picked by a hash of their ids."""
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding")).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").alias("x"))
    sample = rows.select("x").orderBy(F.xxhash64("vec_id"), "x").limit(SAMPLE).collect()
    with np.errstate(over="ignore"):
        towards = directions([np.floor(256.0 * np.array(r.x, float)) for r in sample], count)
    kind = rows.schema["x"].dataType.simpleString()

    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths = np.diff(batch.column("x").offsets.to_numpy())
            norm, angles = np.zeros(batch.num_rows), np.full((batch.num_rows, len(towards)), np.float32(pi / 2))
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                if d:
                    with np.errstate(over="ignore"):
                        x = np.floor(256.0 * matrix(batch.column("x").take(pa.array(at))).astype(float))
                    norm[at], angles[at] = measure(x, towards)
            # rows that are alike stand together, so that a block's bounds are tight
            order = np.lexsort((angles.min(axis=1, initial=4), angles.argmin(axis=1) if len(towards) else norm))
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(towards))
            out = pa.RecordBatch.from_arrays([
                pa.array(uid + np.arange(batch.num_rows)), *(batch.column(c).take(pa.array(order)) for c in ("vec_id", "label", "anchor", "x")),
                pa.array(norm[order]), pa.ListArray.from_arrays(ends, pa.array(angles[order].ravel()))],
                ["uid", "vec_id", "label", "anchor", "x", "norm", "angles"])
            uid += batch.num_rows
            yield out

    schema = f"uid bigint, vec_id bigint, label bigint, anchor boolean, x {kind}, norm double, angles array<float>"
    return stage(rows.mapInArrow(run, schema), "vectors")


def _anchors(table) -> list[Block]:
    """The anchors of a chunk, by length and by the direction that is nearest."""
    out = list(blocks(table.combine_chunks().to_batches(max_chunksize=1 << 30)))
    by = {}
    for b in out:
        by.setdefault(b.x.shape[1], []).append(b)
    merged = []
    for own in by.values():
        x = np.concatenate([b.x.astype(object) if any(c.x.dtype == object for c in own) else b.x for b in own])
        block = Block(*(np.concatenate([getattr(b, n) for b in own]) for n in ("uid", "vec_id", "label")), x,
                      *(np.concatenate([getattr(b, n) for b in own]) for n in ("norm", "angles")))
        near = block.angles.argmin(axis=1) if block.angles.shape[1] else block.uid
        merged.append(block.take(np.lexsort((block.uid, near))))
    return merged


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         chunk: int = CHUNK, count: int = DIRECTIONS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score and positive_rank, from rows of
    (vec_id, label, embedding). Components become floor(256 * x); a score is an inner product of integers.

    For each row that ``anchor`` holds for, its ``positives`` best other rows of the same label, and for each of these
    its first ``negatives`` rows of another label with low * positive <= 100 * score <= high * positive, from the
    highest score on; ties by smaller vec_id. So a negative positive_score has none.

    Rows take no part that have a null id, label or vector, or a component that is null or not finite.
    Repeated rows are rows of their own, so a copy of the anchor is another row. Of vectors of different lengths the
    missing components are 0. No anchors, or none with a positive: no rows. A score beyond a long is null. Other
    columns are not read. Every row is compared: the directions and ``chunk`` change the work, not the result."""
    spark = rows.sparkSession
    table = index(rows, anchor, count)
    chosen = table.filter("anchor")
    chunks = max(1, -(-chosen.count() // chunk))
    out = []
    for n in range(chunks):
        # a bounded number of anchors: a hash of numbers without repeats deals them evenly
        own = _anchors(chosen.filter(F.pmod(F.xxhash64("uid"), F.lit(chunks)) == n).toArrow())
        total = sum(map(len, own))
        if not total:
            continue
        ids = np.concatenate([b.vec_id for b in own])
        sent = spark.sparkContext.broadcast(own)
        schema = "slot bigint, score string, vec_id bigint"
        found = table.mapInArrow(lambda batches: _nearest_positives(sent.value, batches, positives), schema)
        best = Window.partitionBy("slot")
        found = found.withColumn("p", F.row_number().over(best.orderBy(_falling("score"), "vec_id")) - 1).filter(F.col("p") < positives)
        found = stage(found, "positives")
        known = np.full((total, positives), None, object)
        for slot, p, score in zip(*found.select("slot", "p", "score").toArrow().to_pydict().values()):  # positives for each anchor
            known[slot, p] = int(score)
        windows = spark.sparkContext.broadcast(known)
        below = table.mapInArrow(lambda batches: _windowed_negatives(sent.value, windows.value, batches, negatives, low, high), schema)
        below = below.withColumn("rank", F.row_number().over(best.orderBy(_falling("score"), "vec_id"))).filter(F.col("rank") <= negatives)
        below = stage(below, "negatives")
        names = spark.createDataFrame(pa.table({"a": np.arange(total), "anchor_id": ids}))
        long_ = lambda c: F.expr(f"try_cast({c} as bigint)")
        left = found.select(F.col("slot").alias("a"), (F.col("slot") * positives + F.col("p")).alias("slot"), (F.col("p") + 1).cast("int").alias("positive_rank"),
                            F.col("vec_id").alias("positive_id"), long_("score").alias("positive_score"))
        right = below.select("slot", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), long_("score").alias("negative_score"))
        out.append(stage(left.join(right, "slot").join(F.broadcast(names), "a").select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank"), "hard-negatives"))
        sent.unpersist()
        windows.unpersist()
    empty = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint, "
             "positive_rank int")
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], empty)
