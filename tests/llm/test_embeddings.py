import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from resalekit.llm import centroids, hard_negatives
from resalekit.llm.vectors import scaled

SCHEMA = "vec_id bigint, embedding array<double>, label int, score int, uid string, x int"


def vectors(spark, rows):
    """Rows (vec_id, vector, label) with columns that operators use too."""
    return spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], label, 1, "u", 2) for i, v, label in rows], SCHEMA)


def random_rows(n, dims, labels, seed, grain=64):
    rng = random.Random(seed)
    return [(i, [rng.randint(-grain, grain) / 64 for _ in range(dims)], rng.randrange(labels)) for i in range(n)]


def floors(v):
    return [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v]


def plain_negatives(rows, positives=5, negatives=3, low=50, high=95):
    rows = [(i, floors(v), label) for i, v, label in rows
            if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, label) in enumerate(rows):
        if i % 10:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), j, other) for b, (j, w, other) in enumerate(rows) if a != b))
        for p, (s, j, _) in enumerate([r for r in scored if r[2] == label][:positives]):
            fit = [r for r in scored if r[2] != label and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out += [(i, j, p + 1, n + 1, r[1], -s, -r[0]) for n, r in enumerate(fit)]
    cut = lambda x: x if abs(x) < 1 << 63 else None
    return sorted((*r[:5], cut(r[5]), cut(r[6])) for r in out) if all(abs(x) < 1 << 63 for r in out for x in r[5:]) else sorted(
        ((*r[:5], cut(r[5]), cut(r[6])) for r in out), key=str)


def mined(df, **kw):
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **kw).collect()
    rows = [(r.anchor_id, r.positive_id, r.positive_rank, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got]
    return sorted(rows) if all(x is not None for r in rows for x in r) else sorted(rows, key=str)


@pytest.mark.parametrize("dims,labels,grain", [(3, 4, 64), (8, 2, 200), (2, 3, 4)])
def test_negatives_equal_brute_force(spark, dims, labels, grain):
    rows = random_rows(150, dims, labels, dims, grain)  # few values: many ties
    want = plain_negatives(rows)
    assert len(want) > 30
    assert mined(vectors(spark, rows)) == want
    assert mined(vectors(spark, rows).repartition(5), chunk=4, count=2) == want


def test_negatives_of_odd_rows(spark):
    rows = random_rows(60, 4, 3, 9)
    rows += [(100, [0.0] * 4, 1), (None, [9.0] * 4, 1), (101, None, 1), (102, [1.0, None, 1.0, 1.0], 1), (103, [float("nan")] * 4, 2),
             (104, [float("inf"), 0, 0, 0], 2), (105, [3.0] * 4, None), (110, [2.0, 1.0], 0), (111, [], 0), (10, rows[10][1], rows[10][2]),
             (112, [1.0] * 9, 2), *[(200 + i, [1.0, 1.0, 1.0, 1.0], i % 2) for i in range(40)]]
    assert mined(vectors(spark, rows)) == plain_negatives(rows)


def test_negatives_of_huge_components(spark):
    rows = [(i, [(-1) ** i * 10.0 ** (i % 7 * 50), i + 0.5], i % 3) for i in range(40)] + [(90, [1e308, -1e308], 1), (91, [2.0 ** 40, 1.0], 1)]
    assert mined(vectors(spark, rows)) == plain_negatives(rows)


def test_negatives_without_rows_anchors_or_positives(spark):
    rows = random_rows(30, 4, 3, 1)
    for own in ([], [r for r in rows if r[0] % 10], [(10, [1.0], 1)], [(10, [1.0], 1), (11, [1.0], 2)]):
        assert mined(vectors(spark, own)) == []
    # negative and zero scores of positives
    opposite = [(10, [1.0, 0.0], 1), (11, [-1.0, 0.0], 1), (12, [0.0, 1.0], 1), (13, [0.0, 2.0], 2), (14, [0.5, 0.0], 2)]
    assert mined(vectors(spark, opposite)) == plain_negatives(opposite) == [(10, 12, 1, 1, 13, 0, 0)]


def test_bounds_hold_for_every_pair():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(300, 6)) * rng.choice([1, 50, 4000], (300, 1)))
    x[7] = 0
    towards = hard_negatives.directions(list(x[:50]), 5)
    norm, angles = hard_negatives.measure(x, towards)
    block = hard_negatives.Block(np.arange(300), np.arange(300), np.zeros(300), x.astype(np.int64), norm, angles)
    lower, upper = hard_negatives.bounds(block, block, lower=True)
    exact = x @ x.T
    assert (lower <= exact).all() and (upper >= exact).all() and (hard_negatives.reachable(block, block) >= exact.max(axis=1)).all()
    assert (upper < exact.max() / 2).mean() > 0.5
    assert (hard_negatives.scores(block, block) == exact).all()


def plain_clusters(rows, clusters, rounds, size):
    rows = [(i, floors(v)) for i, v, _ in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    def key(r):
        return (r[0] is None, "" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])

    centers = [v for _, v in sorted(rows, key=key)[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in rows]
        for n in set(at):
            own = [v for (_, v), a in zip(rows, at) if a == n]
            centers[n] = [sum(c) // len(own) for c in zip(*own)]
    found = [(i, near(v)[1], near(v)[0], centers[near(v)[1]]) for i, v in rows]
    return [(i, n, d, sum(r[2] for r in found if r[1] == n), sum(r[2] for r in found), c) for i, n, d, c in found]


def clustered(df, **kw):
    got = centroids.cluster(df, **kw).collect()
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, [int(c) for c in r.centroid]) for r in got), key=str)


@pytest.mark.parametrize("dims,clusters,grain", [(3, 7, 64), (8, 40, 200), (2, 12, 3), (1, 5, 300)])
def test_clusters_equal_brute_force(spark, dims, clusters, grain):
    rows = random_rows(200, dims, 2, dims, grain)
    want = sorted(plain_clusters(rows, clusters, 3, dims), key=str)
    assert clustered(vectors(spark, rows).repartition(3), clusters=clusters, rounds=3, size=dims) == want


def test_clusters_of_odd_rows(spark):
    rows = random_rows(30, 2, 2, 3) + [(None, [0.5, 0.5], 1), (5, None, 1), (6, [1.0], 1), (7, [1.0, None], 1), (8, [float("nan"), 1.0], 1),
                                       (9, [1.0, float("-inf")], 1), *[(i, [0.25, 0.25], None) for i in range(500, 530)], (3, [0.0, 0.0], 1)]
    want = sorted(plain_clusters(rows, 6, 4, 2), key=str)
    assert clustered(vectors(spark, rows), clusters=6, rounds=4, size=2) == want
    assert clustered(vectors(spark, rows[:3]), clusters=6, rounds=2, size=2) == sorted(plain_clusters(rows[:3], 6, 2, 2), key=str)
    assert clustered(vectors(spark, [])) == []
    assert clustered(vectors(spark, [(1, [1.0], 1)])) == []


def test_clusters_of_huge_components(spark):
    rows = [(i, [(-1) ** i * 10.0 ** (i % 5 * 4), float(i)], 1) for i in range(30)]
    cut = lambda v: v if v < 1 << 63 else None
    want = [(i, n, cut(d), cut(c), cut(t), x) for i, n, d, c, t, x in plain_clusters(rows, 4, 3, 2)]
    got = clustered(vectors(spark, rows), clusters=4, rounds=3, size=2)
    assert [r[:3] + r[5:] for r in got] == sorted((r[:3] + r[5:] for r in want), key=str)
    assert all(g[3] == w[3] for g, w in zip(got, sorted(want, key=str)) if w[3] is not None)


def test_the_walk_stops_early_and_ties_go_to_the_smaller_number():
    rng = np.random.default_rng(2)
    centers = rng.integers(-1000, 1000, (40, 3))
    centers[20] = centers[4]  # equal centroids
    x = np.concatenate([centers[[20, 4, 39]], rng.integers(-1000, 1000, (2000, 3))])
    lists = centroids.Lists(centers)
    at, distance, met = lists.nearest(x)
    exact = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
    assert (at == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all() and at[0] == 4
    assert met.mean() < 20 and met[0] < 40
    again = centroids.Lists(centers.astype(object)).nearest(x[:50].astype(object))
    assert again[0].tolist() == at[:50].tolist() and again[1].tolist() == distance[:50].tolist()


def test_scaled_is_the_exact_floor():
    assert scaled(np.array([[-0.1, 0.1, 1e-300]])).tolist() == [[-26, 25, 0]]
    assert scaled(np.array([[1e308, -1e300, 1e30]])).tolist() == [[int(1e308) * 256, int(-1e300) * 256, int(256e30)]]
