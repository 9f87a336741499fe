import hashlib
import math
import random

import numpy as np
import pytest
from schedulesmith.llm import centroids as ce

SCHEMA = "vec_id long, embedding array<float>, cluster int, v string"


def brute(rows, dims, k, rounds):
    """Plain clustering in whole Python numbers."""
    kept = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    means = [v for _, v in start[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(means))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for c, vs in groups.items():
            means[c] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = {}
    for _, d, c in found:
        inertia[c] = inertia.get(c, 0) + d
    return sorted((str(i), c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for i, d, c in found)


def rows(dims=64):
    rnd = random.Random(2)
    f32 = lambda x: float(np.float32(x))
    heads = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    data = [(i, [f32(x + rnd.gauss(0, 0.3)) for x in heads[0 if i % 3 == 0 else i % 12]]) for i in range(500)]
    data += [(9000, [f32(100_000.5)] * dims), (9001, [f32(-300_000.25)] * dims), (None, data[7][1]), (7, data[8][1])] + [data[5]] * 40 + [(600 + i, [0.0] * dims) for i in range(30)]
    bad = [(1, None), (2, []), (3, [1.0] * (dims - 1)), (4, [1.0] * (dims + 1)), (5, [float("nan")] + [0.0] * (dims - 1)), (6, [float("inf")] * dims), (8, [None] * dims)]
    return data + bad


@pytest.mark.parametrize("k", [1, 40])
def test_clusters_equal_brute_force(spark, k):
    data = rows()
    vectors = spark.createDataFrame([(*r, 3, "x") for r in data], SCHEMA).repartition(6)
    got = ce.cluster(vectors, k=k).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == brute(data, 64, k, 5)
    assert all(hashlib.sha256(",".join(map(str, r.centroid)).encode()).hexdigest() == r.centroid_sha256 for r in got)


def test_few_no_and_huge_vectors(spark):
    few = [(1, [0.5, -0.5]), (2, [0.5, -0.5]), (3, [9.0, 1.0])]
    vectors = spark.createDataFrame(few, "vec_id long, embedding array<float>")
    got = sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in ce.cluster(vectors, dims=2).collect())
    assert got == brute(few, 2, 40, 5)
    assert ce.cluster(vectors.limit(0), dims=2).collect() == [] and ce.cluster(vectors, dims=3).collect() == []
    with pytest.raises(Exception, match="would not fit"):
        ce.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<float>"), dims=2)


def test_bounds_hold_and_prune():
    rnd = np.random.default_rng(1)
    heads = rnd.normal(0, 200, (40, 64))
    rows = np.floor(heads[rnd.integers(0, 40, 3000)] + rnd.normal(0, 15, (3000, 64))).astype(np.int64)
    means = np.floor(heads).astype(np.int64)
    for points in (means, means * 100_000, np.repeat(means[:2], 20, axis=0)):
        scale = 100_000 if points is not means and len(np.unique(points, axis=0)) > 2 else 1
        pivots = ce.choose_pivots(points)
        to_pivots = ce.to_points(rows * scale, pivots.points)
        bounds = ce.lower_bounds(to_pivots, ce.to_points(points, pivots.points), pivots)
        exact = np.stack([ce.squared(rows * scale, p) for p in points], axis=1)
        assert (bounds ** 2 * (1 - ce.EPS) <= exact).all()
        label, least, computed = ce.nearest(rows * scale, to_pivots, points, pivots)
        assert (label == exact.argmin(axis=1)).all() and (least == exact.min(axis=1)).all()
        if points is means:
            assert computed < 0.5 * exact.size
