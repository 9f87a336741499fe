"""Clustering of vectors around centroids, with distances pruned by Ptolemy's inequality."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
# Pivots, and how many of their pairs give bounds.
PIVOTS, PAIRS = 8, 12
# Whole components stay below this, so that a squared distance of 64 of them fits in a long.
LIMIT = 1 << 27
# Components below this, 64 of them, have squared distances that doubles hold exactly.
FLOATS = 1 << 22
# Vectors whose bounds are held at a time.
AT_ONCE = 2048
# Relative error granted to each step of a bound; double precision errs by less than a tenth of it.
EPS = 2.0 ** -48


class Pivots(NamedTuple):
    points: np.ndarray  # (pivots, dims) whole components
    pairs: list[tuple[int, int]]
    apart: np.ndarray  # distance within each pair


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``a`` and ``b``."""
    gap = a.astype(np.int64) - b
    return (gap * gap).sum(axis=-1)


def to_points(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of all rows to a few points, correct to about one unit in the last place."""
    return np.sqrt(np.stack([squared(rows, p) for p in points], axis=-1).astype(np.float64))


def choose_pivots(starts: np.ndarray, n: int = PIVOTS, n_pairs: int = PAIRS) -> Pivots:
    """Pivots far from each other among the first centroids, and the pairs of them that lie farthest apart."""
    if len(starts) == 0:
        return Pivots(starts, [], np.zeros(0))
    chosen = [0]
    nearest = squared(starts, starts[0])
    while len(chosen) < min(n, len(starts)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(starts, starts[chosen[-1]]))
    points = starts[chosen]
    pairs = sorted(combinations(range(len(points)), 2), key=lambda p: -squared(points[p[0]], points[p[1]]))[:n_pairs]
    return Pivots(points, pairs, np.array([np.sqrt(float(squared(points[i], points[j]))) for i, j in pairs]))


def lower_bounds(to_pivots: np.ndarray, centroids_to_pivots: np.ndarray, pivots: Pivots) -> np.ndarray:
    """Bounds below the distance of each row and centroid: |xp * cs - xs * cp| / ps for pivots p and s, the best over all pairs.

    The products may be off by a rounding step each, so a little of their sum is taken off before the
    division and of the quotient after it: a bound is never above the true distance.
    """
    best = np.zeros((len(to_pivots), len(centroids_to_pivots)))
    for (p, s), apart in zip(pivots.pairs, pivots.apart):
        one = to_pivots[:, p, None] * centroids_to_pivots[None, :, s]
        two = to_pivots[:, s, None] * centroids_to_pivots[None, :, p]
        np.maximum(best, (np.abs(one - two) - EPS * (one + two)) / apart, out=best)
    return best * (1 - EPS)


def _exact(rows: np.ndarray, centroids: np.ndarray) -> Callable[[np.ndarray, int], np.ndarray]:
    """A function for the exact squared distances of some rows to a centroid.

    Components below ``FLOATS`` keep all sums below 2^53, where doubles hold whole numbers exactly and products are fast.
    """
    if max(np.abs(rows).max(initial=0), np.abs(centroids).max(initial=0)) >= FLOATS:
        return lambda at, number: squared(rows[at], centroids[number])
    left, right = rows.astype(np.float64), centroids.astype(np.float64)
    left_norm, right_norm = (left * left).sum(axis=1), (right * right).sum(axis=1)
    return lambda at, number: (left_norm[at] + right_norm[number] - 2 * (left[at] @ right[number])).astype(np.int64)


def nearest(rows: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, distances computed). Ties go to the smaller number.

    The centroid with the least bound comes first; after that a centroid is only computed for the rows whose bound
    does not exceed the least distance they have so far. All that are computed are exact whole numbers.
    """
    label, least, computed = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), 0
    between = to_points(centroids, pivots.points)
    for low in range(0, len(rows), AT_ONCE):
        part = slice(low, low + AT_ONCE)
        exact = _exact(rows[part], centroids)
        bounds = lower_bounds(to_pivots[part], between, pivots)
        floor, first = bounds ** 2 * (1 - EPS), bounds.argmin(axis=1)
        own, best = first.copy(), np.full(len(first), np.iinfo(np.int64).max)
        for number in np.unique(first):
            at = np.flatnonzero(first == number)
            best[at] = exact(at, number)
        computed += len(first)
        for number in np.argsort(bounds.sum(axis=0), kind="stable"):
            at = np.flatnonzero((floor[:, number] <= best * (1 + EPS)) & (first != number))
            if len(at):
                distance = exact(at, number)
                better = (distance < best[at]) | ((distance == best[at]) & (number < own[at]))
                own[at[better]], best[at[better]] = number, distance[better]
                computed += len(at)
        label[part], least[part] = own, best
    return label, least, computed


def _table(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def whole_vectors(vectors: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(key, v) with v = floor(scale * x) of the vectors with exactly ``dims`` finite components."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    def whole(x: Column) -> Column:
        scaled = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) < LIMIT, scaled).otherwise(
            F.raise_error(F.lit(f"a component is {LIMIT // scale} or more: squared distances would not fit in a long"))).cast("int")

    kept = vectors.where((F.size(vector) == dims) & F.forall(vector, finite))
    return kept.select(F.col(key).alias("key"), F.transform(vector, whole).alias("v"))


def _cluster_sums(table: DataFrame, centroids: np.ndarray, pivots: Pivots) -> dict[int, tuple[int, list[int]]]:
    """(vectors, exact component sums) of the clusters that got any. Tasks add up first; k times dims rows come back."""
    k, dims = centroids.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            rows = _table(batch.column(0), dims)
            label, _, _ = nearest(rows, _table(batch.column(1), len(pivots.points)), centroids, pivots)
            order = np.argsort(label, kind="stable")
            used, starts = np.unique(label[order], return_index=True)
            if len(used):
                sums[used] += np.add.reduceat(rows[order].astype(np.int64), starts, axis=0)
                counts += np.bincount(label, minlength=k)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found]), pa.array(list(sums[found]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = table.select("v", "to_pivots").mapInArrow(add_up, "cluster long, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("at", "part"))
    totals = parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    found: dict[int, tuple[int, list[int]]] = {}
    for row in totals.orderBy("cluster", "at").collect():
        found.setdefault(row["cluster"], (row["n"], []))[1].append(int(row["total"]))
    return found


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, k: int = CLUSTERS, rounds: int = ROUNDS,
            scale: int = SCALE, seed: int = SEED, n_pivots: int = PIVOTS, n_pairs: int = PAIRS) -> DataFrame:
    """``key``, cluster, distance (squared), cluster_inertia, inertia, centroid (components) and centroid_sha256 of each usable vector.

    Vectors of other lengths or with null, NaN or infinite components are left out, null vectors too; components
    become floor(scale * x). The first centroids are the vectors with the least SHA-256 of ``seed:key``, equal
    ones by components; a null key hashes as no digits. With fewer than ``k`` vectors there are as many
    centroids. Repeated rows and keys count each. Distances, sums and floors are whole numbers, so neither the
    partitions nor reruns change the result. A component of 2^19 or more (at a scale of 256) raises an error, since
    squared distances would not fit in a long. An empty table gives no rows; other columns are not carried.

    Ptolemaic pivots: the distances of each vector to a few fixed pivots are computed once and written beside the
    components. In each round they bound the distance to every centroid from below, and only centroids whose bound
    does not exceed the least distance so far are computed. Each round is one pass over that table in which tasks add
    up their clusters, so k times dims sums are shuffled per task, however uneven the clusters are.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, key, vector, dims, scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    starts = [r["v"] for r in whole.orderBy(digest, "v").limit(k).collect()]
    centroids = np.array(starts, np.int64).reshape(-1, dims)
    if not starts:
        return _described(spark, whole.select("key", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids, key)
    pivots = choose_pivots(centroids, n_pivots, n_pairs)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distances = to_points(_table(batch.column(1), dims), pivots.points)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(distances), pa.list_(pa.float64()))], ["key", "v", "to_pivots"])

    key_type = whole.schema["key"].dataType.simpleString()
    table = stored(whole.mapInArrow(measure, f"key {key_type}, v array<int>, to_pivots array<double>"), "pivot-distances")
    for _ in range(rounds):
        for number, (n, sums) in _cluster_sums(table, centroids, pivots).items():
            centroids[number] = [total // n for total in sums]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, least, _ = nearest(_table(batch.column(1), dims), _table(batch.column(2), len(pivots.points)), centroids, pivots)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label, pa.int32()), pa.array(least)], ["key", "cluster", "distance"])

    assigned = stored(table.mapInArrow(assign, f"key {key_type}, cluster int, distance long"), "clusters")
    return _described(spark, assigned, centroids, key)


def _described(spark, assigned: DataFrame, centroids: np.ndarray, key: str) -> DataFrame:
    """Adds the facts of each cluster, a row per centroid at most."""
    inertia = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    rows = [(i, inertia[i], sum(inertia.values()), c, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
            for i, c in enumerate(centroids.tolist()) if i in inertia]
    facts = spark.createDataFrame(rows, "number int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), F.col("cluster") == F.col("number")).select(
        F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
