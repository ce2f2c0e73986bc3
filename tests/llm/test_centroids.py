"""Centroid clustering against plain versions."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from corpusloom.llm import centroids
from corpusloom.llm.queries import LLM_QUERIES
from corpusloom.llm.store import table

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance int"


@pytest.mark.parametrize("k", [1, 2, 4, 7, 40])
def test_tree_finds_the_nearest_and_smallest(k):
    rng = np.random.default_rng(k)
    for scale in (3, 1 << 26):
        points = rng.integers(-scale, scale, (k, 5))
        points[k // 2 :] = points[: k - k // 2]  # equal centroids are ties
        vectors = rng.integers(-scale, scale, (400, 5))
        vectors[:k] = points
        label, distance = centroids.nearest(centroids.tree_of(points, 1 + k % 3), vectors)
        away = ((vectors[:, None] - points) ** 2).sum(2)
        assert (label == away.argmin(1)).all() and (distance == away.min(1)).all()


def test_the_tree_prunes():
    rng = np.random.default_rng(1)
    points = rng.integers(-100, 100, (64, 2)) * 1000
    tree = centroids.tree_of(points)
    seen = []
    real = centroids.squared
    try:
        centroids.squared = lambda v, p: seen.append(len(v)) or real(v, p)
        centroids.nearest(tree, points.repeat(5, 0) + rng.integers(-9, 9, (320, 2)))
    finally:
        centroids.squared = real
    assert sum(seen) < 320 * 64 / 3


def plain(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        labels = [nearest(v)[1] for _, v in kept]
        for j in range(len(centers)):
            own = [v for (_, v), label in zip(kept, labels) if label == j]
            if own:
                centers[j] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    by = {j: sum(d for _, c, d in out if c == j) for j in range(k)}
    return sorted((-1 if i is None else i, c, d, by[c], sum(by.values()), centers[c]) for i, c, d in out)


def test_clusters_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist(), 1, "x", 2) for i in range(150)]
    odd = [None, [], [1.0] * 3, [1.0] * 5, [1.0, None, 0.0, 0.0], [1.0, math.nan, 0.0, 0.0], [math.inf] * 4]
    rows += [(200 + i, v, 1, "x", 2) for i, v in enumerate(odd)] + rows[:20] + [(None, [0.25, -0.25, 0.0, -0.001], 1, None, 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = centroids.clusters(df, k=6, dims=4)
    found = sorted((-1 if r[0] is None else r[0], *r[1:5], r[5]) for r in got.collect())
    assert found == plain([r[:2] for r in rows], 6, 3, 4, 64)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]


def test_fewer_vectors_than_centroids(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, [1.0, 0.0]), (3, None)], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.distance for r in centroids.clusters(df, dims=2).collect()} == {1: 0, 2: 0}
    assert centroids.clusters(df.limit(0), dims=2).count() == 0
    large = spark.createDataFrame([(1, [1e30, -1e30]), (2, [1e300, 0.0])], "vec_id long, embedding array<double>")
    assert centroids.clusters(large, k=1, dims=2).agg({"distance": "max"}).first()[0] > 0


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()]
    want = [
        (*r[:5], hashlib.sha256(",".join(map(str, r[5])).encode()).hexdigest()) for r in plain(rows, 16, 3, 64, 64)
    ]
    assert sorted(tuple(r) for r in LLM_QUERIES["op13_centroids"](spark, sf_dir).collect()) == want
