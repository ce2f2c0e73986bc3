"""Inverted-file search against all cosines."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import recall, vector_index


def exact(vectors, queries, k, least):
    out = {}
    for name, q in queries:
        found = []
        for i, v in vectors:
            if v is not None and len(v) == len(q):
                a, b = (np.nan_to_num(np.array(x, float), nan=0, posinf=0, neginf=0) for x in (v, q))
                norm = np.linalg.norm(a) * np.linalg.norm(b)
                cosine = float(a @ b / norm) if norm > 1e-24 else 0.0
                if cosine >= least:
                    found.append((-round(cosine, 9), i))
        out[name] = [(i, -c) for c, i in sorted(found)[:k]]
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(20, 16)) * 3
    points = centers[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 16))
    return [(f"p{i:04d}", p.tolist()) for i, p in enumerate(points)]


def searched(spark, vectors, queries, **options):
    rows = spark.createDataFrame(vectors, "id string, vector array<double>").repartition(4)
    asked = spark.createDataFrame(queries, "query_id long, vector array<double>")
    centroids = vector_index.fit_centroids(rows, cells=12)
    index = vector_index.index_vectors(rows, centroids)
    out = {}
    for r in vector_index.search(index, centroids, asked, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, round(r.cosine, 9)))
    return out


def test_exact_search(spark, clustered):
    copies = [(f"copy{i}", clustered[7][1]) for i in range(40)]
    odd = [("none", None), ("empty", []), ("zero", [0.0] * 16), ("nan", [math.nan] + [1.0] * 15), ("short", [1.0, 2.0]), ("short2", [2.0, 4.1])]
    vectors = clustered + copies + odd
    queries = [(i, clustered[i * 11][1]) for i in range(60)] + [(100, clustered[7][1]), (101, [1.0, 2.0]), (102, [0.0] * 16), (103, [1.0] * 5)]
    want = {q: rows for q, rows in exact(vectors, queries, 7, 0.1).items() if rows}
    assert searched(spark, vectors, queries, k=7, min_cosine=0.1, probes=1) == want
    nothing = searched(spark, vectors, [(1, None), (2, [1.0])], k=3)
    assert nothing == {}


def test_few_cells_find_most(spark, clustered):
    queries = [(i, clustered[i * 5][1]) for i in range(200)]
    want = exact(clustered, queries, 10, -1.0)
    got = searched(spark, clustered, queries, k=10, probes=2, exact=False)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.95


def test_bounds_leave_cells_out(spark, clustered):
    rows = spark.createDataFrame(clustered, "id string, vector array<double>")
    centroids = vector_index.fit_centroids(rows, cells=20)
    index = vector_index.index_vectors(rows, centroids)
    radii = {r.cell: r.radius for r in index.groupBy("cell").agg(F.max("angle").alias("radius")).collect()}
    asked = rows.limit(100).select(F.xxhash64("id").alias("query_id"), "vector", F.lit(0.9).alias("bound"))
    context = spark.sparkContext
    more = vector_index._probes(asked, context.broadcast(centroids), context.broadcast(radii), 1, True, -1.0)
    assert more.count() < 100 * 19 / 2


def test_nothing(spark):
    empty = spark.createDataFrame([], "id string, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>")
    assert recall.semantic_topk(empty, asked).count() == 0 and recall.semantic_topk(asked.select(F.lit("x").alias("id"), "vector"), asked.limit(0)).count() == 0
