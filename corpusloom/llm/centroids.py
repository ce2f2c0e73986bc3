"""Centroid clustering of integer vectors, assigned through a vantage-point tree.

Each round builds a vantage-point tree over the centroids and broadcasts it. All vectors of a
batch search it best-first together: each keeps a lower bound for every tree node it has not
entered, enters the node with the least bound, and stops when that bound is beyond its best
distance. A bound equal to the best distance is still entered, because a tie may have a smaller
number. Distances are exact integers; bounds use the triangle inequality with a margin for
rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from corpusloom.llm.store import prepare, written

LEAF = 3
# Components are held to this magnitude, so that every squared distance of 64 fits a long.
MAGNITUDE = 1 << 27
_ROUNDING = 1e-12
_FAR = np.iinfo(np.int64).max


@dataclass
class Node:
    """Centroids of a leaf, or one vantage point with its two children.

    children: (node number, least and greatest distance of its centroids to the vantage point).
    """

    members: np.ndarray
    children: list[tuple[int, float, float]]


@dataclass
class Tree:
    centroids: np.ndarray
    nodes: list[Node]


def squared(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    difference = vectors - point
    return np.einsum("ij,ij->i", difference, difference)


def tree_of(centroids: np.ndarray, leaf: int = LEAF) -> Tree:
    """A vantage-point tree: the vantage point is the first member, the others part at their median distance."""
    nodes: list[Node] = []

    def build(members: np.ndarray) -> int:
        number = len(nodes)
        node = Node(members, [])
        nodes.append(node)
        if len(members) > leaf:
            node.members, rest = members[:1], members[1:]
            away = np.sqrt(squared(centroids[rest], centroids[members[0]]).astype(np.float64))
            order = np.argsort(away, kind="stable")
            for part in np.array_split(order, 2):
                node.children.append((build(rest[part]), float(away[part].min()), float(away[part].max())))
        return number

    if len(centroids):
        build(np.arange(len(centroids)))
    return Tree(centroids, nodes)


def nearest(tree: Tree, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of every vector; of equally near ones the smallest number."""
    best = np.full(len(vectors), _FAR)
    label = np.full(len(vectors), len(tree.centroids))
    bound = np.full((len(vectors), len(tree.nodes)), np.inf)
    bound[:, 0] = 0.0
    active = np.arange(len(vectors))
    while len(active):
        entered = bound[active].argmin(1)
        within = bound[active, entered] <= np.sqrt(best[active].astype(np.float64))
        active, entered = active[within], entered[within]
        for number in np.unique(entered):
            rows = active[entered == number]
            node = tree.nodes[number]
            from_here = bound[rows, number]
            bound[rows, number] = np.inf
            for member in node.members:
                distance = squared(vectors[rows], tree.centroids[member])
                closer = (distance < best[rows]) | ((distance == best[rows]) & (member < label[rows]))
                best[rows[closer]], label[rows[closer]] = distance[closer], member
            if node.children:
                away = np.sqrt(distance.astype(np.float64))
                for child, low, high in node.children:
                    gap = np.maximum(low - away, away - high) - _ROUNDING * (away + high)
                    bound[rows, child] = np.maximum(from_here, gap)
    return label, best


def _integers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have dims finite components, and these as integers floor(scale * x)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    right = np.asarray(column.value_lengths().fill_null(-1)) == dims
    chosen = np.flatnonzero(right)
    parts = column.take(pa.array(chosen)).flatten()
    values = np.asarray(parts.cast(pa.float64()).fill_null(np.nan)).reshape(-1, dims)
    finite = np.isfinite(values).all(1)
    whole = np.clip(np.floor(values[finite] * float(scale)), -MAGNITUDE, MAGNITUDE)
    return chosen[finite], whole.astype(np.int64)


def _floor_mean(sums: list[int], count: int) -> list[int]:
    return [s // count for s in sums]


def quantised(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, v): vectors of exactly dims components, none null or not finite, as integers floor(scale * x)."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, whole = _integers(batch.column("v"), dims, scale)
            places = pa.array(np.arange(len(kept) + 1, dtype=np.int32) * dims)
            values = pa.ListArray.from_arrays(places, pa.array(whole.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(kept)), values], ["id", "v"])

    return rows.mapInArrow(run, StructType([rows.schema["id"], StructField("v", ArrayType(IntegerType()))]))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(-1, dims)


def _sums(kept: DataFrame, tree, dims: int) -> DataFrame:
    """(cluster, n, s): count and componentwise sum of each cluster's vectors, one row per cluster and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(tree.value.centroids)
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            whole = _matrix(batch.column("v"), dims)
            label, _ = nearest(tree.value, whole)
            count += np.bincount(label, minlength=k)
            for c in np.unique(label):
                total[c] += whole[label == c].sum(0)
        some = np.flatnonzero(count)
        places = pa.array(np.arange(len(some) + 1, dtype=np.int32) * dims)
        sums = pa.ListArray.from_arrays(places, pa.array(total[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), sums], ["cluster", "n", "s"])

    parts = kept.select("v").mapInArrow(run, "cluster int, n long, s array<long>")
    total = F.array(*[F.sum(F.col("s")[i]) for i in range(dims)])
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), total.alias("s"))


def _assigned(kept: DataFrame, tree, dims: int) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    fields = [kept.schema["id"], StructField("cluster", IntegerType()), StructField("distance", LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, distance = nearest(tree.value, _matrix(batch.column("v"), dims))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(label.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"]
            )

    return kept.mapInArrow(run, StructType(fields))


def first_centroids(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:id`, in that order; repeated ids by their components."""
    text = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")))
    order = F.sha2(text.cast("binary"), 256)
    first = kept.select(order.alias("order"), "v").orderBy("order", "v").limit(k).collect()
    return np.array([row.v for row in first], np.int64)


def clusters(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, dims: int = 64,
    rounds: int = 3, scale: int = 64, seed: str = "1",
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of every vector with dims finite components.

    The inertias are the distances summed over the cluster and over all vectors.

    Components become floor(scale * x), held to 2^27 in magnitude. The k first centroids are
    vectors drawn by a hash of their ids (a null id counts as the empty text); with fewer vectors
    there are fewer centroids. Each round replaces every centroid that has vectors by their mean,
    rounded down. Rows whose vector is null, of another length, or has a null or infinite
    component are left out; repeated rows count each; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    kept = written(quantised(vectors, id_col, vector_col, dims, scale))
    centroids = first_centroids(kept, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        tree = spark.sparkContext.broadcast(tree_of(centroids))
        for row in _sums(kept, tree, dims).collect():  # k rows at most
            centroids[row.cluster] = _floor_mean(row.s, row.n)
    tree = spark.sparkContext.broadcast(tree_of(centroids))
    found = written(_assigned(kept, tree, dims))
    inertia = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    known = [(i, inertia.get(i, 0), sum(inertia.values()), c.tolist()) for i, c in enumerate(centroids)]
    # k rows of dims numbers.
    known = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    joined = found.join(F.broadcast(known), "cluster")
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_text() -> Column:
    """The components of a centroid as decimal integers joined by commas."""
    return F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
