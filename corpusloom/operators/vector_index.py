"""Nearest vectors by cosine through an inverted file of cells.

Centroids are fitted on a bounded sample; every vector belongs to the cell of its nearest one.
A search looks into the cells nearest to a query first. Then it takes every other cell that can
still hold a better vector: one at angle a from the query whose vectors lie within r of their
centroid holds no cosine above cos(a - r). The result is exact, however few cells are left.

Vectors and queries meet as blocks joined on their cell, multiplied block by block; neither side
is collected or broadcast. Store the index with `write.partitionBy("cell")` and pass it again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from ..session import stored

# Rows of a block of vectors and of queries.
PAGES, QUERIES = 1024, 256
# Cosines are compared to so many places: products of other block shapes differ beyond them.
PLACES = 12
_SLACK = 1e-9


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows at length 1; zero rows, and not finite numbers, become zero."""
    matrix = np.where(np.isfinite(matrix), matrix, 0.0)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 1e-12)


def _matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, unit vectors) for every length among the vectors; null and empty ones are left out."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    for dims in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dims)
        values = column.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(0.0)
        yield int(dims), rows, unit_rows(np.asarray(values).reshape(-1, dims))


def fit_centroids(vectors: DataFrame, cells: int = 64, sample_rows: int = 20_000, rounds: int = 10, seed: int = 7) -> dict[int, np.ndarray]:
    """Unit centroids per vector length, by k-means on a sample of about sample_rows vectors.

    vectors(id, vector). The sample is drawn by a hash of the id, so its size does not grow with
    the table.
    """
    total = vectors.count()
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = vectors.where(draw * F.lit(float(total)) < sample_rows).select(F.col("vector").cast("array<double>").alias("vector"))
    out = {}
    for dims, _, matrix in _matrices(sample.toArrow().column("vector").combine_chunks()):
        rng = np.random.default_rng(seed)
        centers = matrix[rng.permutation(len(matrix))[:cells]]
        for _ in range(rounds):
            near = (matrix @ centers.T).argmax(1)
            sums = np.zeros_like(centers)
            np.add.at(sums, near, matrix)
            filled = np.bincount(near, minlength=len(centers)) > 0
            centers = np.where(filled[:, None], unit_rows(sums), centers)
        out[dims] = centers
    return out


def _cell(dims: int, number: np.ndarray) -> np.ndarray:
    """Cells of vectors of different lengths have different numbers."""
    return (dims << 24) + number.astype(np.int64)


def index_vectors(vectors: DataFrame, centroids: dict[int, np.ndarray]) -> DataFrame:
    """(cell, id, vector, angle) of vectors(id, vector): unit vectors and their angle to the cell's centroid.

    Null and empty vectors are left out, as are those of a length the centroids do not know.
    """
    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))
    known = vectors.sparkSession.sparkContext.broadcast(centroids)
    schema = StructType([
        StructField("cell", LongType()), rows.schema["id"], StructField("vector", ArrayType(DoubleType())), StructField("angle", DoubleType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, chosen, matrix in _matrices(batch.column("vector")):
                if dims not in known.value:
                    continue
                products = matrix @ known.value[dims].T
                near = products.argmax(1)
                angle = np.arccos(np.clip(products[np.arange(len(near)), near], -1, 1))
                places = pa.array(np.arange(len(chosen) + 1, dtype=np.int32) * dims)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_cell(dims, near)), batch.column("id").take(pa.array(chosen)), pa.ListArray.from_arrays(places, pa.array(matrix.ravel())), pa.array(angle)],
                    schema.names,
                )

    return rows.mapInArrow(run, schema)


def _packed(rows: DataFrame, id_col: str, most: int, prefix: str) -> DataFrame:
    """Consecutive rows (cell, id, vector) of a cell as blocks: (cell, ids, dims, matrix as bytes)."""
    ids = ArrayType(rows.schema[id_col].dataType)
    schema = StructType([
        StructField("cell", LongType()), StructField(f"{prefix}_ids", ids), StructField("dims", IntegerType()), StructField(f"{prefix}_matrix", BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(cell: int, held: list, matrices: list, dims: int) -> pa.RecordBatch:
            kind = pa.list_(held[0].type)
            return pa.RecordBatch.from_arrays(
                [pa.array([cell]), pa.array([pa.concat_arrays(held).to_pylist()], kind), pa.array([dims], pa.int32()), pa.array([np.concatenate(matrices).tobytes()], pa.binary())],
                schema.names,
            )

        cell, held, matrices, count, size = None, [], [], 0, 0
        for batch in batches:
            cells = np.asarray(batch.column("cell"))
            cuts = np.flatnonzero(np.diff(cells)) + 1
            for low, high in zip(np.r_[0, cuts], np.r_[cuts, len(cells)]):
                for at in range(low, high, most):
                    part = batch.slice(at, min(most, high - at))
                    own = int(cells[at])
                    if held and (own != cell or count + part.num_rows > most):
                        yield block(cell, held, matrices, size)
                        held, matrices, count = [], [], 0
                    vectors = part.column("vector")
                    size = len(vectors[0])
                    cell, count = own, count + part.num_rows
                    held.append(part.column(id_col))
                    matrices.append(np.asarray(vectors.flatten()).reshape(-1, size))
        if held:
            yield block(cell, held, matrices, size)

    return rows.select("cell", id_col, "vector").mapInArrow(run, schema)


def _scored(pages: DataFrame, queries: DataFrame, k: int, least: float, id_type, query_type) -> DataFrame:
    """(query_id, id, cosine): the best k of each block of pages for each query of its cell's query blocks."""
    joined = pages.join(queries.drop("dims"), "cell").drop("cell")
    schema = StructType([StructField("query_id", query_type), StructField("id", id_type), StructField("cosine", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                dims = columns["dims"][i].as_py()
                ids, wanted = columns["page_ids"][i].values, columns["query_ids"][i].values
                left = np.frombuffer(columns["page_matrix"][i].as_buffer(), np.float64).reshape(-1, dims)
                right = np.frombuffer(columns["query_matrix"][i].as_buffer(), np.float64).reshape(-1, dims)
                cosine = np.round(left @ right.T, PLACES)
                rank = np.empty(len(ids), np.int64)
                rank[np.asarray(pc.sort_indices(ids))] = np.arange(len(ids))
                pages_at, queries_at = [], []
                for q in range(len(wanted)):
                    some = np.flatnonzero(cosine[:, q] >= least)
                    best = some[np.lexsort((rank[some], -cosine[some, q]))[:k]]
                    pages_at.append(best)
                    queries_at.append(np.full(len(best), q))
                page, query = np.concatenate(pages_at), np.concatenate(queries_at)
                yield pa.RecordBatch.from_arrays(
                    [wanted.take(pa.array(query)), ids.take(pa.array(page)), pa.array(cosine[page, query])], schema.names
                )

    return joined.mapInArrow(run, schema)


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def _probes(queries: DataFrame, centroids, radii, probes: int, rest: bool, least: float) -> DataFrame:
    """(cell, query_id, vector): the cells nearest to each query, or with `rest` the others that may hold a better vector.

    queries(query_id, vector, bound): bound is the cosine that a vector must reach.
    """
    schema = StructType([StructField("cell", LongType()), queries.schema["query_id"], StructField("vector", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = np.asarray(batch.column("bound").cast(pa.float64()).fill_null(least))
            for dims, chosen, matrix in _matrices(batch.column("vector")):
                if dims not in centroids.value:
                    continue
                centers = centroids.value[dims]
                products = matrix @ centers.T
                cells = _cell(dims, np.arange(len(centers)))
                radius = np.array([radii.value.get(int(c), -1.0) for c in cells])
                order = np.argsort(-np.where(radius >= 0, products, -2.0), axis=1, kind="stable")
                place = np.argsort(order, axis=1, kind="stable")
                taken = (place < probes) & (radius >= 0)
                if rest:
                    gap = np.maximum(np.arccos(np.clip(products, -1, 1)) - radius, 0.0)
                    reach = np.cos(np.minimum(gap, np.pi)) + _SLACK
                    taken = ~taken & (radius >= 0) & (reach >= bound[chosen][:, None])
                row, cell = np.nonzero(taken)
                places = pa.array(np.arange(len(row) + 1, dtype=np.int32) * dims)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells[cell]), batch.column("query_id").take(pa.array(chosen[row])), pa.ListArray.from_arrays(places, pa.array(matrix[row].ravel()))],
                    schema.names,
                )

    return queries.mapInArrow(run, schema)


def search(
    index: DataFrame, centroids: dict[int, np.ndarray], queries: DataFrame, k: int = 5, min_cosine: float = -1.0,
    probes: int = 4, exact: bool = True,
) -> DataFrame:
    """(query_id, rank, id, cosine): the k nearest vectors of every query, min_cosine at least.

    queries(query_id, vector). Ties go to the smaller id. With exact, cells beyond the `probes`
    nearest are searched as far as their bounds ask for; without, only these. Queries without a
    vector, or of a length the index does not hold, find nothing. Zero vectors have cosine 0.
    """
    context = index.sparkSession.sparkContext
    # A row per cell. Zero vectors lie at a right angle to everything, which the bound allows for.
    radii = {r.cell: r.radius for r in index.groupBy("cell").agg(F.max("angle").alias("radius")).collect()}
    known, reach = context.broadcast(centroids), context.broadcast(radii)
    types = index.schema["id"].dataType, queries.schema["query_id"].dataType
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    pages = _packed(index.sortWithinPartitions("cell"), "id", PAGES, "page")

    def found(wanted: DataFrame) -> DataFrame:
        blocks = _packed(wanted.repartition("cell").sortWithinPartitions("cell"), "query_id", QUERIES, "query")
        return _scored(pages, blocks, k, min_cosine, *types)

    first = _probes(asked.withColumn("bound", F.lit(min_cosine)), known, reach, probes, False, min_cosine)
    top = stored(_best(found(first), k))
    if exact:
        held = top.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("cosine")).alias("bound"))
        bounded = asked.join(held, "query_id", "left").select("query_id", "vector", F.coalesce("bound", F.lit(min_cosine)).alias("bound"))
        more = _probes(bounded, known, reach, probes, True, min_cosine)
        top = _best(top.drop("rank").unionByName(found(more)), k)
    return top.select("query_id", "rank", "id", "cosine")
