"""Near-duplicate documents by b-bit MinHash.

Documents with equal shingle sets become one. Each set has a few hundred minima; bands of them
name buckets, and of every minimum only the low bits are kept in a packed signature. Members
of a bucket are first compared to one of them, drawn anew in each band; what then is still in
different components of the same bucket is compared among itself, unless shingles that no other
document has rule out every link. A pair's similarity is
estimated by counting equal bits, corrected for chance, and confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.graph import components
from corpusloom.llm.store import prepare, written
from corpusloom.llm.tokens import SPACED, Words, by_bytes, mix, windows, words_of

SHINGLE = 5
# 42 bands of 6 minima miss a pair of similarity 0.85 with probability 2e-9.
BANDS, ROWS = 42, 6
MINIMA = BANDS * ROWS
BITS = 2
_LANES = 64 // BITS
SIGNATURE = -(-MINIMA // _LANES)
# Five standard errors of the estimate below the least similarity of a link.
SLACK = 0.14

_RANDOM = np.random.default_rng(612)
_A = _RANDOM.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 2**63, MINIMA, dtype=np.uint64)


def shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct windows of k words of each text, in order; a text of fewer words is one."""
    value, begin = windows(words, k)
    rows, values = [words.row[begin]], [value]
    for n in range(1, k):
        short = np.flatnonzero(words.counts == n)
        total = np.full(len(short), n, np.uint64)
        for j in range(n):
            total = mix(total) + words.hash[words.first[short] + j]
        rows.append(short)
        values.append(mix(total))
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _signatures(rows: DataFrame) -> DataFrame:
    """(id, n, h1, h2, bands, bits): size and hash of each text's shingle set, its bands and packed minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            words = words_of(batch.column("text"), SPACED, lower=True)
            row, value = shingles(words)
            texts = batch.num_rows
            n = np.bincount(row, minlength=texts)
            some = np.flatnonzero(n)
            start = np.searchsorted(row, some)
            h1, h2 = np.zeros(texts, np.uint64), np.zeros(texts, np.uint64)
            bands = np.zeros((texts, BANDS), np.uint64)
            lanes = np.zeros((texts, SIGNATURE), np.uint64)
            if len(some):
                h1[some] = np.add.reduceat(mix(value), start)
                h2[some] = np.add.reduceat(mix(value ^ np.uint64(0x5851F42D4C957F2D)), start)
                for j in range(MINIMA):
                    least = np.minimum.reduceat(value * _A[j] + _B[j], start)
                    bands[some, j // ROWS] = mix(bands[some, j // ROWS] + least + np.uint64(j))
                    low = (least >> np.uint64(40)) & np.uint64((1 << BITS) - 1)
                    lanes[some, j // _LANES] |= low << np.uint64(BITS * (j % _LANES))
            def lists(x: np.ndarray) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.arange(texts + 1, dtype=np.int32) * x.shape[1]), pa.array(x.view(np.int64).ravel()))

            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n.astype(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists(bands), lists(lanes)],
                ["id", "n", "h1", "h2", "bands", "bits"],
            )

    return rows.mapInArrow(run, "id long, n long, h1 long, h2 long, bands array<long>, bits array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """(id, set): the sorted shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            row, value = shingles(words_of(batch.column("text"), SPACED, lower=True))
            places = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(places), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), sets], ["id", "set"])

    return rows.select("id", "text").mapInArrow(run, "id long, set array<long>")


def estimate(a: str, b: str) -> Column:
    """Similarity of two sets from their packed bits: equal lanes, less those equal by chance."""
    odd = F.lit(int("01" * 32, 2))
    unequal = F.lit(0)
    for i in range(SIGNATURE):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        unequal = unequal + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd))
    chance = 1 / (1 << BITS)
    return ((1 - unequal / F.lit(float(MINIMA))) - chance) / (1 - chance)


def _near(percent: int) -> Column:
    """Whether a pair (n_a, bits_a, n_b, bits_b) may reach the similarity."""
    sizes = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return sizes & (estimate("bits_a", "bits_b") >= percent / 100 - SLACK)


def _side(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(side if c == "id" else f"{c}_{side}") for c in nodes.columns])


def _linked(percent: int) -> Column:
    """Whether the full sets of a pair (set_a, set_b) have the similarity."""
    common = F.size(F.array_intersect("set_a", "set_b"))
    return 100 * common >= percent * (F.size("set_a") + F.size("set_b") - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity."""
    return pairs.join(_side(sets, "a"), "a").join(_side(sets, "b"), "b").where(_linked(percent)).select("a", "b")


def _linkable(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members with `alone`, the number of shingles that no other of these documents has, less
    those that have too many of them for any link: a similarity is at most (n - alone) / n."""
    rows = sets.join(members.select("id").distinct(), "id", "left_semi").select("id", F.explode("set").alias("shingle"))
    once = rows.groupBy("shingle").agg(F.min("id").alias("id"), F.count("*").alias("times")).where("times = 1")
    alone = once.groupBy("id").agg(F.count("*").alias("alone"))
    known = members.join(alone, "id", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    return written(known.where(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n")))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id) of every document.

    Documents are linked whose sets of five-word shingles have a similarity of percent / 100 or
    more; component_id is the smallest id that links reach. Null and empty texts have no
    shingles and are linked with nothing. Rows of one id count as one document; a null id is a
    document without links. The id must be a number.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = written(_signatures(rows))
    linkable = signed.where("n > 0 and id is not null")
    nodes = written(
        linkable.groupBy("h1", "h2", "n").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    )
    leaders = F.min(F.struct(F.xxhash64("id", "band").alias("draw"), "id"))["id"]
    banded = nodes.select("id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(leaders.alias("leader"), F.count("id").alias("members")).where("members > 1")
    members = written(banded.join(shared.drop("members"), "band"))
    known = nodes.select("id", "n", "bits")
    first = members.where("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    first = written(first.join(_side(known, "a"), "a").join(_side(known, "b"), "b").where(_near(percent)).select("a", "b"))
    wanted = written(members.select("id").distinct())
    sets = written(_sets(rows.join(wanted, "id", "left_semi")).dropDuplicates(["id"]))
    found = written(_confirmed(first, sets, percent))
    classes = components(found)
    # Buckets that still hold several components: compare across these.
    placed = members.select("band", "id").join(classes, F.col("id") == F.col("node"), "left")
    placed = placed.select("band", "id", F.coalesce("component", "id").alias("class"))
    mixed = placed.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("band")
    open_ = written(placed.join(mixed, "band", "left_semi").join(known, "id"))
    open_ = _linkable(open_, sets, percent).join(sets, "id")
    most = F.least(F.col("n_a") - F.col("alone_a"), F.col("n_b") - F.col("alone_b"))
    sharing = 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)
    # All tests are part of the join, the cheap ones first: only links leave it.
    across = _side(open_, "a").join(
        _side(open_, "b"), (F.col("band_a") == F.col("band_b")) & (F.col("class_a") < F.col("class_b")) & sharing & _near(percent) & _linked(percent)
    )
    more = written(across.select("a", "b").distinct())
    classes = components(found.unionAll(more))
    by_set = nodes.join(classes, F.col("id") == F.col("node"), "left").select("h1", "h2", "n", F.coalesce("component", "id").alias("component"))
    joined = signed.drop("bands", "bits").join(by_set, ["h1", "h2", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows of docs, all columns, whose id is the smallest of its component; rows without an id stay."""
    found = links(docs, id_col, text_col, percent)
    gone = written(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("id that goes")).distinct())
    return docs.join(gone, docs[id_col] == gone["id that goes"], "left_anti")
