"""Near-duplicate documents by SimHash with pigeonring filtering.

A document's fingerprint has the bits that are set in over half the hashes of its shingles. Two
fingerprints are linked if at most BITS of their 64 bits differ. The bits form a ring of
SEGMENTS equal segments. If the differences of all segments sum up to BITS or less, then from
some segment on every chain of l consecutive segments has at most l * BITS / SEGMENTS of them:
the first few segments are equal, a longer chain may hold one difference, and only the whole
ring all of them. Candidates meet on what such a chain leaves no room in: the segments whose
budget is nothing, and one half of those that share a single difference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.llm.graph import components
from corpusloom.llm.store import prepare, written
from corpusloom.llm.tokens import SPACED, by_bytes, words_of

SHINGLE = 3
SEED = 42
BITS = 2
SEGMENTS = 8
# Members of a bucket are compared in pairs up to this number; larger buckets go through the
# values that lie between two fingerprints, which takes a fixed number of rows a member.
PAIRED = 32

_WIDTH = 64 // SEGMENTS
_BUDGET = [length * BITS // SEGMENTS for length in range(1, SEGMENTS + 1)]
# Segments at a chain's start that hold no difference, and those that hold one at most.
_NONE, _ONE = sum(b == 0 for b in _BUDGET), sum(b <= 1 for b in _BUDGET)
_AT_ONCE = 1 << 16


def _mask(low: int, high: int) -> int:
    """The bits of segments low to high - 1 of a ring turned to its chain's start."""
    return (1 << high * _WIDTH) - (1 << low * _WIDTH)


_MIDDLE = (_NONE + _ONE) // 2
KEY_MASKS = [_mask(0, _NONE) | _mask(_NONE, _MIDDLE), _mask(0, _NONE) | _mask(_MIDDLE, _ONE)]


def _shingles(column: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Words joined by single spaces as bytes, and each shingle's text, first and last byte in them."""
    words = words_of(column, SPACED, lower=True)
    size = words.end - words.start
    joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = words.data[SPACED[words.data]]
    begin = np.cumsum(size + 1) - (size + 1)
    counts = words.counts
    last = np.repeat(words.first[1:], counts)
    first_word = np.repeat(words.first[:-1], counts)
    at = np.arange(len(size))
    taken = np.flatnonzero((at + SHINGLE <= last) | (at == first_word))
    end_word = np.minimum(taken + SHINGLE, last[taken]) - 1
    return joined.tobytes(), words.row[taken], begin[taken], begin[end_word] + size[end_word]


def fingerprint(column: pa.Array) -> np.ndarray:
    """The fingerprint of every text of a column, as unsigned 64-bit values."""
    data, text, begin, end = _shingles(column)
    ones = np.zeros((len(column), 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, len(text), _AT_ONCE):
        part = slice(low, low + _AT_ONCE)
        spans = zip(begin[part].tolist(), end[part].tolist())
        values = np.fromiter((digest(data[a:b], SEED) for a, b in spans), np.uint64, len(text[part]))
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        start = np.flatnonzero(np.r_[True, np.diff(text[part]) != 0, True])
        for a, b in zip(start[:-1].tolist(), start[1:].tolist()):
            ones[text[low + a]] += bits[a:b].sum(0, dtype=np.int32)
    most = 2 * ones > np.bincount(text, minlength=len(column))[:, None]
    return np.packbits(most, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every document; null and empty texts have fingerprint zero."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(fingerprint(batch.column("text")).view(np.int64))], ["id", "fp"]
            )

    return rows.mapInArrow(run, StructType([rows.schema["id"], StructField("fp", LongType())]))


def _turned(value: Column, segment: int) -> Column:
    """The ring turned so that a segment holds the lowest bits."""
    if not segment:
        return value
    return F.shiftrightunsigned(value, _WIDTH * segment).bitwiseOR(F.shiftleft(value, 64 - _WIDTH * segment))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keys(fp: Column) -> Column:
    """Each key names its chain's start and half, above the bits that a key holds."""
    return F.array(*[
        _turned(fp, start).bitwiseAND(F.lit(mask)) + F.lit((2 * start + half) << 58)
        for start in range(SEGMENTS) for half, mask in enumerate(KEY_MASKS)
    ])


def _chained(difference: Column, key: Column) -> Column:
    """Whether the differences, from the key's segment on, stay within every chain's budget."""
    start = F.shiftrightunsigned(key, 58 + 1).cast("int")
    turned = F.element_at(F.array(*[_turned(difference, s) for s in range(SEGMENTS)]), start + 1)
    fits = F.lit(True)
    for length, most in enumerate(_BUDGET, 1):
        longer = length < SEGMENTS and _BUDGET[length] == most
        if not longer:
            fits = fits & (F.bit_count(turned.bitwiseAND(F.lit(_signed(_mask(0, length))))) <= most)
    return fits


def _between(fp: Column, key: Column) -> Column:
    """A fingerprint and all that differ from it in one bit its key leaves free.

    Two members of a bucket have such a value in common exactly if they differ in two bits or fewer.
    """
    choices = []
    for start in range(SEGMENTS):
        for mask in KEY_MASKS:
            free = [b for b in range(64) if not mask >> b & 1]
            choices.append(F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << (b + _WIDTH * start) % 64)) for b in free]))
    flips = F.element_at(F.array(*choices), F.shiftrightunsigned(key, 58).cast("int") + 1)
    return F.transform(flips, lambda flip: fp.bitwiseXOR(flip))


def near(nodes: DataFrame) -> DataFrame:
    """(a, b): links that join all of the distinct fingerprints `fp` which differ in BITS bits or fewer.

    Every link holds, and whatever links of all pairs would connect is connected.
    """
    keyed = nodes.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = written(keyed.join(shared, "key"))
    few = members.where(F.col("members") <= PAIRED)
    a, b = few.select(F.col("fp").alias("a"), "key"), few.select(F.col("fp").alias("b"), "key")
    pairs = a.join(b, "key").where("a < b").where(_chained(F.col("a").bitwiseXOR(F.col("b")), F.col("key"))).select("a", "b")
    many = members.where(F.col("members") > PAIRED)
    points = many.select("fp", F.explode(_between(F.col("fp"), F.col("key"))).alias("point"))
    met = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").drop("z")
    return pairs.unionAll(points.join(met, "point").where("a <> fp").select("a", F.col("fp").alias("b")))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row of docs.

    component_id is the smallest id that links reach. Equal fingerprints are one node, so copies
    and repeated rows cost one row each; texts without words have fingerprint zero and are linked
    like others. A row without an id takes part in links, but its id names no component: without
    any other it is null. Ids may have any type that can be ordered.
    """
    prepare(docs.sparkSession)
    signed = written(fingerprints(docs, id_col, text_col))
    nodes = written(signed.groupBy("fp").agg(F.min("id").alias("least")))
    classes = components(near(nodes))
    placed = nodes.join(classes, F.col("fp") == F.col("node"))
    least = placed.groupBy("component").agg(F.min("least").alias("class_least"))
    known = placed.join(least, "component").select("fp", "class_least")
    by_fp = nodes.join(known, "fp", "left").select("fp", F.coalesce("class_least", "least").alias("component_id"))
    return signed.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hexadecimal(fp: str) -> Column:
    """16 lowercase hexadecimal digits of a fingerprint."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
