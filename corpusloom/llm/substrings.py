"""Removal of exact repeated passages by fixed-block anchors.

Texts are cut into blocks of consecutive words that do not overlap; the blocks are the index.
Every rolling window of a block's length probes it. A passage of `window` words that occurs
twice contains a whole block of the other occurrence, so each repeat is hit. Hits are then
extended: every passage of `window` words around a hit is compared across documents, and
overlapping repeated passages join to the maximal repeats, which are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.store import prepare, written
from corpusloom.llm.tokens import SPACED, Words, by_bytes, mix, texts_kept, windows, words_of

WINDOW = 35
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _own(value: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes that are told apart by text."""
    return mix(value ^ (row.astype(np.uint64) + np.uint64(1)) * _SPREAD)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(print, key) of the blocks of each text: from word 0, size, 2 * size, …"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            words = words_of(batch.column("text"), SPACED)
            value, begin = windows(words, size)
            row = words.row[begin]
            whole = (begin - words.first[row]) % size == 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[whole].view(np.int64)), batch.column("key").take(pa.array(row[whole]))], ["print", "key"]
            )

    return rows.mapInArrow(run, "print long, key long")


def _probes(rows: DataFrame, size: int) -> DataFrame:
    """(print, key) of every rolling window of each text, each once per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            words = words_of(batch.column("text"), SPACED)
            value, begin = windows(words, size)
            row = words.row[begin]
            _, once = np.unique(_own(value, row), return_index=True)
            once.sort()
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[once].view(np.int64)), batch.column("key").take(pa.array(row[once]))], ["print", "key"]
            )

    return rows.mapInArrow(run, "print long, key long")


def _passages(hits: DataFrame, size: int, window: int) -> DataFrame:
    """(key, start, print) of the passages of `window` words that hold a hit. hits: key, text, prints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            words = words_of(batch.column("text"), SPACED)
            value, begin = windows(words, size)
            row = words.row[begin]
            prints = batch.column("prints")
            given = np.repeat(np.arange(batch.num_rows), prints.value_lengths().to_numpy(zero_copy_only=False))
            listed = _own(prints.flatten().to_numpy(zero_copy_only=False).view(np.uint64), given)
            hit = np.zeros(len(words.hash) + 1, np.int64)
            hit[begin[np.isin(_own(value, row), listed)] + 1] = 1
            hit = np.cumsum(hit)
            passage, at = windows(words, window)
            # A passage holds the windows that begin at its first window - size + 1 words.
            near = hit[at + window - size + 1] > hit[at]
            passage, at = passage[near], at[near]
            row = words.row[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(row)), pa.array((at - words.first[row]).astype(np.int32)), pa.array(passage.view(np.int64))],
                ["key", "start", "print"],
            )

    return hits.select("key", "text", "prints").mapInArrow(run, "key long, start int, print long")


def _removed(words: Words, window: int, starts: pa.ListArray, copies: np.ndarray) -> np.ndarray:
    """Words inside a passage that is repeated: elsewhere (starts), in the same text, or in a copy of it."""
    n = len(words.hash)
    value, begin = windows(words, window)
    row = words.row[begin]
    _, place, count = np.unique(_own(value, row), return_inverse=True, return_counts=True)
    repeated = begin[(count[place] > 1) | copies[row]]
    texts = np.repeat(np.arange(len(starts)), starts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    elsewhere = starts.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + words.first[texts]
    change = np.zeros(n + 1, np.int64)
    for at in (repeated, elsewhere):
        np.add.at(change, at, 1)
        np.add.at(change, at + window, -1)
    return np.cumsum(change[:-1]) > 0


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (the text that is left, joined by single spaces).

    A word is removed if it lies in a passage of `window` words that also starts anywhere else,
    in the same document or another; passages are judged on the input. Null texts count as
    empty; a row that is repeated is repeated text. `carry` names more columns of docs to keep.
    """
    spark = docs.sparkSession
    prepare(spark)
    size = (window + 1) // 2
    named = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"),
        F.struct(*[F.col(c) for c in carry or []]).alias("carried") if carry else F.lit(None).cast("string").alias("carried"),
    )
    rows = named.select("key", "text")
    index = _blocks(rows, size).groupBy("print").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    found = _probes(rows, size).join(index.hint("shuffle_hash"), "print").where("low <> key or high <> key").select("key", "print")
    hits = written(found.distinct().groupBy("key").agg(F.collect_list("print").alias("prints")))
    once = rows.join(hits, "key").dropDuplicates(["key"])
    passages = written(_passages(once, size, window))
    shared = passages.groupBy("print").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("print")
    starts = passages.join(shared, "print").groupBy("key").agg(F.collect_list("start").alias("starts"))
    copies = rows.groupBy("key", F.xxhash64("text", F.lit(1)).alias("other")).count().where("count > 1").select("key", F.lit(True).alias("copied"))
    facts = written(starts.join(copies.distinct(), "key", "full"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            words = words_of(batch.column("text"), SPACED)
            copied = batch.column("copied").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            gone = _removed(words, window, batch.column("starts"), copied)
            removed = np.bincount(words.row[gone], minlength=batch.num_rows).astype(np.int64)
            kept = pa.array(texts_kept(words, ~gone), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("carried"), pa.array(words.counts), pa.array(removed), kept],
                ["id", "carried", "n_words", "n_removed", "kept"],
            )

    known = named.join(facts, "key", "left").select("id", "carried", "text", "starts", "copied")
    types = dict(known.dtypes)
    out = known.mapInArrow(run, f"id {types['id']}, carried {types['carried']}, n_words long, n_removed long, kept string")
    return out.select(F.col("id").alias(id_col), *[f"carried.{c}" for c in carry or []], "n_words", "n_removed", "kept")


def digest(kept: str) -> str:
    return hashlib.sha256(kept.encode()).hexdigest()
