"""Benchmark decontamination by winnowing.

Of every few consecutive k-grams of a text the one with the smallest hash is kept as a
fingerprint. A shared span of `guarantee` words or more has the same smallest k-gram in both
texts, so joining the fingerprints of documents and benchmark items finds every such span; the
hits are then extended to the windows around them and compared in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.store import prepare, written
from corpusloom.llm.tokens import ALNUM, Words, by_bytes, windows, words_of

WINDOW = 13
GRAM = 5


def winnowed(words: Words, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the smallest k-gram of every `span` consecutive ones, each once per text.

    Of equal ones the last counts, so that a run of equal grams keeps few. A smaller span
    keeps all that a larger one does, and more.
    """
    value, begin = windows(words, k)
    row = words.row[begin]
    n = len(value)
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = np.flatnonzero(row[: n - span + 1] == row[span - 1 :])
    best, place = value[whole], whole.copy()
    for j in range(1, span):
        now = value[whole + j]
        better = now <= best
        best = np.where(better, now, best)
        place[better] = whole[better] + j
    place = np.unique(place)
    return _distinct(row[place], value[place])


def _distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _fingerprints(rows: DataFrame, lengths: list[int], gram: int, longest: int, whole_items: bool) -> DataFrame:
    """(key, size, print) of texts. `lengths`: the numbers of words of the items shorter than a window.

    Items of gram words or more need the fingerprints of the smallest span among them; each
    length below gram needs all windows of that length.
    """
    spans = [n - gram + 1 for n in lengths if n >= gram] + [longest - gram + 1]
    tiny = [n for n in lengths if n < gram]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            words = words_of(batch.column("text"), ALNUM, lower=True)
            found = [(gram, *winnowed(words, gram, min(spans)))]
            for n in tiny:
                value, begin = windows(words, n)
                row = words.row[begin]
                if whole_items:
                    exact = words.counts[row] == n
                    row, value = row[exact], value[exact]
                found.append((n, *_distinct(row, value)))
            for size, row, value in found:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(row)), pa.array(np.full(len(row), size, np.int32)), pa.array(value.view(np.int64))],
                    ["key", "size", "print"],
                )

    return rows.select("key", "text").mapInArrow(run, f"key {dict(rows.dtypes)['key']}, size int, print long")


def _windows_of(words: Words, window: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per text: the window length (the text's own if it is shorter), window hashes and their first words."""
    value, begin = windows(words, window)
    row = words.row[begin]
    bounds = np.searchsorted(row, np.arange(len(words.counts) + 1))
    out = []
    for i, n in enumerate(words.counts):
        if n == 0 or n >= window:
            out.append((window, value[bounds[i] : bounds[i + 1]], begin[bounds[i] : bounds[i + 1]] - words.first[i]))
        else:
            own = Words(words.data, words.at, words.hash[words.first[i] : words.first[i + 1]], words.start, words.end, np.array([0, n]))
            out.append((int(n), *windows(own, int(n))))
    return out


def _extended(candidates: DataFrame, window: int) -> DataFrame:
    """(key, n_hit, items) of candidate documents: key, text, items array<struct<item, text>>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, most=1 << 20):
            words = words_of(batch.column("text"), ALNUM, lower=True)
            own_windows, hits, found = {window: _windows_of(words, window)}, [], []
            for i, items in enumerate(batch.column("items").to_pylist()):
                own = slice(words.first[i], words.first[i + 1])
                n = int(words.counts[i])
                change, names = np.zeros(n + 1, np.int64), set()
                texts = words_of(pa.array([x["text"] for x in items], pa.string()), ALNUM, lower=True)
                for item, (size, value, _) in zip(items, _windows_of(texts, window)):
                    if size == window:
                        length, mine, begin = own_windows[window][i]
                        if length != window:
                            continue
                    else:
                        part = Words(words.data, words.at, words.hash[own], words.start, words.end, np.array([0, n]))
                        mine, begin = windows(part, size)
                    hit = begin[np.isin(mine, value)]
                    if len(hit):
                        names.add(None if item["name"] is None else str(item["name"]))
                        np.add.at(change, hit, 1)
                        np.add.at(change, hit + size, -1)
                hits.append(int((np.cumsum(change[:-1]) > 0).sum()))
                found.append(sorted(names - {None}) + [None] * (None in names))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(hits, pa.int64()), pa.array(found, pa.list_(pa.string()))], ["key", "n_hit", "items"]
            )

    return candidates.select("key", "text", "items").mapInArrow(run, "key long, n_hit long, items array<string>")


def _counted(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            n = words_of(batch.column("text"), ALNUM, lower=True).counts
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(n)], ["id", "key", "n_words"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, key long, n_words long")


def overlaps(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
) -> DataFrame:
    """One row per document: id, key, n_words, n_hit (long), items (sorted ids of the items found, as strings).

    A document word is hit if it lies in an occurrence of a window of an item: `window`
    consecutive words, or all words of a shorter item. Null and empty texts have no words.
    Items are told apart by id and text together; items without an id count as one, a null that
    stands last.
    Documents are told apart by id and text together (`key` is their hash), so repeated rows
    each get the same result; repeated items count once per id.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key")
    )
    tests = items.select(F.col(item_col).alias("name"), F.col(item_text_col).alias("text"))
    # Items without an id keep a key of their own, which an equality join finds.
    tests = tests.withColumn("key", F.xxhash64(F.col("name").isNull(), "name", "text")).dropDuplicates(["key"])
    lengths = _short_lengths(tests, window)
    train = _fingerprints(rows, lengths, gram, window, whole_items=False)
    test = written(_fingerprints(tests, lengths, gram, window, whole_items=True).withColumnRenamed("key", "item"))
    pairs = written(train.join(test, ["size", "print"]).select("key", "item").distinct())
    per_doc = pairs.join(tests.withColumnRenamed("key", "item"), "item")
    per_doc = written(per_doc.groupBy("key").agg(F.collect_list(F.struct("name", "text")).alias("items")))
    # Repeated rows are extended once each and lead to one result per key.
    candidates = rows.select("key", "text").join(per_doc, "key")
    extended = _extended(candidates, window).where("n_hit > 0").dropDuplicates(["key"])
    return _counted(rows).join(written(extended), "key", "left").select(
        F.col("id").alias(id_col), "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _short_lengths(tests: DataFrame, window: int) -> list[int]:
    """The numbers of words below a window that items have: at most window - 1 values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            n = np.unique(words_of(batch.column("text"), ALNUM, lower=True).counts)
            yield pa.RecordBatch.from_arrays([pa.array(n[(n > 0) & (n < window)])], ["n"])

    return sorted(r[0] for r in tests.mapInArrow(run, "n long").distinct().collect())


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> Column:
    """A document is contaminated if a twentieth of its words or more are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated."""
    found = overlaps(docs, items, id_col, text_col, **columns)
    bad = written(found.where(contaminated()).select(F.col("key").alias("key of the text")).distinct())
    keyed = docs.withColumn("key of the text", F.xxhash64(F.col(id_col), F.col(text_col)))
    return keyed.join(bad, "key of the text", "left_anti").select(*docs.columns)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
