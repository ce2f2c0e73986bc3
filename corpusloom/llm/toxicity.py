"""Toxicity by class-conditional Kneser-Ney language models.

Two bigram models, one of toxic and one of ordinary texts, are interpolated with continuation
counts of their class, and those with continuation counts that both classes share. The shared
counts stop growing at a few contexts: they stand for rare expressions, while an expression
with many contexts in one class and none in the other keeps its contrast. Every word pair of the
sample counts, less a discount below 1 that the counts of counts give. A text is judged by its
length-normalised log-likelihood ratio, as a whole and over its most telling expressions; the
part that words have in it and the part that their neighbours add are weighed apart, because
chance pairs of rare words would outshine the words otherwise.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.samples import bounded_sample, crc_mod, logistic, sigmoid, with_classes
from corpusloom.llm.store import prepare, written
from corpusloom.llm.tokens import ALNUM, by_bytes, mix, words_of

BUCKETS = 1 << 20
START = BUCKETS
PAIRS = 1 << 22
TELLING = 3
FEATURES = 2 * (1 + TELLING)


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word number of each text, bucket of the word before, and bucket of every word."""
    words = words_of(column, ALNUM, lower=True)
    own = (words.hash & np.uint64(BUCKETS - 1)).astype(np.int64)
    before = np.concatenate([[START], own[:-1]]) if len(own) else own
    before[words.first[:-1][words.counts > 0]] = START
    return words.first, before, own


def _slot(before: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Place of a word pair in the table of pairs."""
    code = (before * (BUCKETS + 1) + own).astype(np.uint64)
    return (mix(code) & np.uint64(PAIRS - 1)).astype(np.int64)


@dataclass
class Model:
    """Probabilities by bucket and class (0 ordinary, 1 toxic), and the weights of the decision.

    word: continuation probability; seen: occurrences as a context, and kept: what the discount
    leaves of them; pair: discounted counts by slot.
    """

    word: np.ndarray
    seen: np.ndarray
    kept: np.ndarray
    pair: np.ndarray
    weights: np.ndarray

    def probabilities(self, c: int, before: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Kneser-Ney probability of every word after the word before, in one class."""
        total = np.maximum(self.seen[c][before], 1)
        kept = self.kept[c][before]
        # A slot may hold several pairs; none has more than its context kept.
        direct = np.minimum(self.pair[c][_slot(before, own)], kept)
        return (direct + (total - kept) * self.word[c][own]) / total

    def ratios(self, before: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood ratio, toxic against ordinary, of every word: alone, and what the word before adds."""
        alone = np.log(self.word[1][own]) - np.log(self.word[0][own])
        both = np.log(self.probabilities(1, before, own)) - np.log(self.probabilities(0, before, own))
        return alone, both - alone

    def features(self, column: pa.Array) -> np.ndarray:
        """Per text and part of the ratio: the mean over its words and its highest single ones (0 where it has fewer)."""
        first, before, own = _grams(column)
        out = np.zeros((len(column), FEATURES))
        if not len(own):
            return out
        counts = np.diff(first)
        row = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(row)) - first[row]
        top = place < TELLING
        for at, ratio in zip((0, 1 + TELLING), self.ratios(before, own)):
            out[:, at] = np.bincount(row, ratio, len(counts)) / np.maximum(counts, 1)
            order = np.lexsort((-ratio, row))
            out[row[top], at + 1 + place[top]] = ratio[order][top]
        return out

    def packed(self) -> tuple[int, bytes]:
        """The model for a broadcast, and its size unpacked: its tables are sparse and shrink to a fraction."""
        data = pickle.dumps(vars(self), protocol=5)
        return len(data), pa.compress(data, codec="zstd", asbytes=True)

    @staticmethod
    def unpacked(size: int, data: bytes) -> Model:
        return Model(**pickle.loads(pa.decompress(data, size, codec="zstd", asbytes=True)))

    def score(self, column: pa.Array) -> np.ndarray:
        return sigmoid(self.features(column) @ self.weights[:-1] + self.weights[-1])


def _counts(sample: DataFrame) -> DataFrame:
    """(class, before, own, slot, n) over the sampled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            classes = batch.column("class").to_numpy(zero_copy_only=False).astype(np.int64)
            first, before, own = _grams(batch.column("text"))
            each = np.repeat(classes, np.diff(first))
            for c in (0, 1):
                keys, n = np.unique(before[each == c] * (BUCKETS + 1) + own[each == c], return_counts=True)
                left, right = keys // (BUCKETS + 1), keys % (BUCKETS + 1)
                columns = [np.full(len(keys), c), left, right, _slot(left, right), n]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["class", "before", "own", "slot", "n"])

    rows = sample.select("class", "text").mapInArrow(run, "class long, before long, own long, slot long, n long")
    return rows.groupBy("class", "before", "own", "slot").agg(F.sum("n").alias("n"))


def _discounts(grams: DataFrame) -> list[float]:
    """Discount of word pairs in each class: n1 / (n1 + 2 n2), by the numbers of pairs seen once and twice."""
    found = {(c, n): size for c, n, size in grams.where(F.col("n") <= 2).groupBy("class", "n").count().collect()}
    pairs = [(found.get((c, 1), 0), found.get((c, 2), 0)) for c in (0, 1)]
    return [once / (once + 2 * twice) if once and twice else 0.75 for once, twice in pairs]


def _dense(counts: DataFrame, key: str, size: int) -> np.ndarray:
    """n by class and key, as an array of fixed size."""
    out = np.zeros((2, size), np.float32)
    found = counts.select(F.col("class").cast("byte"), F.col(key).cast("int"), F.col("n").cast("float")).toPandas()
    out[found["class"].to_numpy(), found[key].to_numpy()] = found["n"].to_numpy()
    return out


def count(sample: DataFrame, discount: float = 0.75, shared: float = 4.0) -> Model:
    """The two language models of a sample of (class, text), without weights fitted yet."""
    grams = written(_counts(sample))
    continuation = _dense(grams.groupBy("class", "own").agg(F.count("*").alias("n")), "own", BUCKETS)
    less = _discounts(grams)
    left = F.col("n") - F.when(F.col("class") == 1, less[1]).otherwise(less[0])
    seen = _dense(grams.groupBy("class", "before").agg(F.sum("n").alias("n")), "before", BUCKETS + 1)
    kept = _dense(grams.groupBy("class", "before").agg(F.sum(left).alias("n")), "before", BUCKETS + 1)
    pair = _dense(grams.groupBy("class", "slot").agg(F.sum(left).alias("n")), "slot", PAIRS)
    totals = continuation.sum(1, dtype=float)
    pooled = np.minimum(continuation.sum(0), shared) + 0.1
    pooled /= pooled.sum(dtype=float)
    scale = np.maximum(totals / np.maximum(totals[totals > 0].min(initial=np.inf), 1.0), 1.0)
    word = continuation
    for c in (0, 1):
        word[c] = np.maximum(word[c] - discount * scale[c], 0) / max(totals[c], 1)
        word[c] += (1 - word[c].sum(dtype=float)) * pooled
    weights = np.append(np.tile([0.0] + [1.0] * TELLING, 2), -4.0 * TELLING)
    if not (totals > 0).all():
        weights = np.append(np.zeros(FEATURES), -30.0 if totals[1] == 0 else 30.0)
    return Model(word, seen, kept, pair, weights)


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    per_class: int = 12000, calibration: int = 4000, discount: float = 0.75, shared: float = 4.0, ridge: float = 0.01,
    seed: int = 7,
) -> Model:
    """Train on at most per_class labelled documents of each class and calibrate on others.

    A third of the labelled ids, by a hash, is set aside for the calibration (at most
    `calibration` of each class). All model sizes are fixed by BUCKETS, PAIRS and these bounds.
    `discount` is the absolute discount of continuation counts, in proportion to the larger
    class (the one of pairs is estimated); `shared` is where shared counts stop growing.
    """
    prepare(docs.sparkSession)
    aside = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(3)) == 0
    for_counts = bounded_sample(labels.where(~aside), label_col, id_col, per_class, seed)
    model = count(with_classes(docs, for_counts, id_col, text_col), discount, shared)
    held = bounded_sample(labels.where(aside), label_col, id_col, calibration, seed)
    x, y = _features_of(with_classes(docs, held, id_col, text_col), model)
    if model.weights[:-1].any() and 0 < y.sum() < len(y):
        model.weights = logistic(x, y, ridge)
    return model


def _features_of(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the calibration sample: a bounded number of rows of a few numbers."""
    shared = sample.sparkSession.sparkContext.broadcast(model.packed())
    names = ["class", *(f"x{i}" for i in range(FEATURES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.unpacked(*shared.value)
        for batch in by_bytes(batches):
            x = own.features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("class").cast(pa.int64()), *(pa.array(c) for c in x.T)], names)

    schema = ", ".join([f"{n} {'long' if n == 'class' else 'double'}" for n in names])
    found = sample.select("class", "text").mapInArrow(run, schema).toPandas()
    return found[names[1:]].to_numpy(float), found["class"].to_numpy(float)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document; null and empty texts get the score of a text without words."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.packed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.unpacked(*shared.value)
        for batch in by_bytes(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own.score(batch.column("text")))], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, score double").withColumnRenamed("id", id_col)


def toxicity(
    docs: DataFrame, labels: DataFrame, held_out: Column | None = None, label_col: str = "toxic", id_col: str = "doc_id",
    text_col: str = "text", **parameters: float,
) -> DataFrame:
    """Score every document: id, held_out, score (0 to 1), predicted (1 from 0.5).

    Labels of ids for which held_out holds (by default a fifth, by crc32 of the id) are never
    read. A repeated id gives repeated rows; null and unknown labels are left out of the
    training. Without labels of both classes every score is 0 (or 1, if only toxic ones exist).
    """
    held = crc_mod(id_col, 5) == 0 if held_out is None else held_out
    model = fit(docs, labels.where(~held), label_col, id_col, text_col, **parameters)
    scored = score(docs, model, id_col, text_col)
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
