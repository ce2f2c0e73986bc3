"""Quality classifier by importance resampling.

Two generative models, bags of hashed n-grams, describe the target (documents labelled good)
and the raw corpus (every document). The ratio of the two likelihoods, normalised by length
and calibrated on labels, is a document's log-odds of belonging to the target; Gumbel noise
added to the log-odds and a cut at the k-th highest key draw k documents without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.samples import bounded_sample, logistic, with_classes
from corpusloom.llm.store import prepare, written
from corpusloom.llm.tokens import SPACED, by_bytes, mix, words_of

# Buckets of the hashed n-grams: words and word pairs, byte triples, and references back.
BUCKETS = 1 << 14
BACK = 4
SIZES = (BUCKETS, BUCKETS, BACK + 1)
_SLICE = 1 << 21


def _triples(data: np.ndarray) -> np.ndarray:
    """Bucket of the byte triple that ends at each byte (the first two bytes stand alone)."""
    out = np.empty(len(data), np.int32)
    for low in range(0, len(data), _SLICE):
        own = data[max(low - 2, 0) : low + _SLICE].astype(np.uint32)
        code = own.copy()
        code[1:] += own[:-1] << np.uint32(8)
        code[2:] += own[:-2] << np.uint32(16)
        code = (code * np.uint32(0x9E3779B1)) >> np.uint32(18)
        out[low : low + _SLICE] = code[min(low, 2) :].astype(np.int32)
    return out


def _bags(column: pa.Array) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """Number of texts, and per family of n-grams: the first one of each text, and all buckets."""
    words = words_of(column, SPACED)
    n = len(words.hash)
    place = np.arange(n) - np.repeat(words.first[:-1], words.counts)
    pairs = words.hash.copy()
    pairs[1:] = mix(words.hash[:-1] * np.uint64(3) + words.hash[1:])
    pairs[place == 0] = words.hash[place == 0]
    both = np.empty(2 * n, np.int64)
    both[0::2] = words.hash & np.uint64(BUCKETS - 1)
    both[1::2] = pairs & np.uint64(BUCKETS - 1)
    back = np.zeros(n, np.int64)
    for k in range(BACK, 0, -1):
        same = np.zeros(n, bool)
        same[k:] = words.hash[k:] == words.hash[:-k]
        back[same & (place >= k)] = k
    return len(column), [(words.first * 2, both), (words.at, _triples(words.data)), (words.first, back)]


@dataclass
class Model:
    """Log ratio of target to raw by bucket, for each family, and the weights of the log-odds."""

    ratios: list[np.ndarray]
    weights: np.ndarray

    def features(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(log ratio of the whole text, mean log ratio of each family) per text."""
        texts, bags = _bags(column)
        total, means = np.zeros(texts), np.zeros((texts, len(bags)))
        for i, (first, buckets) in enumerate(bags):
            run = np.concatenate([[0.0], np.cumsum(self.ratios[i][buckets])])
            own = run[first[1:]] - run[first[:-1]]
            total += own
            means[:, i] = own / np.maximum(np.diff(first), 1)
        return total, means

    def odds(self, means: np.ndarray) -> np.ndarray:
        return means @ self.weights[:-1] + self.weights[-1]


def _histogram(texts: DataFrame) -> list[np.ndarray]:
    """Counts of every bucket, by family: a table whose size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(size, np.int64) for size in SIZES]
        for batch in by_bytes(batches):
            for total, (_, buckets) in zip(totals, _bags(batch.column("text"))[1]):
                total += np.bincount(buckets, minlength=len(total))
        for family, total in enumerate(totals):
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), family)), pa.array(found), pa.array(total[found])], ["family", "bucket", "n"]
            )

    counts = texts.select("text").mapInArrow(run, "family long, bucket long, n long")
    found = counts.groupBy("family", "bucket").agg(F.sum("n").alias("n")).toPandas()
    out = []
    for family, size in enumerate(SIZES):
        own = found[found["family"] == family]
        total = np.zeros(size)
        total[own["bucket"].to_numpy(int)] = own["n"].to_numpy(float)
        out.append(total)
    return out


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    target: int = 12000, calibration: int = 4000, seed: int = 11,
) -> Model:
    """Raw model from every document, target model from at most `target` documents labelled 1.

    A third of the labelled ids, by a hash, is set aside to calibrate the log-odds (at most
    `calibration` of each label). Without labels of both kinds the log-odds are the sum of the
    mean ratios, and without a target every ratio is 0 and every document is kept.
    """
    prepare(docs.sparkSession)
    aside = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(3)) == 0
    raw = _histogram(docs.select(F.col(text_col).alias("text")))
    good = bounded_sample(labels.where(~aside & (F.col(label_col) == 1)), label_col, id_col, target, seed)
    wanted = _histogram(with_classes(docs, good, id_col, text_col))
    ratios = []
    for a, b in zip(wanted, raw):
        if a.sum() == 0:
            ratios.append(np.zeros(len(a)))
        else:
            ratios.append(np.log((a + 1) / (a.sum() + len(a))) - np.log((b + 1) / (b.sum() + len(b))))
    model = Model(ratios, np.array([1.0] * len(SIZES) + [0.0]))
    held = bounded_sample(labels.where(aside), label_col, id_col, calibration, seed)
    x, y = _calibration(with_classes(docs, held, id_col, text_col), model)
    if 0 < y.sum() < len(y) and any(r.any() for r in ratios):
        model.weights = logistic(x, y)
    return model


def _calibration(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    shared = sample.sparkSession.sparkContext.broadcast(vars(model))
    names = ["class", *(f"x{i}" for i in range(len(SIZES)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            _, means = Model(**shared.value).features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("class").cast(pa.int64()), *(pa.array(c) for c in means.T)], names)

    schema = ", ".join(f"{n} {'long' if n == 'class' else 'double'}" for n in names)
    found = sample.select("class", "text").mapInArrow(run, schema).toPandas()
    return found[names[1:]].to_numpy(float), found["class"].to_numpy(float)


def _gumbel(hashes: np.ndarray) -> np.ndarray:
    """Gumbel noise from 64-bit hashes: the same id draws the same noise in every run."""
    uniform = ((hashes.astype(np.uint64) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
    return -np.log(-np.log(uniform))


def _keys(batch: pa.RecordBatch, model: Model, temperature: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    total, means = model.features(batch.column("text"))
    odds = model.odds(means)
    noise = _gumbel(mix(batch.column("draw").to_numpy(zero_copy_only=False).view(np.uint64)))
    return total, odds, odds + temperature * noise


def weigh(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", temperature: float = 0.1, seed: int = 11,
) -> DataFrame:
    """(id, log_ratio, log_odds, key) of every document: the log of its importance and its Gumbel key."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            found = _keys(batch, Model(**shared.value), temperature)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, found)], ["id", "log_ratio", "log_odds", "key"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("draw"))
    schema = f"id {dict(docs.dtypes)[id_col]}, log_ratio double, log_odds double, key double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def cut(keys: DataFrame, k: int, bins: int = 4096, few: int = 10000) -> float:
    """The k-th highest key, exactly, from histograms that narrow the range; no row is sorted globally.

    Each round counts at most `bins` bins; the last collects at most `few` keys. Infinity if
    k is 0, minus infinity if there are no more than k rows.
    """
    low, high, rows = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k <= 0:
        return float("inf")
    if k >= rows:
        return float("-inf")
    above = 0
    while rows > few and high > low:
        width = (high - low) / bins
        inside = keys.where(F.col("key").between(low, high))
        number = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1))
        # The bins' own extremes, not computed edges, bound the next round.
        found = inside.groupBy(number.alias("bin")).agg(F.count("key").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for _, n, bottom, top in sorted(found.collect(), key=lambda r: -r[0]):
            if above + n >= k:
                low, high, rows = bottom, top, n
                break
            above += n
    if high == low:
        return low
    last = sorted((r[0] for r in keys.where(F.col("key").between(low, high)).select("key").collect()), reverse=True)
    return last[k - above - 1]


def resample(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    k: int | None = None, temperature: float = 0.1, seed: int = 11,
) -> DataFrame:
    """(id, log_ratio, log_odds, key, kept) of every document.

    kept marks the k documents with the highest keys; equal keys stand or fall together. By
    default k is the number of documents whose log-odds are positive, so that the draw has as
    many documents as look like the target, and at the default temperature chance decides only
    between documents near even odds; temperature 1 draws in proportion to the importance.
    Null texts count as empty; repeated rows draw the same key; null ids draw one noise.
    """
    model = fit(docs, labels, label_col, id_col, text_col, seed=seed)
    weights = written(weigh(docs, model, id_col, text_col, temperature, seed))
    size = weights.where(F.col("log_odds") >= 0).count() if k is None else k
    return weights.withColumn("kept", F.col("key") >= F.lit(cut(weights, size)))


def keep_sampled(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    k: int | None = None, temperature: float = 0.1, seed: int = 11,
) -> DataFrame:
    """The rows of docs, all columns, that `resample` keeps. The keys are computed again where
    the texts are, so that no text is shuffled."""
    model = fit(docs, labels, label_col, id_col, text_col, seed=seed)
    weights = written(weigh(docs, model, id_col, text_col, temperature, seed).select("log_odds", "key"))
    size = weights.where(F.col("log_odds") >= 0).count() if k is None else k
    least = cut(weights, size)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, names[place]):
            own = pa.RecordBatch.from_arrays([batch.column(names[place]), batch.column(len(names))], ["text", "draw"])
            _, _, key = _keys(own, Model(**shared.value), temperature)
            rows = batch.filter(pa.array(key >= least))
            yield pa.RecordBatch.from_arrays(rows.columns[: len(names)], names=names)

    names, place = docs.columns, docs.columns.index(text_col)
    rows = docs.select(*docs.columns, F.xxhash64(F.col(id_col), F.lit(seed)).alias("draw of the sample"))
    return rows.mapInArrow(run, docs.schema)
