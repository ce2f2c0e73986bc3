"""Language identification with a string kernel.

The kernel of two texts counts the n-grams (1 to 4 bytes, hashed) that both contain, divided by
the geometric mean of how many each contains. A few landmark texts span a Nyström feature space
in which one-versus-rest kernel ridge regression is solved; a batch of texts is scored by one
matrix product of its presence matrix with the folded weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.samples import bounded_sample, crc_mod, with_classes
from corpusloom.llm.store import prepare
from corpusloom.llm.tokens import LOWER, buffer_of, by_bytes

ORDERS = 4
BUCKETS = 1 << 15
UNKNOWN = "und"
_ROWS = 128
_SLICE = 1 << 20


def _presence(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts by buckets: whether a text has an n-gram of the bucket. N-grams do not cross texts."""
    out = np.zeros((len(at) - 1, BUCKETS), bool)
    flat = out.reshape(-1)
    for low in range(0, len(data), _SLICE):
        start = max(low - ORDERS + 1, 0)
        own = LOWER[data[start : low + _SLICE]].astype(np.uint32) + np.uint32(1)
        row = np.searchsorted(at, np.arange(start, start + len(own)), "right") - 1
        code = np.zeros(len(own), np.uint32)
        for n in range(1, ORDERS + 1):
            # The code of the n-gram that ends at a byte, from the shorter one that ends before it.
            code[1:] = code[:-1].copy() * np.uint32(0x01000193)
            code += own
            whole = np.zeros(len(own), bool)
            whole[n - 1 :] = row[n - 1 :] == row[: len(row) - n + 1]
            bucket = ((code * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(17)
            flat[row[whole] * BUCKETS + bucket[whole].astype(np.int64)] = True
    return out


@dataclass
class Model:
    """Learned languages in order, and a weight per bucket and language."""

    langs: list[str]
    weights: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        """One value per text and language; texts are taken in blocks of a bounded size."""
        data, at = buffer_of(column)
        out = np.zeros((len(column), len(self.langs)))
        for low in range(0, len(column), _ROWS):
            high = min(low + _ROWS, len(column))
            have = _presence(data[at[low] : at[high]], at[low : high + 1] - at[low])
            size = np.sqrt(np.maximum(have.sum(1), 1))[:, None]
            out[low:high] = (have.astype(np.float32) @ self.weights) / size
        return out


def _landmark_sets(sample: DataFrame) -> np.ndarray:
    """Presence rows of the landmarks, in the order of their ids: at most BUCKETS bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            data, at = buffer_of(batch.column("text"))
            for i in range(batch.num_rows):
                have = _presence(data[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]]))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, 1), pa.array([np.packbits(have[0]).tobytes()], pa.binary())], ["id", "have"])

    found = sample.mapInArrow(run, f"id {dict(sample.dtypes)['id']}, have binary").dropDuplicates(["id"]).orderBy("id").collect()
    if not found:
        return np.zeros((0, BUCKETS), np.float32)
    return np.stack([np.unpackbits(np.frombuffer(r["have"], np.uint8)) for r in found]).astype(np.float32)


def _kernel(have: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    have = have.astype(np.float32)
    sizes = np.sqrt(np.maximum(have.sum(1), 1))[:, None] * np.sqrt(np.maximum(landmarks.sum(1), 1))[None, :]
    return (have @ landmarks.T) / sizes


def _rows_of_kernel(sample: DataFrame, landmarks: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Kernel values with the landmarks, and the language, of every training text."""
    shared = sample.sparkSession.sparkContext.broadcast(np.packbits(landmarks.astype(bool), axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(shared.value, axis=1).astype(np.float32)
        for batch in by_bytes(batches):
            data, at = buffer_of(batch.column("text"))
            for low in range(0, batch.num_rows, _ROWS):
                high = min(low + _ROWS, batch.num_rows)
                values = _kernel(_presence(data[at[low] : at[high]], at[low : high + 1] - at[low]), marks)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("class").slice(low, high - low), pa.array([v.tobytes() for v in values], pa.binary())], ["class", "row"]
                )

    found = sample.select("class", "text").mapInArrow(run, "class string, row binary").collect()
    values = [np.frombuffer(r["row"], np.float32) for r in found]
    return np.array(values, float).reshape(len(found), len(landmarks)), [r["class"] for r in found]


def fit(
    docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = 1000,
    landmarks: int = 40, ridge: float = 1e-3, seed: int = 5,
) -> Model:
    """Learn from at most per_language documents of each language, by a hash of their ids; the
    first `landmarks` of each language are the landmarks."""
    prepare(docs.sparkSession)
    labelled = docs.where(F.col(text_col).isNotNull()).select(id_col, F.col(lang_col).cast("string").alias(lang_col))
    sample = bounded_sample(labelled, lang_col, id_col, per_language, seed)
    marks = bounded_sample(labelled, lang_col, id_col, landmarks, seed)
    points = _landmark_sets(with_classes(docs, marks, id_col, text_col).select("id", "text"))
    values, names = _rows_of_kernel(with_classes(docs, sample, id_col, text_col), points)
    langs = sorted(set(names))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    wanted = np.where(np.array(names)[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    among = _kernel(points, points).astype(float)
    size, axes = np.linalg.eigh(among)
    root = axes @ np.diag(np.where(size > 1e-6, 1 / np.sqrt(np.maximum(size, 1e-6)), 0.0)) @ axes.T
    features = values @ root
    # Every language has the same say, however many rows it has.
    share = np.array([1.0 / names.count(n) for n in names])[:, None]
    solved = np.linalg.solve(features.T @ (features * share) + ridge * np.eye(features.shape[1]), features.T @ (wanted * share))
    scaled = points / np.sqrt(np.maximum(points.sum(1), 1))[:, None]
    return Model(langs, (scaled.T @ (root @ solved)).astype(np.float32))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the language with the highest value, and its share after a softmax."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**shared.value)
        for batch in by_bytes(batches):
            letters = batch.column("letters").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            lang, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            if own.langs:
                values = own.scores(batch.column("text"))
                share = np.exp(4 * (values - values.max(1, keepdims=True)))
                share /= share.sum(1, keepdims=True)
                best = values.argmax(1)
                lang = np.where(letters, np.array(own.langs, object)[best], UNKNOWN)
                score = np.where(letters, share[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(text_col).rlike(r"\p{L}").alias("letters"))
    found = rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, lang_pred string, score double")
    return found.withColumnRenamed("id", id_col)


def language(
    docs: DataFrame, held_out: Column | None = None, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
    **parameters: float,
) -> DataFrame:
    """Predict the language of every document: id, held_out, lang_pred, score (0 to 1).

    Rows for which held_out holds (by default a quarter, by crc32 of the id) are not learned
    from. `und` with score 0 for texts that are null or have no letter, or if nothing could be
    learned; of equal values the first language in order wins. Repeated rows give repeated rows.
    """
    held = crc_mod(id_col, 4) == 2 if held_out is None else held_out
    model = fit(docs.where(~held), lang_col, id_col, text_col, **parameters)
    return predict(docs, model, id_col, text_col).select(id_col, held.alias("held_out"), "lang_pred", "score")
