"""Bounded samples of labelled rows, and small models fitted on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def crc_mod(id_col: str, k: int) -> Column:
    """crc32 of the id's text, modulo k; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(k))


def bounded_sample(labelled: DataFrame, class_col: str, id_col: str, per_class: int, seed: int) -> DataFrame:
    """(id, class) of about per_class ids of each class (all, if there are fewer), by a hash of the id.

    An id is taken if its hash, uniform in 0 to 1, is below per_class over the size of its
    class: the sample's size is binomial with mean per_class, whatever the input's size, and no
    class is ordered or gathered. Null ids and classes are left out; an id with several classes
    keeps the largest.
    """
    one = labelled.where(F.col(id_col).isNotNull() & F.col(class_col).isNotNull())
    one = one.groupBy(F.col(id_col).alias("id")).agg(F.max(class_col).alias("class"))
    sizes = one.groupBy("class").agg(F.count("*").alias("size"))
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # One row per class.
    return one.join(F.broadcast(sizes), "class").where(draw * F.col("size") < per_class).select("id", "class")


def with_classes(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class, text) of the sampled documents. The sample is bounded by its parameter, so it is broadcast."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(sample), "id")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights of a logistic regression (the last is the intercept), by Newton's method."""
    scale = np.abs(x).max(0) + 1e-9 if len(x) else np.ones(x.shape[1])
    x = np.c_[x / scale, np.ones(len(x))]
    weights = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - y) + ridge * weights
        curvature = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(weights))
        weights = weights - np.linalg.solve(curvature, gradient)
    return weights / np.append(scale, 1.0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
