"""Vector math on ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the hybrid ranking.
SEMANTIC_WEIGHT = 0.5
SEMANTIC_SCALE = 12.0
SEMANTIC_MIN_COSINE = 0.2


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def normalize_vector(vector: Column) -> Column:
    """Unit length; non-finite entries count as 0, near-zero vectors become zeros."""
    finite = F.transform(
        vector,
        lambda v: F.when(
            v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)
        ).otherwise(v.cast("double")),
    )
    norm = F.sqrt(_sum(F.transform(finite, lambda v: v * v)))
    return F.when(norm < 1e-10, F.transform(finite, lambda v: F.lit(0.0))).otherwise(
        F.transform(finite, lambda v: v / norm)
    )


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for empty vectors, unequal lengths and zero norms."""
    dot = _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    square = lambda v: _sum(F.transform(v, lambda x: x.cast("double") * x.cast("double")))
    norm = F.sqrt(square(a)) * F.sqrt(square(b))
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (norm > 0)
    return F.when(usable, dot / norm).otherwise(F.lit(0.0))


def fuse_scores(lexical: Column, cosine: Column, weight: float = SEMANTIC_WEIGHT) -> Column:
    return lexical + F.lit(weight * SEMANTIC_SCALE) * F.greatest(cosine, F.lit(0.0))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)
