"""Distances between vectors (arrays of numbers), as JVM-side columns in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str | Sequence[float]) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else literal(x)


def literal(vector: Sequence[float]) -> Column:
    """A query vector as a constant: one literal, not one expression a number."""
    return F.lit([float(v) for v in vector])


def _sum(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return _sum(_col(a), _col(b), lambda x, y: x * y)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a, b) -> Column:
    """1 - cosine similarity; null when either vector is zero, null or of another length."""
    a, b = _col(a), _col(b)
    return F.when(F.size(a) == F.size(b), 1 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)))


def l2_distance(a, b) -> Column:
    return F.sqrt(_sum(_col(a), _col(b), lambda x, y: (x - y) * (x - y)))


def l1_distance(a, b) -> Column:
    return _sum(_col(a), _col(b), lambda x, y: F.abs(x - y))


def negative_inner_product(a, b) -> Column:
    return -dot(a, b)


#: By the operator class that an index is declared with.
DISTANCES = {
    "vector_cosine_ops": cosine_distance, "vector_l2_ops": l2_distance, "vector_l1_ops": l1_distance, "vector_ip_ops": negative_inner_product,
}


def vector(text: Column | str, dimensions: int) -> Column:
    """A vector from text such as ``[1,2,3]``; raises if it has another number of dimensions."""
    v = F.from_json(_col(text), "array<float>")
    wrong = F.raise_error(F.concat(F.lit(f"expected {dimensions} dimensions, not "), F.coalesce(F.size(v), F.lit(0)).cast("string")))
    return F.when(F.size(v) == dimensions, v).otherwise(wrong.cast("array<float>"))


#: The same distances as SQL functions, which the optimiser inlines.
SQL_FUNCTIONS = {
    "ai_cosine_distance": "1 - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D)",
    "ai_l2_distance": "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
    "ai_l1_distance": "aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (s, x) -> s + x)",
    "ai_negative_inner_product": "-aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
}
