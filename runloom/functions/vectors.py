"""Small array expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v
    )


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def weighted_sum(weights: str, terms: list[Column]) -> Column:
    """Sum of weights[i] * term_i as one plain expression, which Spark compiles."""
    total = F.lit(0.0)
    for i, term in enumerate(terms):
        total = total + F.get(weights, F.lit(i)) * term
    return total


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def doubles(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def frobenius(values: Column) -> Column:
    """Norm of all grouped values (an aggregate)."""
    return F.sqrt(F.sum(values * values))


def linspace(lower, upper, count: int) -> Column:
    """``count`` equally spaced doubles from lower to upper as an array."""
    steps = F.sequence(F.lit(0), F.lit(count - 1))
    return F.transform(steps, lambda i: lower + (upper - lower) * i / F.lit(float(max(1, count - 1))))
