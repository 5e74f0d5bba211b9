"""Vector arithmetic as Column expressions; inputs are float arrays, results are doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wide(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column | str, b: Column | str, metric: str = "cosine") -> Column:
    """Cosine (1 - cos), l2 (Euclidean) or ip (1 - dot) distance; smaller is nearer.

    Null if lengths differ, or for cosine if a vector is zero.
    """
    a, b = wide(a), wide(b)
    if metric == "cosine":
        found = 1 - F.try_divide(dot(a, b), norm(a) * norm(b))
    elif metric == "l2":
        found = F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    elif metric == "ip":
        found = 1 - dot(a, b)
    else:
        raise ValueError(f"unknown metric {metric}")
    return F.when(F.size(a) == F.size(b), found)


def mean_of(rows: Column, dims: int) -> Column:
    """Mean vector of an array of vectors."""
    zero = F.array_repeat(F.lit(0.0), dims)
    sums = F.aggregate(rows, zero, lambda acc, v: F.zip_with(acc, wide(v), lambda x, y: x + y))
    return F.transform(sums, lambda x: x / F.size(rows))


def sigmoid(z: Column | str) -> Column:
    return 1 / (1 + F.exp(-(F.col(z) if isinstance(z, str) else z)))
