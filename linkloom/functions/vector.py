"""Vector expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine clipped to [-1, 1]; 0 where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(0.0)


def mean_vector(vector: str, width: int) -> list[Column]:
    """Aggregates that average a fixed-width vector column element by element, all map-side combinable."""
    return [F.avg(F.get(vector, F.lit(i))).alias(f"m{i}") for i in range(width)]
