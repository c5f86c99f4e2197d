"""Vector functions as Spark columns; all arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import col


def double(v: str | Column) -> Column:
    return col(v).cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(double(a), double(b), lambda x, y: x * y))


def norm(a: str | Column) -> Column:
    return F.sqrt(_sum(F.transform(double(a), lambda x: x * x)))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine; 0 where the lengths differ or a norm is 0."""
    bottom = norm(a) * norm(b)
    return F.when((F.size(col(a)) == F.size(col(b))) & (bottom > 0), dot(a, b) / F.when(bottom > 0, bottom)).otherwise(0.0)


def prefix_cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of the common prefix of two vectors."""
    n = F.least(F.size(col(a)), F.size(col(b)))
    return cosine(F.slice(col(a), 1, n), F.slice(col(b), 1, n))


def l2(a: str | Column, b: str | Column) -> Column:
    """Euclidean distance over the common prefix."""
    n = F.least(F.size(col(a)), F.size(col(b)))
    return F.sqrt(_sum(F.zip_with(F.slice(double(a), 1, n), F.slice(double(b), 1, n), lambda x, y: (x - y) * (x - y))))


def normalize(a: str | Column) -> Column:
    """Unit vector; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(double(a), lambda x: x / n)).otherwise(double(a))


def combine(parts: list[tuple[float, Column]]) -> Column:
    """Weighted sum of vectors; null ones are left out."""
    out = None
    for weight, v in parts:
        scaled = F.transform(double(v), lambda x, w=weight: x * F.lit(w))
        out = scaled if out is None else F.when(v.isNull(), out).otherwise(F.zip_with(out, scaled, lambda x, y: x + y))
    return out
