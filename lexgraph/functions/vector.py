"""Vector column functions over ``array<float|double>`` columns, in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either vector is all zeros (no ANSI error)."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def angle(cos) -> Column:
    """Angle from a cosine, clamped so rounding noise never gives NaN."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _c(cos))))


def l2(a, b) -> Column:
    d = F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(_sum(d))


def rbf(a, b, gamma: float = 1.0) -> Column:
    d = l2(a, b)
    return F.exp(-F.lit(float(gamma)) * d * d)


def normalize(a) -> Column:
    """Unit-length copy in double; the zero vector stays zero."""
    n = norm(a)
    return F.transform(_c(a), lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))
