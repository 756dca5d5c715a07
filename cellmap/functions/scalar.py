"""Scalar transforms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def asinh(x: Column, cofactor: float = 5.0) -> Column:
    """Inverse hyperbolic sine of x / cofactor.

    Spark's built-in loses all digits for large negative and small values; this form is odd
    by construction and good to about one unit in the last place while the square of the
    value is finite (to 1e154).
    """
    v = F.abs(x / F.lit(float(cofactor)))
    return F.signum(x) * F.log1p(v + v * v / (F.lit(1.0) + F.sqrt(F.lit(1.0) + v * v)))


def z_score(x: Column, mean: float, sdev: float) -> Column:
    """(x - mean) / sdev; a column that doesn't vary is only centred."""
    return (x - F.lit(float(mean))) / F.lit(float(sdev) if sdev else 1.0)


def lookup(index: Column, values: list) -> Column:
    """Entry of ``values`` at a 1-based index, such as a metacluster of each map unit; null outside."""
    table = F.array(*[F.lit(v) for v in values])
    return F.when((index >= 1) & (index <= len(values)), F.element_at(table, index.cast("int")))
