"""Data preparation: selection, transforms and scaling of a matrix in a DataFrame.

A matrix is a DataFrame with one double column per dimension, or one array column. Every
function returns a new DataFrame; columns that aren't named stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import asinh, lookup, z_score
from .stats import dstat


def spread(df: DataFrame, array_col: str, names: list[str]) -> DataFrame:
    """One double column per array element, in place of the array."""
    return df.select(*[c for c in df.columns if c != array_col], *[F.get(F.col(array_col), F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])


def gather(df: DataFrame, cols: list[str], name: str = "features") -> DataFrame:
    """One array column in place of ``cols``."""
    return df.select(*[c for c in df.columns if c not in cols], F.array(*[F.col(c).cast("double") for c in cols]).alias(name))


def dselect(df: DataFrame, cols: list[str] | list[int], keep: list[str] | None = None) -> DataFrame:
    """Columns by name or 1-based place, in the order asked for; with ``keep``, ``cols`` first renames all columns."""
    if keep is not None:
        df, cols = df.toDF(*cols), keep
    return df.select(*[df.columns[c - 1] if isinstance(c, int) else c for c in cols])


def dapply_cols(df: DataFrame, f: Callable[[Column, int], Column], cols: list[str]) -> DataFrame:
    """Replace each column by f(column, place in ``cols``)."""
    return df.withColumns({c: f(F.col(c), i) for i, c in enumerate(cols)})


def dtransform_asinh(df: DataFrame, cols: list[str], cofactor: float = 5.0) -> DataFrame:
    return dapply_cols(df, lambda v, _: asinh(v, cofactor), cols)


def dscale(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean 0 and population standard deviation 1: one aggregation, then a projection."""
    means, sdevs = dstat(df, cols)
    return dapply_cols(df, lambda v, i: z_score(v, means[i], sdevs[i]), cols)


def dtransform(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Map parts of the data to a new data set by a function of Arrow batches."""
    return df.mapInArrow(f, schema)


def relabel(df: DataFrame, index_col: str, labels: list, name: str) -> DataFrame:
    """Add the label of each row's 1-based index."""
    return df.withColumn(name, lookup(F.col(index_col), labels))


def check_no_nulls(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fail on the first null in ``cols``; a matrix holds numbers only."""
    def whole(c: str) -> Column:
        return F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null in {c}")).cast("double")).otherwise(F.col(c))

    return df.withColumns({c: whole(c) for c in cols})
