"""SQL surface: transforms as temporary SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.som import Som

FUNCTIONS = {
    "stable_asinh": "(x DOUBLE, cofactor DOUBLE) RETURNS DOUBLE RETURN signum(x) * log1p(abs(x / cofactor) + (x / cofactor) * (x / cofactor) / (1 + sqrt(1 + (x / cofactor) * (x / cofactor))))",
    "z_score": "(x DOUBLE, mean DOUBLE, sdev DOUBLE) RETURNS DOUBLE RETURN (x - mean) / CASE WHEN sdev = 0 THEN 1 ELSE sdev END",
    "gaussian_kernel": "(x DOUBLE, r DOUBLE) RETURNS DOUBLE RETURN exp(-(x / r) * (x / r) / 2) / (r * sqrt(2 * pi()))",
    "bubble_kernel": "(x DOUBLE, r DOUBLE) RETURNS DOUBLE RETURN sqrt(greatest(0D, 1 - (x / r) * (x / r)))",
}


def register(spark: SparkSession) -> None:
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")


def register_map(spark: SparkSession, som: Som, view: str = "codebook") -> DataFrame:
    """The map's codebook as a view: id, gx, gy, code."""
    frame = som.frame(spark)
    frame.createOrReplaceTempView(view)
    return frame
