"""CSV sets, local data, and saved data sets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def read_csv_set(spark: SparkSession, paths: str | list[str], header: bool = True, file_idx: bool = False, slices: int | None = None, **options) -> DataFrame:
    """CSV files as doubles ``x1``, ``x2``, ...; anything that isn't a number fails. Names in headers aren't kept.

    With ``file_idx``, the number of each row's file (from 1, in the order given) is a further column.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    width = len(spark.read.options(header=header, **options).csv(paths[0]).columns)
    schema = StructType([StructField(f"x{i + 1}", DoubleType()) for i in range(width)])
    df = spark.read.options(header=header, mode="FAILFAST", enforceSchema=True, **options).schema(schema).csv(paths)
    if file_idx:
        # Both spell a path as a URI, with one slash or three ahead of it.
        number = {re.sub("^(\\w+):/+", r"\1:/", f): i + 1 for i, p in enumerate(paths) for f in spark.read.text(p).inputFiles()}
        table = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])
        df = df.select("*", F.element_at(table, F.regexp_replace(F.col("_metadata.file_path"), "^(\\w+):/+", "$1:/")).cast("int").alias("file_idx"))
    return df.repartition(slices) if slices else df


def csv_size(spark: SparkSession, path: str, **options) -> tuple[int, int]:
    df = read_csv_set(spark, path, **options)
    return df.count(), len(df.columns)


def csv_sizes(spark: SparkSession, paths: list[str], **options) -> list[int]:
    """Rows of each file, in the order given; one job over all."""
    counts = {r["file_idx"]: r["count"] for r in read_csv_set(spark, paths, file_idx=True, **options).groupBy("file_idx").count().collect()}
    return [counts.get(i + 1, 0) for i in range(len(paths))]


def scatter(spark: SparkSession, data: pd.DataFrame, parts: int | None = None) -> DataFrame:
    """A local table as a DataFrame."""
    df = spark.createDataFrame(data)
    return df.repartition(parts) if parts else df


def gather_rows(df: DataFrame, free: bool = False) -> pd.DataFrame:
    """All rows on the driver; ``free`` drops what is persisted of the data set."""
    out = df.toPandas()
    if free:
        df.unpersist()
    return out


def unscatter(df: DataFrame) -> None:
    df.unpersist()


def store(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
