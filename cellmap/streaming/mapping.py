"""A trained map on streams: mapping and projection are stateless, counts are windowed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.embed import embed_som
from ..operators.som import Som, map_to_som


def map_stream(som: Som, stream: DataFrame, cols: list[str] | None = None, **options) -> DataFrame:
    """The nearest unit of every row of a stream."""
    return map_to_som(som, stream, cols, **options)


def embed_stream(som: Som, stream: DataFrame, cols: list[str] | None = None, **options) -> DataFrame:
    return embed_som(som, stream, cols, **options)


def cluster_counts(mapped: DataFrame, time_col: str, window: str = "10 minutes", late: str = "10 minutes", index_col: str = "index") -> DataFrame:
    """Rows of each unit in tumbling windows; rows later than ``late`` are dropped, and their state with them."""
    return (
        mapped.withWatermark(time_col, late)
        .groupBy(F.window(time_col, window).alias("window"), index_col)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), index_col, "n")
    )
