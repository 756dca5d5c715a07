"""Statistics: global, per bucket, counts, and generic map and reduce."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Bins that an exact median counts values in, and values of a group that may be kept in one place.
BINS, FEW = 1 << 14, 1 << 16


def stat_columns(cols: list[str]) -> list[Column]:
    return [e for c in cols for e in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_sdev"))]


def dstat_frame(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: ``<c>_mean`` and ``<c>_sdev`` (population) of each column."""
    return df.agg(*stat_columns(cols))


def dstat(df: DataFrame, cols: list[str]) -> tuple[list[float], list[float]]:
    """Means and population standard deviations."""
    r = dstat_frame(df, cols).first()
    return [r[f"{c}_mean"] for c in cols], [r[f"{c}_sdev"] for c in cols]


def dstat_buckets(df: DataFrame, bucket: str, cols: list[str]) -> DataFrame:
    return df.groupBy(bucket).agg(*stat_columns(cols))


def medians(cols: list[str], approximate: bool = False) -> list[Column]:
    """Exact medians that keep a group's distinct values in one buffer, or within one part in ten thousand of the rank in bounded memory."""
    return [(F.percentile_approx(c, 0.5, 10_000) if approximate else F.percentile(c, F.lit(0.5))).alias(f"{c}_median") for c in cols]


def dmedian(df: DataFrame, cols: list[str], approximate: bool = False) -> DataFrame:
    """Exact medians of numbers; nulls don't count and NaN is the largest.

    ``df`` is read several times (once to count, then mostly twice) and should give the same
    rows each time. Of a column a task passes on at most about ``BINS`` or ``FEW`` counts, never all its values.
    """
    if approximate or df.isStreaming:
        return df.agg(*medians(cols, approximate))
    return _exact_medians(df, None, cols)


def dmedian_buckets(df: DataFrame, bucket: str, cols: list[str], approximate: bool = False) -> DataFrame:
    """The same of each bucket; buckets of up to ``FEW`` values are aggregated in one go."""
    if approximate or df.isStreaming:
        return df.groupBy(bucket).agg(*medians(cols, approximate))
    return _exact_medians(df, bucket, cols)


@dataclass
class _Range:
    """Where the median of a column of one group lies: values ``lo`` to ``hi``, the ranks of the middle one or two among them."""

    group: int
    col: int
    n: int
    low: int
    high: int
    lo: float | None
    hi: float | None

    def bounds(self, first: bool) -> tuple:
        """id aside, the fields of ``_BOUNDS``: bins are even steps of the values, or of their logarithms where these span much."""
        few = self.n <= FEW or self.lo == self.hi  # both None without finite values
        wide = not few and (self.lo <= 0 <= self.hi or max(abs(self.lo), abs(self.hi)) > 2 * min(abs(self.lo), abs(self.hi)))
        start, end = (0.0, 1.0) if few else (_log(self.lo), _log(self.hi)) if wide else (self.lo, self.hi)
        return (self.low, self.high, None if first else self.lo, None if first else self.hi, few, wide, start, end - start)


_BOUNDS = {"low": "long", "high": "long", "lo": "double", "hi": "double", "few": "boolean", "wide": "boolean", "start": "double", "span": "double"}


def _log(x: float) -> float:
    """A logarithm with a sign: grows with x over all numbers, and no number but zero is near zero."""
    return math.copysign(math.log(abs(x)) + 746.0, x) if x else 0.0


def _bin(x: Column, b: dict[str, Column]) -> Column:
    """Grows with x. Few values, infinities and NaN are bins of their own."""
    log = F.when(x == 0.0, F.lit(0.0)).otherwise(F.signum(x) * (F.ln(F.abs(x)) + F.lit(746.0)))
    step = F.floor((F.when(b["wide"], log).otherwise(x) - b["start"]) / b["span"] * F.lit(float(BINS))).cast("double")
    return F.when(b["few"] | ~(F.abs(x) < F.lit(math.inf)), x).otherwise(step)


def _exact_medians(df: DataFrame, bucket: str | None, cols: list[str]) -> DataFrame:
    """Count groups; then count the values of large ones in bins, and go on with the bin that holds the median until it holds one value."""
    keys, places = [] if bucket is None else [bucket], range(len(cols))
    plain = df.groupBy(*keys).agg(*medians(cols))
    rows = df.select(*[F.col(k).alias("g") for k in keys], *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(cols)])
    finite = [F.when(F.abs(f"x{j}") < F.lit(math.inf), F.col(f"x{j}")) for j in places]
    sizes = rows.groupBy(*(["g"] if keys else [])).agg(*[e for j in places for e in (F.count(f"x{j}").alias(f"n{j}"), F.min(finite[j]).alias(f"lo{j}"), F.max(finite[j]).alias(f"hi{j}"))])
    large = sizes.where(reduce(or_, [F.col(f"n{j}") > FEW for j in places], F.lit(False))).toArrow()  # at most one in FEW rows
    if not large.num_rows:
        return plain
    found: list[list[float | None]] = [[None] * len(cols) for _ in range(large.num_rows)]
    ranges = [
        _Range(i, j, n, (n - 1) // 2, n // 2, lo, hi)
        for j in places
        for i, (n, lo, hi) in enumerate(zip(*(large[f"{f}{j}"].to_pylist() for f in ("n", "lo", "hi")), strict=True))
        if n
    ]
    groups, first = (large.select(["g"]) if keys else None), True
    while ranges:
        ranges, first = _narrowed(_counted(rows, groups, ranges, first), ranges, found), False
    if groups is None:
        return df.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(m) for v, m in zip(found[0], plain.columns, strict=True)])
    values = {f"m{j}": (pa.array([f[j] for f in found], pa.float64()), "double") for j in places}
    done = _beside(rows, groups, values).toDF(*plain.columns)
    small = df.join(F.broadcast(_beside(rows, groups, {}).toDF("__large")), F.col(bucket).eqNullSafe(F.col("__large")), "left_anti")
    return small.groupBy(bucket).agg(*medians(cols)).union(done)


def _beside(rows: DataFrame, groups: pa.Table, values: dict[str, tuple[pa.Array, str]]) -> DataFrame:
    """Groups and further columns of the given types as a DataFrame."""
    kind = StructType([StructField("g", rows.schema["g"].dataType)])
    for name, (column, of) in values.items():
        groups, kind = groups.append_column(name, column), kind.add(name, of)
    return rows.sparkSession.createDataFrame(groups, kind)


def _counted(rows: DataFrame, groups: pa.Table | None, ranges: list[_Range], first: bool) -> DataFrame:
    """The bins that hold the middle ranks of each range: ``id``, rows ``before`` it and in it, its least and greatest value."""
    cols, kinds = sorted({r.col for r in ranges}), {"id": "integer", **_BOUNDS}
    bounds = {(r.group, r.col): (i, *r.bounds(first)) for i, r in enumerate(ranges)}
    if groups is None:
        b = {j: {f: F.lit(v).cast(kinds[f]) for f, v in zip(kinds, bounds[0, j], strict=True)} for j in cols}
    else:
        b = {j: {f: F.col(f"{f}{j}") for f in kinds} for j in cols}
        some, none, arrow = sorted({r.group for r in ranges}), (None,) * len(kinds), {"integer": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        values = {f"{f}{j}": (pa.array([bounds.get((i, j), none)[at] for i in some], arrow[of]), of) for j in cols for at, (f, of) in enumerate(kinds.items())}
        state = _beside(rows, groups.take(pa.array(some)), values).withColumnRenamed("g", "__g")
        rows = rows.join(F.broadcast(state), F.col("g").eqNullSafe(F.col("__g")))
    x = {j: F.col(f"x{j}") for j in cols}
    within = {j: x[j].isNotNull() & b[j]["id"].isNotNull() if first else (x[j] >= b[j]["lo"]) & (x[j] <= b[j]["hi"]) for j in cols}
    each = [F.struct(*[b[j][f].alias(f) for f in ("id", "low", "high")], x[j].alias("x"), F.when(within[j], _bin(x[j], b[j])).alias("bin")) for j in cols]
    long = rows.where(reduce(or_, within.values())).select(F.inline(F.array(*each))).where("bin IS NOT NULL")
    counts = long.groupBy("id", "low", "high", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("before", before).where("before <= high AND low < before + n").select("id", "before", "n", "lo", "hi")


def _narrowed(counts: DataFrame, ranges: list[_Range], found: list[list[float | None]]) -> list[_Range]:
    """Put medians that are known into ``found``; the narrower ranges of the others."""
    bins: dict[int, list] = {}
    for r in sorted(counts.collect(), key=lambda r: r["before"]):
        bins.setdefault(r["id"], []).append(r)
    left = []
    for i, r in enumerate(ranges):
        if i not in bins:
            raise RuntimeError("the rows changed while their medians were sought")
        a, z = bins[i][0], bins[i][-1]
        if a is z and not (a["lo"] == a["hi"] or math.isnan(a["hi"])):
            left.append(_Range(r.group, r.col, a["n"], r.low - a["before"], r.high - a["before"], a["lo"], a["hi"]))
            continue
        lower, upper = a["hi"], z["lo"]  # of two bins the last and the first value
        found[r.group][r.col] = lower if lower == upper else 0.5 * lower + 0.5 * upper
    return left


def bucket_means(df: DataFrame, bucket: str, cols: list[str]) -> DataFrame:
    return df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in cols])


def _ids(df: DataFrame, n: int, name: str, kind: str) -> DataFrame:
    return df.sparkSession.range(1, n + 1).select(F.col("id").cast(kind).alias(name))


def dcount(df: DataFrame, col: str, n: int) -> DataFrame:
    """Rows of each identifier 1 to n, those without rows included: ``<col>``, ``n``."""
    found = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return _ids(df, n, col, df.schema[col].dataType.simpleString()).join(found, col, "left").select(col, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def dcount_buckets(df: DataFrame, col: str, n: int, bucket: str, n_buckets: int) -> DataFrame:
    """The whole contingency table of buckets 1 to n_buckets and identifiers 1 to n, in long form."""
    found = df.groupBy(bucket, col).agg(F.count(F.lit(1)).alias("n"))
    kinds = {c: df.schema[c].dataType.simpleString() for c in (col, bucket)}
    both = _ids(df, n_buckets, bucket, kinds[bucket]).crossJoin(F.broadcast(_ids(df, n, col, kinds[col])))
    return both.join(found, [bucket, col], "left").select(bucket, col, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def map_buckets(df: DataFrame, bucket: str, cols: list[str], f: Callable[[Column], Column], name: str = "value") -> DataFrame:
    """An aggregate expression per bucket and column: ``<bucket>``, ``<c>_<name>``."""
    return df.groupBy(bucket).agg(*[f(F.col(c)).alias(f"{c}_{name}") for c in cols])


def cat_map_buckets(df: DataFrame, bucket: str, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Any function of one bucket's rows, results one below the other. A bucket must fit in one task; prefer ``map_buckets``."""
    return df.groupBy(bucket).applyInPandas(f, schema)


def dmapreduce(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Any], reduce: Callable[[Any, Any], Any], depth: int = 2) -> Any:
    """Fold f of every part with an associative function, in a tree so that the driver gets few values."""
    import pickle

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(f(batches))], pa.binary())], names=["v"])

    def fold(rows: Iterator) -> Iterator:
        total, empty = None, True
        for r in rows:
            v = pickle.loads(r["v"])
            total, empty = (v, False) if empty else (reduce(total, v), False)
        if not empty:
            yield total

    values = df.mapInArrow(part, "v binary").rdd.mapPartitions(fold)
    return values.treeReduce(reduce, depth)


def part_sizes(df: DataFrame) -> DataFrame:
    """Rows of each partition: ``part``, ``n``."""
    return df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))


def global_means(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[(F.sum(c) / F.count(c)).alias(f"{c}_mean") for c in cols])
