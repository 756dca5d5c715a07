"""Batch self-organising maps: initialisation, training, and mapping rows to their nearest unit."""

from __future__ import annotations

import base64
import warnings
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import Metric, dist_matrix, distances, exp_radius, gaussian_kernel, rectangular
from .stats import dstat

#: Distances that a task holds at once: rows times units.
CELLS = 1 << 20


@dataclass(frozen=True)
class Som:
    """A map: one code vector per unit, units numbered from 1 with x running fastest."""

    codes: np.ndarray
    xdim: int
    ydim: int
    grid: np.ndarray
    cols: tuple[str, ...] = ()

    @property
    def n_codes(self) -> int:
        return self.xdim * self.ydim

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i + 1, float(g[0]), float(g[1]), [float(v) for v in c]) for i, (g, c) in enumerate(zip(self.grid, self.codes, strict=True))]
        return spark.createDataFrame(rows, "id int, gx double, gy double, code array<double>")

    def save(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, cols: tuple[str, ...] = ()) -> Som:
        rows = spark.read.parquet(path).orderBy("id").collect()
        grid = np.array([[r["gx"], r["gy"]] for r in rows])
        return cls(np.array([r["code"] for r in rows]), int(grid[:, 0].max()) + 1, int(grid[:, 1].max()) + 1, grid, cols)


def init_som_from_stats(means: list[float], sdevs: list[float], xdim: int, ydim: int | None = None, seed: int | None = None, rng: np.random.Generator | None = None, cols: tuple[str, ...] = ()) -> Som:
    """Normal random codes with the given means and deviations, drawn unit by unit."""
    ydim = xdim if ydim is None else ydim
    rng = rng or np.random.default_rng(seed)
    noise = rng.standard_normal((xdim * ydim, len(means)))
    return Som(noise * np.asarray(sdevs, float) + np.asarray(means, float), xdim, ydim, rectangular(xdim, ydim), tuple(cols))


def init_som(df: DataFrame, cols: list[str], xdim: int, ydim: int | None = None, seed: int | None = None, rng: np.random.Generator | None = None) -> Som:
    means, sdevs = dstat(df, cols)
    return init_som_from_stats(means, sdevs, xdim, ydim, seed, rng, tuple(cols))


def matrix(batch: pa.RecordBatch, cols: list[str]) -> np.ndarray:
    """Rows of a batch as (n, d); nulls are refused."""
    out = np.empty((batch.num_rows, len(cols)))
    for j, c in enumerate(cols):
        column = batch.column(c)
        if column.null_count:
            raise ValueError(f"null in {c}")
        out[:, j] = column.to_numpy(zero_copy_only=False)
    return out


def chunks(x: np.ndarray, k: int) -> Iterator[np.ndarray]:
    step = max(1, CELLS // max(1, k))
    for at in range(0, len(x), step):
        yield x[at : at + step]


def nearest(x: np.ndarray, codes: np.ndarray, metric: Metric) -> np.ndarray:
    """0-based nearest unit of each row; of equal ones the lowest."""
    if metric in ("euclidean", "sqeuclidean"):
        return _nearest_by_product(x, codes, metric)
    parts = [distances(c, codes, metric).argmin(axis=1) for c in chunks(x, len(codes))]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _nearest_by_product(x: np.ndarray, codes: np.ndarray, metric: Metric) -> np.ndarray:
    """The same units from one matrix product, with distances only for rows that its rounding leaves in doubt.

    Of a row and all units, |c|^2 / 2 - x c orders the units as the distances do. Rounding moves it and half the
    squared distances by less than 4 d + 24 times epsilon times (|x|^2 + |c|^2), square roots that become equal
    included; a row with one unit within ``slack`` of the least is settled. Overflow and NaN leave a row in doubt.
    """
    k, d = codes.shape
    with np.errstate(over="ignore", invalid="ignore"):
        middle = codes.mean(axis=0)
        shifted = codes - middle
        half = (shifted * shifted).sum(axis=1)[:, None] / 2
        most, share = 2 * half.max(), 16 * (d + 8) * np.finfo(float).eps
        ids = np.arange(k, dtype=np.min_scalar_type(k))[:, None]
        unit = np.empty(len(x), np.int64)
        step = max(64, min(1 << 16, (1 << 18) // max(1, d)) // k)  # arrays that stay in cache, products too small for threads
        for at in range(0, len(x), step):
            rows = x[at : at + step]
            y = rows - middle
            gaps = shifted @ y.T
            np.subtract(half, gaps, out=gaps)
            slack = share * (np.einsum("ij,ij->i", y, y) + most) + 1e-300
            close = gaps <= gaps.min(axis=0) + slack
            unit[at : at + step] = (close * ids).sum(axis=0, dtype=ids.dtype)
            doubt = np.flatnonzero(close.sum(axis=0, dtype=ids.dtype) != 1)
            if len(doubt):
                unit[at + doubt] = distances(rows[doubt], codes, metric).argmin(axis=1)
    return unit


def _doubles(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols])


def epoch_sums(df: DataFrame, cols: list[str], codes: np.ndarray, metric: Metric = "euclidean") -> DataFrame:
    """Per unit with rows: ``id``, ``n`` and the sums ``s0``.. of its rows.

    Every task adds up its rows per unit, so that at most tasks x units rows are shuffled.
    """
    d, names = len(cols), list(cols)
    schema = "id int, n long, " + ", ".join(f"s{j} double" for j in range(d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = _unit_sums((matrix(batch, names) for batch in batches), codes, metric)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array((some + 1).astype(np.int32)), pa.array(n[some]), *(pa.array(sums[some, j]) for j in range(d))], schema=_arrow(d))

    return _doubles(df, cols).mapInArrow(run, schema).groupBy("id").agg(F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(d)])


def _arrow(d: int) -> pa.Schema:
    return pa.schema([("id", pa.int32()), ("n", pa.int64()), *((f"s{j}", pa.float64()) for j in range(d))])


def _unit_sums(parts: Iterable[np.ndarray], codes: np.ndarray, metric: Metric) -> tuple[np.ndarray, np.ndarray]:
    """Per unit the number of rows and their sums (k, d)."""
    k, d = codes.shape
    n, sums = np.zeros(k, np.int64), np.zeros((k, d))
    for x in parts:
        unit = nearest(x, codes, metric)
        n += np.bincount(unit, minlength=k)
        for j in range(d):
            sums[:, j] += np.bincount(unit, x[:, j], k)
    return n, sums


def blocks(df: DataFrame, cols: list[str]) -> RDD:
    """The matrix in parts of some thousand rows as bytes, which pass to Python without a conversion of every row.

    On their one way from Arrow to the RDD they are text: Spark pickles binary values slowly.
    """
    names, d = list(cols), len(cols)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in chunks(matrix(batch, names), d):
                yield pa.RecordBatch.from_arrays([pa.array([base64.b64encode(x.tobytes()).decode()])], names=["x"])

    return _doubles(df, cols).mapInArrow(pack, "x string").rdd.map(lambda r: base64.b64decode(r["x"]))


def block_sums(parts: RDD, codes: np.ndarray, metric: Metric = "euclidean") -> tuple[np.ndarray, np.ndarray]:
    """Rows and sums of each unit over ``blocks``, added up in a tree so that the driver gets few values."""
    k, d = codes.shape

    def run(part: Iterator[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield _unit_sums((np.frombuffer(b).reshape(-1, d) for b in part), codes, metric)

    def add(a: tuple, b: tuple) -> tuple:
        return a[0] + b[0], a[1] + b[1]

    return parts.mapPartitions(run).treeAggregate((np.zeros(k, np.int64), np.zeros((k, d))), add, add)


def train_som(
    som: Som,
    df: DataFrame,
    cols: list[str] | None = None,
    kernel: Callable[[np.ndarray, float], np.ndarray] = gaussian_kernel,
    metric: Metric = "euclidean",
    som_dist: Callable[[np.ndarray], np.ndarray] | None = None,
    r_start: float = 0.0,
    r_final: float = 0.1,
    radius: Callable[[float, float, int, int], float] | None = None,
    epochs: int = 20,
    each_epoch: Callable[[int, float, Som], None] | None = None,
    on_empty: str = "keep",
) -> Som:
    """Batch training: ``df`` is read once and kept in blocks (persisted in memory and on disk); one job an epoch over these.

    ``r_start`` of zero stands for half the sum of the map's sides. A unit that no row reaches
    through the kernel keeps its code (``on_empty="keep"``, with a warning) or becomes NaN
    (``"nan"``). ``each_epoch`` is called before training with epoch 0, and after every epoch.
    """
    cols = list(cols or som.cols)
    if som.codes.shape[1] != len(cols):
        raise ValueError("the map has another number of dimensions than the data")
    radius = radius or exp_radius(-5.0)
    r_start = (som.xdim + som.ydim) / 2 if r_start == 0.0 else r_start
    between = (som_dist or dist_matrix("chebyshev"))(som.grid)
    if each_epoch:
        each_epoch(0, r_start, som)
    codes = som.codes.copy()
    parts = blocks(df, cols)
    if epochs > 1:
        parts.persist(StorageLevel.MEMORY_AND_DISK_DESER)
    try:
        for epoch in range(1, epochs + 1):
            n, sums = block_sums(parts, codes, metric)
            now = radius(float(r_start), float(r_final), epoch, epochs)
            if now <= 0:
                raise ValueError("the radius must be positive")
            w = kernel(between, now)
            mass = w @ n
            with np.errstate(invalid="ignore", divide="ignore"):
                new = (w @ sums) / mass[:, None]
            if on_empty == "keep" and (mass == 0).any():
                warnings.warn("some units have no rows within the kernel; they keep their codes", stacklevel=2)
                new[mass == 0] = codes[mass == 0]
            codes = new
            som = replace(som, codes=codes, cols=tuple(cols))
            if each_epoch:
                each_epoch(epoch, now, som)
    finally:
        parts.unpersist()
    return som


def map_to_som(som: Som, df: DataFrame, cols: list[str] | None = None, keep: list[str] | None = None, metric: Metric = "euclidean", name: str = "index") -> DataFrame:
    """Add each row's nearest unit (1-based). ``keep``: columns to pass along, all by default."""
    cols, keep = list(cols or som.cols), list(df.columns if keep is None else keep)
    if som.codes.shape[1] != len(cols):
        raise ValueError("the map has another number of dimensions than the data")
    codes = som.codes
    kept = df.select(*keep, *[F.col(c).cast("double").alias(f"__{j}") for j, c in enumerate(cols)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = nearest(matrix(batch, [f"__{j}" for j in range(len(cols))]), codes, metric)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array((unit + 1).astype(np.int32))], names=[*keep, name])

    return kept.mapInArrow(run, f"{schema}, {name} int" if keep else f"{name} int")


def map_to_som_sql(som: Som, df: DataFrame, cols: list[str] | None = None, name: str = "index") -> DataFrame:
    """The same for the Euclidean metric in built-in expressions only: the codebook as a literal array."""
    cols = list(cols or som.cols)
    codes = F.array(*[F.struct(*[F.lit(float(v)).alias(f"c{j}") for j, v in enumerate(c)], F.lit(i + 1).alias("id")) for i, c in enumerate(som.codes)])

    def gap(code):
        total = F.lit(0.0)
        for j, c in enumerate(cols):
            total = total + (F.col(c) - code[f"c{j}"]) * (F.col(c) - code[f"c{j}"])
        return F.struct(F.sqrt(total).alias("d"), code["id"].alias("id"))

    return df.withColumn(name, F.array_min(F.transform(codes, gap))["id"])


def knn(som: Som, df: DataFrame, k: int, cols: list[str] | None = None, keep: list[str] | None = None, metric: Metric = "euclidean") -> DataFrame:
    """The k nearest units of each row, in long form: ``rank`` from 1, ``unit``, ``distance``; ties by lowest unit."""
    cols, keep = list(cols or som.cols), list(df.columns if keep is None else keep)
    codes, k = som.codes, min(k, som.n_codes)
    kept = df.select(*keep, *[F.col(c).cast("double").alias(f"__{j}") for j, c in enumerate(cols)])
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[: len(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, [f"__{j}" for j in range(len(cols))])
            found = [k_nearest(c, codes, k, metric) for c in chunks(x, len(codes))]
            if found:
                ids, gaps = (np.concatenate(y) for y in zip(*found, strict=True))
                row = np.repeat(np.arange(len(x)), k)
                left = [c.take(pa.array(row)) for c in batch.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays([*left, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array((ids.ravel() + 1).astype(np.int32)), pa.array(gaps.ravel())], names=[*keep, "rank", "unit", "distance"])

    return kept.mapInArrow(run, schema + "rank int, unit int, distance double")


def k_nearest(x: np.ndarray, codes: np.ndarray, k: int, metric: Metric) -> tuple[np.ndarray, np.ndarray]:
    """Units (0-based) and distances of the k nearest, nearest first."""
    d = distances(x, codes, metric)
    ids = np.argsort(d, axis=1, kind="stable")[:, :k]
    return ids, np.take_along_axis(d, ids, axis=1)
