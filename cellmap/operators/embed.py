"""Landmark-based two-dimensional projection of rows by a trained map."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Metric
from .som import CELLS, Som, k_nearest, matrix


def scores(gaps: np.ndarray, k: int, boost: float, m: float) -> np.ndarray:
    """Weight of each of the k nearest units, from the sorted distances (n, k or k + 1) of every row.

    Distances are standardised by their mean and deviation under weights 1, 1/2, 1/3, ...; with
    one distance more than k, weights fall to zero towards it.
    """
    nk = gaps.shape[1]
    w = 1.0 / np.arange(1, nk + 1)
    mean = (gaps * w).sum(axis=1) / w.sum()
    sdev = boost / np.sqrt((gaps * gaps * w).sum(axis=1) / w.sum() - mean * mean)
    near = gaps[:, :k]
    s = np.exp((mean[:, None] - near) * sdev[:, None])
    if k < nk:
        s = s * (1.0 - np.exp(near * (m / gaps[:, -1])[:, None] - m))
    return s


def project(x: np.ndarray, codes: np.ndarray, grid: np.ndarray, k: int, adjust: float, boost: float, m: float, metric: Metric, edge: str) -> np.ndarray:
    """Coordinates (n, 2): the least-squares point for what all pairs of near units say about each row.

    Rows are worked on together; the loop is over pairs of neighbour ranks. ``edge`` is how the
    line between two codes is measured: ``product`` (of their coordinates) or ``difference``.
    """
    nk = min(k + 1, len(codes))
    ids, gaps = k_nearest(x, codes, nk, metric)
    s = scores(gaps, k, boost, m)
    a, b, c, p, q = (np.zeros(len(x)) for _ in range(5))  # a x + b y = p; b x + c y = q
    at = [grid[ids[:, i]] for i in range(k)]
    code = [codes[ids[:, i]] for i in range(k)]
    for i in range(k):
        pull = 1e-9 * s[:, i]
        a += pull
        c += pull
        p += pull * at[i][:, 0]
        q += pull * at[i][:, 1]
        from_i = x - code[i]
        for j in range(i + 1, k):
            line = code[i] * code[j] if edge == "product" else code[j] - code[i]
            along, square = (line * from_i).sum(axis=1), (line * line).sum(axis=1)
            use = (along == 0) | (square != 0)
            place = np.divide(along, square, out=along.copy(), where=(along != 0) & (square != 0))
            h = at[j] - at[i]
            far = (h * h).sum(axis=1)
            weight = np.where(use, s[:, i] * s[:, j] * (1.0 + far) ** -adjust * np.exp(-((place - 0.5) ** 2)), 0.0)
            pull, target = weight / far, weight * (place + (h * at[i]).sum(axis=1) / far)
            a += h[:, 0] * h[:, 0] * pull
            b += h[:, 0] * h[:, 1] * pull
            c += h[:, 1] * h[:, 1] * pull
            p += h[:, 0] * target
            q += h[:, 1] * target
    det = a * c - b * b
    return np.stack([(p * c - b * q) / det, (a * q - b * p) / det], axis=1)


def embed_som(
    som: Som,
    df: DataFrame,
    cols: list[str] | None = None,
    keep: list[str] | None = None,
    k: int = 0,
    adjust: float = 1.0,
    smooth: float = 0.0,
    m: float = 10.0,
    metric: Metric = "euclidean",
    edge: str = "product",
) -> DataFrame:
    """Add ``x1`` and ``x2``. ``k`` of zero stands for 1 + sqrt(units), rounded down; it is at most the number of units.

    Rows whose near units all have one distance, or that give a singular system, get NaN.
    """
    cols, keep = list(cols or som.cols), list(df.columns if keep is None else keep)
    if som.codes.shape[1] != len(cols):
        raise ValueError("the map has another number of dimensions than the data")
    if edge not in ("product", "difference"):
        raise ValueError(f"unknown edge: {edge}")
    k = min(k or math.floor(1 + math.sqrt(som.n_codes)), som.n_codes)
    codes, grid, boost = som.codes, som.grid, math.exp(-smooth - 1)
    kept = df.select(*keep, *[F.col(c).cast("double").alias(f"__{j}") for j, c in enumerate(cols)])
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[: len(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // max(len(codes), k * len(cols)))
        for batch in batches:
            x = matrix(batch, [f"__{j}" for j in range(len(cols))])
            with np.errstate(all="ignore"):
                parts = [project(x[at : at + step], codes, grid, k, adjust, boost, m, metric, edge) for at in range(0, len(x), step)]
            e = np.concatenate(parts) if parts else np.zeros((0, 2))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(e[:, 0]), pa.array(e[:, 1])], names=[*keep, "x1", "x2"])

    return kept.mapInArrow(run, schema + "x1 double, x2 double")
