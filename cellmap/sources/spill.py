"""Spillover matrices and compensation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keywords that may hold the matrix, in order of preference.
SPILL_KEYWORDS = ["$SPILL", "$SPILLOVER", "SPILL", "SPILLOVER"]


def parse_spillover(text: str) -> tuple[list[str], np.ndarray]:
    """``n,name1,..,namen,v11,v12,..``: names and the n x n matrix, row by row."""
    fields = text.split(",")
    n = int(fields[0])
    if len(fields) != 1 + n + n * n:
        raise ValueError("the spillover keyword has the wrong number of fields")
    return [x.strip() for x in fields[1 : n + 1]], np.array(fields[n + 1 :], float).reshape(n, n)


def find_spillover(keywords: dict[str, str]) -> tuple[list[str], np.ndarray] | None:
    return next((parse_spillover(keywords[k]) for k in SPILL_KEYWORDS if k in keywords), None)


def compensate(df: DataFrame, spillover: np.ndarray, cols: list[str]) -> DataFrame:
    """Multiply the columns by the inverse of the matrix: a projection of linear combinations."""
    inverse = np.linalg.inv(spillover)

    def combined(j: int):
        total = F.col(cols[0]) * F.lit(float(inverse[0, j]))
        for i in range(1, len(cols)):
            total = total + F.col(cols[i]) * F.lit(float(inverse[i, j]))
        return total

    return df.withColumns({c: combined(j) for j, c in enumerate(cols)})
