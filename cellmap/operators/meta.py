"""Metaclusters: average-linkage clustering of a map's codes (at most some thousand; on the driver)."""

from __future__ import annotations

import numpy as np

from ..functions.grid import Metric, distances


def average_linkage(between: np.ndarray, n_clusters: int) -> list[int]:
    """Cluster of each item, numbered from 1 in order of first members.

    The two clusters of least mean distance merge, of equal ones the first, until
    ``n_clusters`` are left.
    """
    n = len(between)
    d = np.array(between, float)
    np.fill_diagonal(d, np.inf)
    size, member = np.ones(n), np.arange(n)
    for _ in range(n - max(1, n_clusters)):
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        member[member == j] = i
    number: dict[int, int] = {}
    return [number.setdefault(int(m), len(number) + 1) for m in member]


def metaclusters(codes: np.ndarray, n_clusters: int, metric: Metric = "euclidean") -> list[int]:
    return average_linkage(distances(codes, codes, metric), n_clusters)
