"""Map grids, distances, neighbourhood kernels and radius schedules (all small, on the driver)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Metric = str | Callable[[np.ndarray, np.ndarray], np.ndarray]


def _sum(parts) -> np.ndarray:
    total = 0.0
    for p in parts:
        total = total + p
    return total


def distances(x: np.ndarray, y: np.ndarray, metric: Metric = "euclidean") -> np.ndarray:
    """Distances of all rows of x (n, d) to all rows of y (k, d).

    Dimensions are added one after the other, so no (n, k, d) array is made and results don't
    depend on how rows are batched. A callable gets x and y and returns the (n, k) matrix.
    """
    if callable(metric):
        return np.asarray(metric(x, y))
    if metric == "cosine":
        dot = _sum(np.outer(x[:, j], y[:, j]) for j in range(x.shape[1]))
        norms = np.outer(np.sqrt(_sum(x[:, j] ** 2 for j in range(x.shape[1]))), np.sqrt(_sum(y[:, j] ** 2 for j in range(x.shape[1]))))
        return 1.0 - dot / norms
    gaps = (x[:, j, None] - y[None, :, j] for j in range(x.shape[1]))
    if metric == "sqeuclidean":
        return _sum(g * g for g in gaps)
    if metric == "euclidean":
        return np.sqrt(_sum(g * g for g in gaps))
    if metric == "cityblock":
        return _sum(np.abs(g) for g in gaps)
    if metric == "chebyshev":
        most = np.zeros((len(x), len(y)))
        for g in gaps:
            np.maximum(most, np.abs(g), out=most)
        return most
    raise ValueError(f"unknown metric: {metric}")


def rectangular(xdim: int, ydim: int) -> np.ndarray:
    """Coordinates of xdim * ydim units from (0, 0) on, x running fastest."""
    unit = np.arange(xdim * ydim)
    return np.stack([unit % xdim, unit // xdim], axis=1).astype(float)


def dist_matrix(metric: Metric = "chebyshev") -> Callable[[np.ndarray], np.ndarray]:
    """A function from a grid (or a codebook) to its matrix of pairwise distances."""
    return lambda points: distances(points, points, metric)


def gaussian_kernel(x: np.ndarray, r: float) -> np.ndarray:
    return np.exp(-((np.asarray(x) / r) ** 2) / 2) / (r * np.sqrt(2 * np.pi))


def bubble_kernel(x: np.ndarray, r: float) -> np.ndarray:
    share = (np.asarray(x, float) / r) ** 2
    return np.sqrt(np.maximum(0.0, 1.0 - share))


def threshold_kernel(x: np.ndarray, r: float, max_ratio: float = 0.8, zero: float = 1e-6) -> np.ndarray:
    """One within the radius, nearly zero beyond; the radius is at most ``max_ratio`` of the largest value in all of x."""
    x = np.asarray(x, float)
    return zero + (x <= min(r, max_ratio * x.max()))


def scaled_time(iteration: int, epochs: int) -> float:
    return (iteration - 1) / max(epochs - 1, 1)


def linear_radius(r_start: float, r_final: float, iteration: int, epochs: int) -> float:
    t = scaled_time(iteration, epochs)
    return r_start + (r_final - r_start) * t if t < 1 else r_final


def exp_radius(steepness: float = 0.0) -> Callable[[float, float, int, int], float]:
    """A schedule that decays exponentially towards an asymptote set by ``steepness``."""

    def radius(r_start: float, r_final: float, iteration: int, epochs: int) -> float:
        if steepness < -100:
            raise ValueError("the steepness is too low; use linear_radius")
        asymptote = r_final * (1 - 1.1 ** (-steepness))
        above, below = r_start - asymptote, r_final - asymptote
        if r_start <= 0 or r_final <= 0 or above <= 0:
            raise ValueError("radii must be positive (or the steepness is too high)")
        return asymptote + above * (below / above) ** scaled_time(iteration, epochs)

    return radius
