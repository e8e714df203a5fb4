"""Numeric kernels on numpy, for what no built-in expresses: local regression, smoothing, running medians."""

from __future__ import annotations

import numpy as np

from fragspark.errors import InvalidInputError


def running(values: np.ndarray, width: int, mean: bool) -> np.ndarray:
    """The mean or median of values[i : i + width] for i in 0 .. len - width - 1; the last window has no value."""
    n = len(values) - width
    if n <= 0:
        return np.zeros(0)
    if mean:
        sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return (sums[width:-1] - sums[: -width - 1]) / width
    out = np.empty(n)
    view = np.lib.stride_tricks.sliding_window_view(values, width)
    step = max(1, (1 << 22) // width)
    for i in range(0, n, step):
        out[i : i + step] = np.median(view[i : min(i + step, n)], axis=1)
    return out


def savgol(values: np.ndarray, width: int, degree: int) -> np.ndarray:
    """Savitzky-Golay smoothing; the first and last half windows take the polynomial of the outermost window."""
    if width % 2 == 0 or degree >= width:
        raise InvalidInputError("the window must be odd and longer than the degree")
    if width > len(values):
        raise InvalidInputError("the window is longer than the data")
    half = width // 2
    at = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(at, degree + 1, increasing=True))
    out = np.empty(len(values))
    out[half : len(values) - half] = np.lib.stride_tricks.sliding_window_view(values, width) @ fit[0]
    edge = np.vander(at, degree + 1, increasing=True)
    out[:half] = (edge @ (fit @ values[:width]))[:half]
    out[len(values) - half :] = (edge @ (fit @ values[-width:]))[half + 1 :]
    return out


def loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float = 0.75, degree: int = 2) -> np.ndarray:
    """Local polynomial regression with tricube weights over the nearest ``span`` share of the points."""
    n = len(x)
    near = max(degree + 1, int(np.ceil(span * n)))
    out = np.empty(len(at))
    for i, x0 in enumerate(at):
        distance = np.abs(x - x0)
        rows = np.argpartition(distance, min(near, n) - 1)[: min(near, n)]
        reach = distance[rows].max()
        weight = (1 - np.minimum(distance[rows] / reach, 1) ** 3) ** 3 if reach > 0 else np.ones(len(rows))
        root = np.sqrt(weight)
        terms = np.vander(x[rows] - x0, degree + 1, increasing=True)
        out[i] = np.linalg.lstsq(terms * root[:, None], y[rows] * root, rcond=None)[0][0]
    return out


def adjust(positions: np.ndarray, values: np.ndarray, width: int, mean: bool, edge: int | None, smooth: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray]:
    """One interval's signal less its running mean or median: the inner positions and their values."""
    if width % 2:
        raise InvalidInputError("the running window must be even")
    if len(positions) > 1 and not (np.diff(positions) == 1).all():
        raise InvalidInputError("positions are missing or occur twice")
    if width > len(values):
        raise InvalidInputError("the running window is longer than the interval")
    if edge:
        values = values - (values[:edge].mean() + values[-edge:].mean()) / 2
    half = width // 2
    out = values[half : len(values) - half] - running(values, width, mean)
    return positions[half : len(values) - half], savgol(out, *smooth) if smooth else out
