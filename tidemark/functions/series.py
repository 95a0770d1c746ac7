"""The two sequential algorithms on one series, in NumPy: seasonal-trend decomposition, also of many series at once, and change points."""

from __future__ import annotations

import functools

import numpy as np


def _tricube(n: int, window: int, at: np.ndarray) -> np.ndarray:
    """Weights of the positions 0..n-1 for each of `at`: tricube over the nearest `window` points."""
    far = np.abs(at[:, None] - np.arange(n, dtype=float)[None, :])
    q = min(window, n)
    reach = np.partition(far, q - 1, axis=1)[:, q - 1]
    if window > n:
        reach = reach + (window - n) // 2
    u = far / np.maximum(reach, 1e-12)[:, None]
    return np.where(u < 1, (1 - u**3) ** 3, 0.0)


def _loess(y: np.ndarray, window: int, degree: int, at: np.ndarray, robust: np.ndarray) -> np.ndarray:
    """Locally weighted regression of y at 0..n-1, evaluated at `at`: tricube weights over the nearest `window` points."""
    x = np.arange(len(y), dtype=float)
    w = _tricube(len(y), window, at) * robust[None, :]
    total = w.sum(1)
    w = np.where(total[:, None] > 0, w / np.where(total > 0, total, 1.0)[:, None], 0.0)
    mean = (w * y).sum(1)
    if degree:
        centre = (w * x).sum(1)
        spread = (w * (x[None, :] - centre[:, None]) ** 2).sum(1)
        slope = (w * (x[None, :] - centre[:, None]) * y).sum(1)
        usable = spread > (1e-3 * (len(y) - 1)) ** 2
        mean = np.where(usable, mean + slope / np.where(usable, spread, 1.0) * (at - centre), mean)
    return np.where(total > 0, mean, y[np.clip(np.rint(at).astype(int), 0, len(y) - 1)])


def _averages(y: np.ndarray, n: int) -> np.ndarray:
    return np.convolve(y, np.full(n, 1.0 / n), "valid")


def _windows(n: int, period: int) -> tuple[int, int, int]:
    """The odd windows of season, trend and low pass for n observations."""
    if period < 2:
        raise ValueError("a period has at least two observations")
    if n < 2 * period:
        raise ValueError(f"{n} observations are fewer than two periods of {period}")
    odd = lambda v: int(v) | 1
    season_window = max(7, odd(n))
    return season_window, odd(np.ceil(1.5 * period / (1 - 1.5 / season_window))), odd(period + 1)


def stl(y: np.ndarray, period: int = 12, outer: int = 15, inner: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """trend, seasonal and remainder, which add up to y (Cleveland et al., 1990), with robustness weights.

    The seasonal window is the odd number at or above the length (7 at least) and locally constant, so the
    season is nearly fixed. Needs two whole periods.
    """
    n = len(y)
    season_window, trend_window, low_window = _windows(n, period)
    y, t = np.asarray(y, float), np.arange(n, dtype=float)
    trend, seasonal, robust = np.zeros(n), np.zeros(n), np.ones(n)
    for _ in range(outer + 1):
        for _ in range(inner):
            cycle = np.empty(n + 2 * period)
            for k in range(period):
                part = (y - trend)[k::period]
                cycle[k::period] = _loess(part, season_window, 0, np.arange(-1, len(part) + 1, dtype=float), robust[k::period])
            low = _averages(_averages(_averages(cycle, period), period), 3)
            seasonal = cycle[period : period + n] - _loess(low, low_window, 1, t, np.ones(n))
            trend = _loess(y - seasonal, trend_window, 1, t, robust)
        left = np.abs(y - seasonal - trend)
        edge = 6 * np.median(left)
        robust = np.ones(n) if edge == 0 else np.where(left >= 0.999 * edge, 0.0, np.where(left <= 0.001 * edge, 1.0, (1 - (left / edge) ** 2) ** 2))
    return trend, seasonal, y - trend - seasonal


@functools.cache
def _smoothers(n: int, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What stl() does to any series of this length, as matrices: weights of the cycles, the place that each falls back to, the season of a cycle, weights of the trend."""
    season_window, trend_window, low_window = _windows(n, period)
    t = np.arange(n, dtype=float)
    cycles, nearest = np.zeros((n, n + 2 * period)), np.empty(n + 2 * period, int)
    for k in range(period):
        own = np.arange(k, n, period)
        at = np.arange(-1, len(own) + 1)
        cycles[k::period, k::period] = _tricube(len(own), season_window, at.astype(float)).T
        nearest[k::period] = own[np.clip(at, 0, len(own) - 1)]
    low = lambda c: _averages(_averages(_averages(c, period), period), 3)
    season = np.array([c[period : period + n] - _loess(low(c), low_window, 1, t, np.ones(n)) for c in np.eye(n + 2 * period)])
    return cycles, nearest, season, _tricube(n, trend_window, t).T


def stl_many(y: np.ndarray, period: int = 12, outer: int = 15, inner: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """stl() of each row of y at once: all are as long, so they share their windows and differ in robustness weights only."""
    y = np.asarray(y, float)
    n = y.shape[1]
    cycles, nearest, season, around = _smoothers(n, period)
    x = np.arange(n, dtype=float) - (n - 1) / 2
    trend, seasonal, robust = np.zeros(y.shape), np.zeros(y.shape), np.ones(y.shape)
    for _ in range(outer + 1):
        of_cycle, total = robust @ cycles, robust @ around
        none, lone = of_cycle <= 0, total <= 0
        of_cycle[none], total[lone] = 1.0, 1.0
        centre = (robust * x) @ around / total
        spread = (robust * x * x) @ around / total - centre**2
        usable = spread > (1e-3 * (n - 1)) ** 2
        tilt = np.where(usable, (x - centre) / np.where(usable, spread, 1.0), 0.0)
        for _ in range(inner):
            left = y - trend
            cycle = np.where(none, left[:, nearest], (robust * left) @ cycles / of_cycle)
            seasonal = cycle @ season
            left = y - seasonal
            weighed = robust * left
            mean = weighed @ around / total
            trend = np.where(lone, left, mean + tilt * ((weighed * x) @ around / total - centre * mean))
        left = np.abs(y - seasonal - trend)
        edge = 6 * np.median(left, axis=1, keepdims=True)
        part = left / np.where(edge > 0, edge, 1.0)
        robust = np.where((edge == 0) | (left <= 0.001 * edge), 1.0, np.where(left >= 0.999 * edge, 0.0, (1 - part**2) ** 2))
    return trend, seasonal, y - trend - seasonal


def change_points(y: np.ndarray, least: int = 4, penalty: float | None = None) -> list[int]:
    """Where new segments begin: the split with the least sum of squares plus a penalty for each segment.

    Costs come from running sums in constant time. A start is no longer tried once a split is better without it, as the
    definition has it; as segments have a least length, this may miss the best split by little (2 of 6,000 random series). The penalty is 2 ln(n) times the variance (1 if that is 0). Ties go to the earliest start.
    """
    y = np.asarray(y, float)
    n = len(y)
    if n < 2 * least:
        return []
    if penalty is None:
        penalty = 2 * np.log(n) * (y.var() or 1.0)
    s, ss = np.r_[0, np.cumsum(y)], np.r_[0, np.cumsum(y * y)]
    best = np.full(n + 1, np.inf)
    best[0] = -penalty
    came = np.zeros(n + 1, int)
    starts = np.array([0])
    for end in range(least, n + 1):
        size = end - starts
        through = best[starts] + ss[end] - ss[starts] - (s[end] - s[starts]) ** 2 / size
        at = int(np.argmin(through))
        best[end], came[end] = through[at] + penalty, starts[at]
        starts = np.append(starts[through <= best[end]], end - least + 1)
        starts = starts[(starts == 0) | (starts >= least)]
    out, end = [], n
    while came[end]:
        end = int(came[end])
        out.append(end)
    return out[::-1]
