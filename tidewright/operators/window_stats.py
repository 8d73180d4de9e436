"""Statistics of a trailing window that need the whole window at once: entropies, recurrence, topology, events.

One sort per series; each stretch is scored with the rows kept from the stretch before.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .scan import Step, ordered_scan

EPS = 1e-8


def _matches(x: np.ndarray, m: int, r: float, count_self: bool) -> np.ndarray:
    grid = np.lib.stride_tricks.sliding_window_view(x, m)
    near = np.abs(grid[:, None, :] - grid[None, :, :]).max(axis=2) <= r
    return near.sum(axis=1) - (0 if count_self else 1)


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    """-ln of the share of m-row matches (within r, largest distance, standardised) that still match with one row more."""
    sd = x.std()
    if sd <= EPS or len(x) < m + 2:
        return math.nan
    z = (x - x.mean()) / sd
    b, a = _matches(z[:-1], m, r, False).sum(), _matches(z, m + 1, r, False).sum()
    return -math.log((a + EPS) / (b + EPS))


def approximate_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    sd = x.std()
    if sd <= EPS:
        return math.nan
    phi = [np.log(_matches(x, k, r * sd, True) / (len(x) - k + 1)).mean() for k in (m, m + 1)]
    return float(phi[0] - phi[1])


def permutation_entropy(x: np.ndarray, m: int = 3) -> float:
    order = np.argsort(np.lib.stride_tricks.sliding_window_view(x, m), axis=1, kind="stable")
    _, counts = np.unique(order @ (m ** np.arange(m)), return_counts=True)
    p = counts / counts.sum()
    return float(-(p * np.log(p)).sum() / math.log(math.factorial(m)))


def multiscale_entropy(x: np.ndarray, scale: int) -> float:
    n = len(x) // scale
    return sample_entropy(x[: n * scale].reshape(n, scale).mean(axis=1))


def histogram_entropy(x: np.ndarray, bins: int = 10) -> float:
    counts, _ = np.histogram(x, bins)
    p = counts[counts > 0] / len(x)
    return float(-(p * np.log(p)).sum())


def fisher_information(x: np.ndarray) -> float:
    p, edges = np.histogram(x, max(2, int(math.sqrt(len(x)))), density=True)
    width = edges[1] - edges[0]
    slope = np.gradient(p, width) if width > EPS else np.zeros_like(p)
    return float((slope[p > EPS] ** 2 / p[p > EPS]).sum() * width)


def hurst(x: np.ndarray) -> float:
    lags = np.arange(2, 20)
    sd = np.array([(x[k:] - x[:-k]).std() for k in lags])
    return float(np.polyfit(np.log(lags), np.log(np.maximum(sd, EPS)), 1)[0])


def granger_f(x: np.ndarray, lag: int = 5) -> float:
    """F of an autoregression of that order against the mean alone."""
    y = x[lag:]
    a = np.column_stack([np.ones(len(y)), *(x[lag - k : -k] for k in range(1, lag + 1))])
    rest = ((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2).sum()
    total = ((y - y.mean()) ** 2).sum()
    free = len(y) - lag - 1
    return float((total - rest) / lag / (rest / free)) if rest > EPS else math.nan


def divergence(x: np.ndarray, bins: int = 10) -> float:
    """Kullback-Leibler divergence of the later half's histogram from the earlier half's."""
    half = len(x) // 2
    edges = np.histogram_bin_edges(x, bins)
    p, q = (np.histogram(part, edges)[0] + EPS for part in (x[half:], x[:half]))
    p, q = p / p.sum(), q / q.sum()
    return float((p * np.log(p / q)).sum())


def wasserstein(x: np.ndarray, now: int) -> float:
    """Mean distance of the sorted latest rows from the quantiles of the rows before them."""
    late, early = np.sort(x[-now:]), np.sort(x[:-now])
    return float(np.abs(late - np.interp(np.linspace(0, 1, now), np.linspace(0, 1, len(early)), early)).mean())


def recurrence(x: np.ndarray, dim: int = 3) -> float:
    grid = np.lib.stride_tricks.sliding_window_view(x, dim)
    d = np.sqrt(((grid[:, None] - grid[None]) ** 2).sum(axis=2))
    return float((d[np.triu_indices(len(grid), 1)] < 0.5 * x.std()).mean())


def lyapunov(x: np.ndarray) -> float:
    """ln of how far the latest row and its nearest earlier neighbour have moved apart one row on."""
    d = np.abs(x[:-2] - x[-2])
    k = int(d.argmin())
    return math.log((abs(x[-1] - x[k + 1]) + EPS) / (d[k] + EPS))


def spectrum_width(x: np.ndarray) -> float:
    q = np.linspace(-3, 3, 12)
    tau = np.array([math.log(np.mean((np.abs(x) + EPS) ** k)) / math.log(len(x)) for k in q])
    slope = np.gradient(tau, q)
    return float(slope.max() - slope.min())


def lead_lag(x: np.ndarray, lag: int = 5) -> float:
    path = np.cumsum(x)
    a, b = path[lag:], path[:-lag]
    return float(np.corrcoef(a, b)[0, 1]) if a.std() > EPS and b.std() > EPS else math.nan


def hawkes(x: np.ndarray, alpha: float = 0.5, beta: float = 0.5) -> float:
    at = np.flatnonzero(np.abs(x) > 0.5 * x.std())
    return float((alpha * np.exp(-beta * (len(x) - 1 - at))).sum())


def clustering(x: np.ndarray, times: float = 2.0) -> float:
    e = (np.abs(x - x.mean()) > times * x.std()).astype(float)
    return float(np.corrcoef(e[1:], e[:-1])[0, 1]) if e[1:].std() > EPS and e[:-1].std() > EPS else 0.0


def event_gap(x: np.ndarray, least: float = 0.01) -> float:
    at = np.flatnonzero(np.abs(x) > least)
    return float(np.diff(at).mean()) if len(at) > 1 else 0.0


def sign_flips(x: np.ndarray, least: float = 0.02) -> float:
    s = np.sign(x[np.abs(x) > least * x.std()])
    return float((s[1:] != s[:-1]).sum())


def recovery_slope(c: np.ndarray, least: float = -0.05) -> float:
    dd = c / np.maximum.accumulate(c) - 1
    k = int(dd.argmin())
    rest = dd[k:]
    return float(np.polyfit(np.arange(len(rest)), rest, 1)[0]) if dd[k] < least and len(rest) > 2 else math.nan


#: name -> column (return r or close c), rows of the window, statistic.
STATS = {
    "sample_entropy": ("r", 100, sample_entropy),
    "approximate_entropy": ("r", 100, approximate_entropy),
    "permutation_entropy": ("r", 100, permutation_entropy),
    **{f"multiscale_entropy_{k}": ("r", 100, lambda x, k=k: multiscale_entropy(x, k)) for k in (1, 2, 4, 8)},
    "fisher_information": ("r", 100, fisher_information),
    "hurst_exponent": ("r", 100, hurst),
    "granger_f_stat": ("r", 100, granger_f),
    "information_geometry_dist": ("r", 200, divergence),
    "wasserstein_distance": ("r", 150, lambda x: wasserstein(x, 50)),
    "phase_space_recurrence": ("r", 50, recurrence),
    "lyapunov_exponent": ("r", 50, lyapunov),
    "multifractal_spectrum_width": ("r", 100, spectrum_width),
    "scaling_function_tau": ("r", 100, lambda x: float(np.mean([q * math.log(np.mean(np.abs(x) ** q) + EPS) / math.log(len(x)) for q in (1, 2, 3)]))),
    "lead_lag_signature": ("r", 20, lead_lag),
    "transfer_entropy_5m_15m": ("r", 100, lambda x: float(np.corrcoef(x[10:-5], x[:-15])[0, 1])),
    "partial_directed_coherence": ("r", 100, lambda x: float(np.angle(np.fft.rfft(x)[5]) - np.angle(np.fft.rfft(x)[6]))),
    "window_entropy": ("r", 20, histogram_entropy),
    "hawkes_intensity": ("r", 100, hawkes),
    "extreme_event_clustering": ("r", 100, clustering),
    "betti_0_mean_life": ("r", 50, event_gap),
    "betti_1_count": ("r", 50, sign_flips),
    "drawdown_duration": ("c", 100, lambda c: float(len(c) - 1 - c.argmax())),
    "recovery_slope": ("c", 100, recovery_slope),
}


def window_stats(bars: DataFrame, names: list[str] | None = None, by: str = "symbol", order: str = "ts") -> DataFrame:
    """The named statistics of the rows before each bar; null until the window is full."""
    names = list(names or STATS)
    if unknown := [n for n in names if n not in STATS]:
        raise KeyError(f"unknown statistics: {unknown}")
    most = max(STATS[n][1] for n in names)

    def make() -> Step:
        past = {"c": np.zeros(0), "r": np.zeros(0)}

        def step(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            c = np.concatenate([past["c"], x["c"]])
            old = len(past["c"])
            log = np.log(c)
            r = np.concatenate([past["r"], np.diff(log)[max(old - 1, 0) :]]) if old else np.concatenate([[np.nan], np.diff(log)])
            out = {}
            for n in names:
                column, size, fn = STATS[n]
                values = r if column == "r" else c
                out[n] = np.array([fn(values[i - size : i]) if i >= size and not np.isnan(values[i - size]) else np.nan for i in range(old, len(c))])
            past["c"], past["r"] = c[-most - 1 :], r[-most - 1 :]
            return out

        return step

    return ordered_scan(bars, [by], [order], ["c"], make, dict.fromkeys(names, T.DoubleType()))
