"""Granger causality: whether a feature's past helps to foretell a target beyond the target's own."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .unit_root import BLOCK, blocks, placed


def incomplete_beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction on the side where that converges."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    # The fraction 1 + t1 / (1 + t2 / (1 + ...)) by ratios of neighbouring numerators and denominators.
    value, c, d = 1.0, 1.0, 0.0
    for k in range(1, 5000):
        m = k // 2
        t = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + t * d or 1e-300)
        c = 1 + t / c or 1e-300
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front / value


def f_tail(f: float, d1: int, d2: int) -> float:
    """Chance of a value above ``f`` of the F distribution."""
    if math.isnan(f) or d2 <= 0:
        return math.nan
    return incomplete_beta(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def _rss(gram: np.ndarray, use: list[int]) -> float:
    """Residual sum of squares of the last column on others, from the matrix of products."""
    a, b = gram[np.ix_(use, use)], gram[use, -1]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    return float(gram[-1, -1] - b / scale @ np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-13) @ (b / scale))


def granger_tests(df: DataFrame, by: list[str], order: str, target: str, feature: str, lags: int = 5, block: int = BLOCK) -> DataFrame:
    """``by, lag, n_obs, f_stat, p_value`` for 1 to ``lags`` lags of both, each on all rows that have them.

    Rows with a null in either are left out before lags are taken. One matrix of products of the constant and all lags, added up over
    blocks of rows, holds the regressions of every number of lags; the few rows that fewer lags have besides are kept by
    themselves. Null where there are too few rows or the target is foretold without rest.
    """
    rows = df.select(*by, order, F.col(target).cast("double").alias("y_"), F.col(feature).cast("double").alias("f_")).filter("y_ IS NOT NULL AND f_ IS NOT NULL AND NOT isnan(y_) AND NOT isnan(f_)")
    middle = rows.groupBy(*by).agg(F.avg("y_").alias("my_"), F.avg("f_").alias("mf_"))
    rows = placed(rows.join(middle, by).withColumns({"y_": F.col("y_") - F.col("my_"), "f_": F.col("f_") - F.col("mf_")}).drop("my_", "mf_"), by, order)
    cut = blocks(rows, lags, block).select(*by, "block", "k", "n", "y_", "f_")
    keys = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)
    size = 2 * lags + 2

    def columns(y: np.ndarray, f: np.ndarray, at: np.ndarray, lag: int) -> np.ndarray:
        return np.column_stack([np.ones(len(at)), *(y[at - j] for j in range(1, lag + 1)), *(f[at - j] for j in range(1, lag + 1)), y[at]])

    def products(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        k, y, f = pdf["k"].to_numpy(), pdf["y_"].to_numpy(), pdf["f_"].to_numpy()
        at = np.arange(lags, len(y))
        x = columns(y, f, at[k[at] >= key[-1] * block], lags)
        parts = [(np.arange(size * size), (x.T @ x).ravel())]
        if key[-1] == 0:
            parts += [(-1 - np.arange(len(y[: 2 * lags])), y[: 2 * lags]), (-1001 - np.arange(len(f[: 2 * lags])), f[: 2 * lags])]
        out = pd.DataFrame({"entry": np.concatenate([e for e, _ in parts]), "value": np.concatenate([v for _, v in parts])})
        for b, v in zip(by, key[:-1], strict=True):
            out[b] = v
        return out.assign(n=int(pdf["n"].iloc[0]))[[*by, "n", "entry", "value"]]

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, inner = int(pdf["n"].iloc[0]), pdf[pdf["entry"] >= 0]
        gram = np.zeros(size * size)
        gram[inner["entry"].to_numpy()] = inner["value"].to_numpy()
        gram = gram.reshape(size, size)
        y, f = (pdf[(pdf["entry"] <= hi) & (pdf["entry"] > lo)].sort_values("entry", ascending=False)["value"].to_numpy() for lo, hi in ((-1001, -1), (-10**9, -1001)))
        out = []
        for lag in range(1, lags + 1):
            use = [0, *range(1, lag + 1), *range(lags + 1, lags + 1 + lag), size - 1]
            part = gram[np.ix_(use, use)]
            early = np.arange(lag, min(lags, len(y)))
            if len(early):
                x = columns(y, f, early, lag)
                part = part + x.T @ x
            m = n - lag
            free = m - 2 * lag - 1
            stat = math.nan
            if free > 0:
                own, both = _rss(part, list(range(lag + 1))), _rss(part, list(range(2 * lag + 1)))
                if both > 1e-12 * part[-1, -1]:
                    stat = max(0.0, own - both) / both / lag * free
            p = f_tail(stat, lag, free)
            out.append((*key, lag, max(m, 0), None if math.isnan(stat) else stat, None if math.isnan(p) else p))
        return pd.DataFrame(out, columns=[*by, "lag", "n_obs", "f_stat", "p_value"])

    sums = cut.groupBy(*by, "block").applyInPandas(products, f"{keys}, n long, entry long, value double").groupBy(*by, "n", "entry").agg(F.sum("value").alias("value"))
    return sums.groupBy(*by).applyInPandas(solve, f"{keys}, lag int, n_obs long, f_stat double, p_value double")


def granger_scores(tests: DataFrame, by: list[str]) -> DataFrame:
    """``by, score``: minus the logarithm to ten of the smallest p value of all lags, at most 300; 0 without any."""
    return tests.groupBy(*by).agg(F.coalesce(-F.log10(F.greatest(F.min("p_value"), F.lit(1e-300))), F.lit(0.0)).alias("score"))
