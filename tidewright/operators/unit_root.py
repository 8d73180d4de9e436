"""Unit-root tests and the smallest order of differencing that passes them.

A series is cut into blocks of rows, each with the rows before it that its filters and lags reach; blocks of one series are work of
different tasks. A block gives sums of products only, from which the regressions of a whole series follow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block; a block is read with at most the widest filter's rows before it.
BLOCK = 1 << 14

#: Response surface of the tau statistic with a constant (MacKinnon 1994): bounds, then polynomials below and above the middle.
TAU_LARGEST, TAU_SMALLEST, TAU_MIDDLE = 2.74, -18.83, -1.61
TAU_BELOW = (2.1659, 1.4412, 0.038269)
TAU_ABOVE = (1.7339, 0.93202, -0.12745, -0.010368)


def tau_p_value(tau: float) -> float:
    """Approximate p value of the statistic of a regression with a constant."""
    if math.isnan(tau):
        return math.nan
    if tau > TAU_LARGEST or tau < TAU_SMALLEST:
        return 1.0 if tau > TAU_LARGEST else 0.0
    powers = TAU_BELOW if tau <= TAU_MIDDLE else TAU_ABOVE
    return 0.5 * math.erfc(-sum(c * tau**k for k, c in enumerate(powers)) / math.sqrt(2))


def tau_p_sql(tau: str, cdf) -> str:
    """The same as SQL; ``cdf`` spells the normal distribution function."""
    poly = lambda cs: " + ".join(f"({c!r}) * power({tau}, {k})" for k, c in enumerate(cs))
    return f"CASE WHEN {tau} > {TAU_LARGEST} THEN 1e0 WHEN {tau} < {TAU_SMALLEST} THEN 0e0 WHEN {tau} <= {TAU_MIDDLE} THEN {cdf(f'({poly(TAU_BELOW)})')} ELSE {cdf(f'({poly(TAU_ABOVE)})')} END"


def difference_weights(d: float, threshold: float = 1e-5, longest: int = 10_000) -> np.ndarray:
    """Weights of fractional differencing of order ``d``, newest first, up to the first one below ``threshold``."""
    w = [1.0]
    while len(w) < longest:
        nxt = -w[-1] * (d - len(w) + 1) / len(w)
        if abs(nxt) < threshold or not math.isfinite(nxt):
            break
        w.append(nxt)
    return np.array(w)


def placed(df: DataFrame, by: list[str], order: str, unit: str = "MONTH") -> DataFrame:
    """``df`` with ``k``, the place from 0 in its series, and ``n``, the series' length; counted per ``unit`` of time, then within it."""
    unit_of = F.date_trunc(unit, order)
    rows = df.withColumn("unit_", unit_of)
    counts = rows.groupBy(*by, "unit_").count()
    counts = counts.withColumns({"before_": F.sum("count").over(Window.partitionBy(*by).orderBy("unit_")) - F.col("count"), "n": F.sum("count").over(Window.partitionBy(*by))})
    found = rows.join(counts.drop("count"), [*by, "unit_"])
    return found.withColumn("k", F.col("before_") + F.row_number().over(Window.partitionBy(*by, "unit_").orderBy(order)) - 1).drop("unit_", "before_")


def blocks(rows: DataFrame, reach: int, size: int) -> DataFrame:
    """Placed rows, each in its own block and in those after it whose filters reach back to it."""
    last = F.least(F.floor((F.col("k") + reach) / size), F.floor((F.col("n") - 1) / size))
    return rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("k") / size), F.greatest(last, F.floor(F.col("k") / size)))))


SUMS = "n_obs sx sy sxx syy sxy m a p q aa ap pp aq pq qq first_y".split()


def differencing_sums(df: DataFrame, by: list[str], order: str, value: str, orders: list[float], threshold: float = 1e-5, longest: int = 10_000, block: int = BLOCK) -> DataFrame:
    """Per series and order ``d``: sums of the differenced series y, of its products with the series itself, and of the regression of its
    differences on its last value and last difference.

    Filters are as long as their weights exceed ``threshold``, at most ``longest`` or the series; values where a filter
    doesn't fit are left out. ``value`` must not be null or repeated in ``order``.
    """
    rows = placed(df.select(*by, order, F.col(value).cast("double").alias("x_")).filter("x_ IS NOT NULL"), by, order)
    reach = max(len(difference_weights(d, threshold, longest)) for d in orders) + 1
    cut = blocks(rows, reach, block).select(*by, "block", "k", "n", "x_")
    schema = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by) + ", d double, " + ", ".join(f"{s} double" for s in SUMS)
    table = {d: difference_weights(d, threshold, longest) for d in orders}

    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        k, x, n = pdf["k"].to_numpy(), pdf["x_"].to_numpy(), int(pdf["n"].iloc[0])
        own = key[-1] * block
        out = []
        for d in orders:
            w = table[d][: min(n, longest)]
            width = len(w)
            if len(x) < width:
                continue
            y, at, xs = np.convolve(x, w, "valid"), k[width - 1 :], x[width - 1 :]
            mine = at >= own
            step = np.diff(y)
            # Rows whose value, last value and last difference exist.
            q, p, a = step[1:], step[:-1], y[1:-1]
            reg = mine[2:]
            q, p, a, yy, xx = q[reg], p[reg], a[reg], y[mine], xs[mine]
            out.append((*key[:-1], d, len(yy), xx.sum(), yy.sum(), xx @ xx, yy @ yy, xx @ yy, len(q), a.sum(), p.sum(), q.sum(), a @ a, a @ p, p @ p, a @ q, p @ q, q @ q, 0.0))
        return pd.DataFrame(out, columns=[*by, "d", *SUMS])

    return cut.groupBy(*by, "block").applyInPandas(sums, schema).groupBy(*by, "d").agg(*(F.sum(s).alias(s) for s in SUMS[:-1]))


def unit_root_by_order(df: DataFrame, by: list[str], order: str, value: str, orders: list[float], least: int = 20, **kw) -> DataFrame:
    """``by, d, n_obs, corr_with_original, adf_stat``: the test with one lag and a constant on the series differenced ``d`` times.

    Orders with fewer than ``least`` differenced values are left out; the statistic is null where the regression is singular.
    """
    s = differencing_sums(df, by, order, value, orders, **kw).filter(F.col("n_obs") >= least)
    c = lambda xy, x, y: F.col(xy) - F.col(x) * F.col(y) / F.col("m")
    aa, ap, pp, aq, pq, qq = c("aa", "a", "a"), c("ap", "a", "p"), c("pp", "p", "p"), c("aq", "a", "q"), c("pq", "p", "q"), c("qq", "q", "q")
    s = s.withColumns({"aa_": aa, "ap_": ap, "pp_": pp, "aq_": aq, "pq_": pq, "qq_": qq}).withColumn("det_", F.expr("aa_ * pp_ - ap_ * ap_"))
    s = s.withColumn("b1_", F.expr("CASE WHEN det_ > 1e-12 * aa_ * pp_ AND m > 3 THEN (aq_ * pp_ - pq_ * ap_) / det_ END")).withColumn("b2_", F.expr("CASE WHEN b1_ IS NOT NULL THEN (pq_ * aa_ - aq_ * ap_) / det_ END"))
    s = s.withColumn("rss_", F.expr("qq_ - b1_ * aq_ - b2_ * pq_"))
    stat = F.expr("CASE WHEN rss_ > 0 THEN b1_ / sqrt(rss_ / (m - 3) * pp_ / det_) END")
    spread = F.expr("(sxx - sx * sx / n_obs) * (syy - sy * sy / n_obs)")
    corr = F.when(spread > 0, F.expr("sxy - sx * sy / n_obs") / F.sqrt(spread))
    return s.select(*by, "d", F.col("n_obs").cast("long").alias("n_obs"), corr.alias("corr_with_original"), stat.alias("adf_stat"))


# ---- the test with lags chosen by the information criterion ------------------------------------------------------------------------


def longest_lag(n: int) -> int:
    """Lags to try for a series of ``n`` values: 12 (n / 100)^(1/4), rounded up, as far as the regression allows."""
    return max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))


def _solve(gram: np.ndarray, use: list[int], rows: int) -> tuple[float, float, float]:
    """Least squares on the columns ``use`` of a matrix of products whose last row is the target: (t of the second column, rss, log likelihood)."""
    a, b, q = gram[np.ix_(use, use)], gram[use, -1], gram[-1, -1]
    scale = np.sqrt(np.diag(a))
    if not (scale > 0).all():
        return math.nan, math.nan, math.nan
    inverse = np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-13) / np.outer(scale, scale)
    beta = inverse @ b
    rss = float(q - beta @ b)
    if rss <= 1e-13 * q or rows <= len(use):
        return math.nan, rss, math.nan
    t = float(beta[1] / math.sqrt(rss / (rows - len(use)) * inverse[1, 1]))
    return t, rss, -rows / 2 * (math.log(2 * math.pi) + math.log(rss / rows) + 1)


def unit_root_tests(df: DataFrame, by: list[str], order: str, value: str, lags: int | None = None, significance: float = 0.05, least: int = 10, block: int = BLOCK) -> DataFrame:
    """``by, n_obs, lags, statistic, p_value, stationary`` of each series; the number of lags has the smallest information criterion.

    Up to ``lags`` lags are tried (default: :func:`longest_lag` of the series), all on the rows that the most lags leave; the chosen one is
    then fitted on all its rows. Blocks give the matrix of products of the constant, the last value and the lagged differences;
    matrices are added entry by entry, one small matrix a series is solved. A series with fewer than ``least`` values, or whose regression is
    singular, is not stationary, with p value 1.
    """
    rows = placed(df.select(*by, order, F.col(value).cast("double").alias("x_")).filter("x_ IS NOT NULL"), by, order)
    most = F.greatest(F.lit(0), F.least(F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25))), F.floor(F.col("n") / 2) - 2)) if lags is None else F.greatest(F.lit(0), F.least(F.lit(lags), F.floor(F.col("n") / 2) - 2))
    middle = rows.groupBy(*by).agg(F.avg("x_").alias("mean_"))  # the constant takes up any shift; small numbers lose fewer digits
    rows = rows.withColumn("most", most.cast("int")).join(middle, by).withColumn("x_", F.col("x_") - F.col("mean_"))
    short = rows.filter(F.col("n") < least).filter("k = 0").select(*by, F.lit(0).cast("long").alias("n_obs"), F.lit(0).alias("lags"), F.lit(None).cast("double").alias("statistic"), F.lit(1.0).alias("p_value"), F.lit(False).alias("stationary"))
    rows = rows.filter(F.col("n") >= least)
    last = F.least(F.floor((F.col("k") + F.col("most") + 1) / block), F.floor((F.col("n") - 1) / block))
    cut = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("k") / block), F.greatest(last, F.floor(F.col("k") / block)))))
    keys = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)

    def products(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        k, x, most_ = pdf["k"].to_numpy(), pdf["x_"].to_numpy(), int(pdf["most"].iloc[0])
        step = np.diff(x)
        # Row t: 1, x[t-1], step of t-1, t-2, ..., and of t itself; it exists for t >= lags + 1.
        at = np.arange(most_ + 1, len(x))
        at = at[k[at] >= key[-1] * block]
        cols = np.column_stack([np.ones(len(at)), x[at - 1], *(step[at - 1 - j] for j in range(1, most_ + 1)), step[at - 1]])
        gram = cols.T @ cols
        n = len(gram)
        out = pd.DataFrame({"entry": np.arange(n * n), "value": gram.ravel()})
        if key[-1] == 0:  # the first rows, which shorter regressions have besides
            head = x[: 2 * most_ + 2]
            out = pd.concat([out, pd.DataFrame({"entry": -1 - np.arange(len(head)), "value": head})])
        for b, v in zip(by, key[:-1], strict=True):
            out[b] = v
        return out.assign(n=int(pdf["n"].iloc[0]), most=most_)[[*by, "n", "most", "entry", "value"]]

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, most_ = int(pdf["n"].iloc[0]), int(pdf["most"].iloc[0])
        size = most_ + 3
        gram = np.zeros(size * size)
        inner = pdf[pdf["entry"] >= 0]
        gram[inner["entry"].to_numpy()] = inner["value"].to_numpy()
        gram = gram.reshape(size, size)
        head = pdf[pdf["entry"] < 0].sort_values("entry", ascending=False)["value"].to_numpy()
        rows_ = n - 1 - most_
        best, found = None, (math.nan, math.nan, math.nan)
        for lag in range(most_ + 1):
            t, _, likelihood = _solve(gram, list(range(lag + 2)), rows_)
            aic = 2 * (lag + 2) - 2 * likelihood
            if not math.isnan(aic) and (best is None or aic < best[0]):
                best = (aic, lag)
        lag = best[1] if best else 0
        if best:
            use = [*range(lag + 2), size - 1]
            part = gram[np.ix_(use, use)]
            step = np.diff(head)
            early = np.arange(lag + 1, min(most_ + 1, len(head)))
            if len(early):
                cols = np.column_stack([np.ones(len(early)), head[early - 1], *(step[early - 1 - j] for j in range(1, lag + 1)), step[early - 1]])
                part = part + cols.T @ cols
            found = _solve(part, list(range(lag + 2)), n - 1 - lag)
        p = tau_p_value(found[0]) if not math.isnan(found[0]) else 1.0
        return pd.DataFrame([(*key, n - 1 - lag, lag, None if math.isnan(found[0]) else found[0], p, p < significance)], columns=[*by, "n_obs", "lags", "statistic", "p_value", "stationary"])

    sums = cut.groupBy(*by, "block").applyInPandas(products, f"{keys}, n long, most int, entry long, value double").groupBy(*by, "n", "most", "entry").agg(F.sum("value").alias("value"))
    return sums.groupBy(*by).applyInPandas(solve, f"{keys}, n_obs long, lags int, statistic double, p_value double, stationary boolean").unionByName(short)
