"""Feature transforms: trailing ranks as normal scores, residuals against market series."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import Step, ordered_scan

#: Shares nearer than this to 0 or 1 count as 0 or 1; their scores are those of this share.
EDGE = 1e-7
LIMIT = -NormalDist().inv_cdf(EDGE)


class Trailing:
    """The last ``window`` values in order of time and of size: a value costs a search and a shift, not a sort."""

    def __init__(self, window: int) -> None:
        self.window, self.past, self.sorted, self.missing = window, deque(), [], 0

    def share(self, x: float) -> float:
        """Where ``x`` lies among them, 0 to 1, between neighbours in proportion; NaN unless all of them and ``x`` are known."""
        s = self.sorted
        if x != x or len(self.past) < self.window or self.missing:
            return np.nan
        if x - EDGE < s[0]:
            return 0.0
        if x + EDGE > s[-1]:
            return 1.0
        lo, hi = bisect_left(s, x), bisect_right(s, x)
        at = (lo + hi - 1) / 2 if hi > lo else lo - 1 + (x - s[lo - 1]) / (s[lo] - s[lo - 1])
        return at / (len(s) - 1)

    def push(self, x: float) -> None:
        self.past.append(x)
        if x != x:
            self.missing += 1
        else:
            insort(self.sorted, x)
        if len(self.past) > self.window:
            old = self.past.popleft()
            if old != old:
                self.missing -= 1
            else:
                self.sorted.pop(bisect_left(self.sorted, old))


def normal_score(p: float) -> float:
    return p if p != p else -LIMIT if p <= EDGE else LIMIT if p >= 1 - EDGE else NormalDist().inv_cdf(p)


def trailing_normal(df: DataFrame, by: list[str], order: list[str], columns: list[str], window: int = 252) -> DataFrame:
    """``by``, ``order`` and, per column, ``<column>_share`` and ``<column>_normal``: where its value lies among the ``window`` before it, and that as a normal score.

    Null until a window is full, where it holds a null, and for a null. Equal values share the mean of their places; at or beyond
    the ends of the window the share is 0 or 1, the score that of one in ten million.
    """
    out = {f"{c}_{k}": T.DoubleType() for c in columns for k in ("share", "normal")}

    def make() -> Step:
        states = {c: Trailing(window) for c in columns}

        def step(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            made = {}
            for c, state in states.items():
                shares = np.empty(len(x[c]))
                for i, v in enumerate(x[c].astype(float).tolist()):
                    shares[i] = state.share(v)
                    state.push(v)
                made[f"{c}_share"], made[f"{c}_normal"] = shares, np.array([normal_score(p) for p in shares.tolist()])
            return made

        return step

    return ordered_scan(df.select(*by, *order, *(F.col(c).cast("double").alias(c) for c in columns)), by, order, columns, make, out)


def neutralised(df: DataFrame, by: list[str], features: list[str], against: list[str], least: int = 50) -> DataFrame:
    """``df`` with each feature less what least squares without a constant explain by the columns ``against``; in each group of ``by``.

    Rows with a null among those keep their value, as does a feature with fewer than ``least`` other rows. Sums of products are
    made in one pass and solved per group; groups' coefficients, a number per feature and regressor, are joined back.
    """
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    known = {f: F.col(f"x_{f}").isNotNull() for f in features}
    for a in against:
        known = {f: k & F.col(f"x_{a}").isNotNull() for f, k in known.items()}
    rows = df.select("*", *(number(c).alias(f"x_{c}") for c in dict.fromkeys([*features, *against])))
    sums = []
    for f in features:
        pairs = [(a, b) for i, a in enumerate(against) for b in [*against[i:], f]]
        sums.append(F.struct(F.lit(f).alias("feature"), F.sum(known[f].cast("long")).alias("n"), F.array(*(F.sum(F.when(known[f], F.col(f"x_{a}") * F.col(f"x_{b}"))) for a, b in pairs)).alias("sums")))
    table = rows.groupBy(*by).agg(F.array(*sums).alias("all")).select(*by, F.explode("all").alias("one")).select(*by, "one.*")
    m = len(against)
    keys = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)

    def solve(frames):
        for pdf in frames:
            out = []
            for n, values in zip(pdf["n"], pdf["sums"], strict=True):
                if n < least:
                    out.append([0.0] * m)
                    continue
                values, gram, target = list(values), np.zeros((m, m)), np.zeros(m)
                for i in range(m):
                    for j in range(i, m):
                        gram[i, j] = gram[j, i] = values.pop(0)
                    target[i] = values.pop(0)
                out.append((np.linalg.pinv(gram, rcond=1e-13) @ target).tolist())
            yield pd.DataFrame({**{b: pdf[b] for b in by}, "feature": pdf["feature"], "betas": out})

    betas = table.mapInPandas(solve, f"{keys}, feature string, betas array<double>").groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("feature", "betas"))).alias("betas_"))
    out = rows.join(betas, by)
    for f in features:
        explained = sum((F.col("betas_")[f][i] * F.col(f"x_{a}") for i, a in enumerate(against)), F.lit(0.0))
        out = out.withColumn(f, F.when(known[f], F.col(f"x_{f}") - explained).otherwise(F.col(f"x_{f}")))
    return out.select(*df.columns)


def _signed_log(x):
    return F.signum(x) * F.log1p(F.abs(x))


def fit_scalers(df: DataFrame, by: list[str], kinds: dict[str, str]) -> DataFrame:
    """What scalers of columns need, a row per group: ``<column>_centre`` and ``<column>_width``. Keep it, and apply it to other rows.

    Kinds: ``standard`` (mean, deviation), ``minmax`` (least, range), ``robust`` (median, distance of the quartiles), each also with ``_log`` after a
    signed logarithm; ``signed_log`` alone needs nothing. Nulls and NaN are left out; a width of 0 counts as 1.
    """
    out = []
    for c, kind in kinds.items():
        x = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        x = _signed_log(x) if kind.endswith("log") else x
        base = kind.removesuffix("_log")
        if base == "standard":
            centre, width = F.avg(x), F.stddev_pop(x)
        elif base == "minmax":
            centre, width = F.min(x), F.max(x) - F.min(x)
        elif base == "robust":
            centre, width = F.percentile(x, 0.5), F.percentile(x, 0.75) - F.percentile(x, 0.25)
        elif kind == "signed_log":
            centre, width = F.lit(0.0), F.lit(1.0)
        else:
            raise ValueError(f"unknown kind of scaler: {kind}")
        out += [F.first(centre).alias(f"{c}_centre") if kind == "signed_log" else centre.alias(f"{c}_centre"), (F.first(width) if kind == "signed_log" else F.when(width > 0, width).otherwise(1.0)).alias(f"{c}_width")]
    return df.groupBy(*by).agg(*out)


def apply_scalers(df: DataFrame, by: list[str], table: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``df`` with its columns scaled by a table of :func:`fit_scalers`; null in groups that it doesn't have."""
    out = df.join(table, by, "left")
    for c, kind in kinds.items():
        x = F.col(c).cast("double")
        out = out.withColumn(c, ((_signed_log(x) if kind.endswith("log") else x) - F.col(f"{c}_centre")) / F.col(f"{c}_width"))
    return out.select(*df.columns)
