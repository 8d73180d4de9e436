"""Information bars: dollar, volume, volatility, range, renko and hybrid, with adaptive targets.

Ticks of a series are folded into an open bar; it closes when its size reaches the target and it has lasted the
minimum, or when it has lasted the maximum. The target follows the sizes of closed bars, its speed follows their
variation (every 50 bars), and durations and target are nudged every 200 bars where the bars are uneven.
"""

from __future__ import annotations

import statistics
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import sessions

KINDS = ("dollar", "volume", "volatility", "range", "renko", "hybrid")
#: Bars per day each kind aims at before calibration.
PER_DAY = {"dollar": 4.2, "volume": 8.7, "volatility": 4.4, "range": 4.4, "renko": 6.0, "hybrid": 8.0}

BAR = T.StructType(
    [
        *(T.StructField(n, T.TimestampNTZType()) for n in ("datetime_start", "datetime_end")),
        *(T.StructField(n, T.DoubleType()) for n in ("open", "high", "low", "close", "volume", "dollar_volume", "vwap", "bar_size", "target", "duration_minutes", "buy_share", "bar_return", "price_range", "close_position")),
        T.StructField("tick_count", T.LongType()),
        T.StructField("direction", T.StringType()),
    ]
)


@dataclass(frozen=True)
class BarParams:
    """Start values and bounds of one kind's bars."""

    target: float
    alpha: float = 0.15
    alpha_min: float = 0.05
    alpha_max: float = 0.35
    min_minutes: float = 3.0
    max_minutes: float = 720.0
    monitor_every: int = 50
    optimise_every: int = 200
    cooldown: int = 400
    adaptive: bool = True
    second_target: float = float("inf")


class InfoBars:
    """One series' open bar and market parameters."""

    def __init__(self, kind: str, p: BarParams) -> None:
        self.kind, self.p = kind, p
        self.target, self.second, self.alpha = p.target, p.second_target, p.alpha
        self.min_minutes, self.max_minutes = p.min_minutes, p.max_minutes
        self.bar: list | None = None
        self.closed, self.last_tuned, self.recent, self.targets = 0, 0, [], []
        self.last_price: float | None = None
        self.reference: float | None = None

    def push(self, row: tuple) -> list[tuple]:
        ts, price, quantity, seller = row
        if price is None or quantity is None or price <= 0 or quantity <= 0:
            return []
        move = abs(price - self.last_price) / self.last_price if self.last_price else 0.0
        self.last_price = price
        b = self.bar
        if b is None:
            b = self.bar = {"start": ts, "o": price, "h": price, "l": price, "v": 0.0, "d": 0.0, "buy": 0.0, "path": 0.0, "n": 0}
            if self.reference is None:
                self.reference = price
        b["end"], b["c"] = ts, price
        b["h"], b["l"] = max(b["h"], price), min(b["l"], price)
        b["v"] += quantity
        b["d"] += price * quantity
        b["buy"] += 0.0 if seller else price * quantity
        b["path"] += move
        b["n"] += 1
        size, other = self._sizes(b)
        minutes = (ts - b["start"]).total_seconds() / 60
        full = size >= self.target or other >= self.second
        return [self._finish(size, minutes)] if (full and minutes >= self.min_minutes) or minutes >= self.max_minutes else []

    def close(self) -> list[tuple]:
        """The open bar of a series that ends is not a bar."""
        return []

    def _sizes(self, b: dict) -> tuple[float, float]:
        if self.kind == "dollar":
            return b["d"], 0.0
        if self.kind == "volume":
            return b["v"], 0.0
        if self.kind == "volatility":
            return b["path"], 0.0
        if self.kind == "range":
            return (b["h"] - b["l"]) / b["c"], 0.0
        if self.kind == "renko":
            return abs(b["c"] - self.reference) / self.reference, 0.0
        return b["d"], b["path"]

    def _finish(self, size: float, minutes: float) -> tuple:
        b, target = self.bar, self.target
        self.bar, self.reference = None, b["c"]
        span = b["h"] - b["l"]
        row = (
            b["start"], b["end"], b["o"], b["h"], b["l"], b["c"], b["v"], b["d"], b["d"] / b["v"], size, target, minutes, b["buy"] / b["d"],
            b["c"] / b["o"] - 1, span / b["o"], (b["c"] - b["l"]) / span if span > 0 else 0.5, b["n"], "bullish" if b["c"] >= b["o"] else "bearish",
        )
        self.closed += 1
        self.recent = [*self.recent[-199:], (size, minutes)]
        if self.p.adaptive:
            self._adapt(size)
        return row

    def _adapt(self, size: float) -> None:
        p = self.p
        seen = size if self.kind == "dollar" else min(size, 2 * self.target)
        self.target = (1 - self.alpha) * self.target + self.alpha * seen
        self.targets = [*self.targets[-19:], self.target]
        if self.closed % p.monitor_every == 0 and len(self.targets) >= 5:
            mean = statistics.fmean(self.targets)
            cv = statistics.pstdev(self.targets) / mean if mean > 0 else 0.0
            alpha = p.alpha_min + (p.alpha_max - p.alpha_min) * min(1.0, cv / 0.8)
            if abs(alpha - self.alpha) > 0.01:
                self.alpha = alpha
        if self.closed % p.optimise_every == 0 and self.closed - self.last_tuned >= min(p.cooldown, self.closed) and len(self.recent) >= 50:
            self.last_tuned = self.closed
            sizes, minutes = [s for s, _ in self.recent], [m for _, m in self.recent]
            evenness = 1 / (1 + statistics.pstdev(sizes) / max(statistics.fmean(sizes), 1e-12))
            pace = 1 / (1 + statistics.pstdev(minutes) / max(statistics.fmean(minutes), 1e-12))
            if (evenness + pace) / 2 < 0.5 and evenness < 0.4:
                self.target /= 1.1
            if pace < 0.4:
                self.min_minutes = min(self.min_minutes + 1, self.max_minutes / 2)


def calibrate(ticks: DataFrame, kind: str, days: int = 14) -> DataFrame:
    """``symbol, target, second_target`` from each series' first days: median daily size over the bars per day it aims at."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of bars: {kind}")
    from pyspark.sql import Window

    along = Window.partitionBy("symbol").orderBy("ts", "trade_id")
    t = ticks.withColumn("day", F.to_date("ts")).withColumn("first", F.min("day").over(Window.partitionBy("symbol")))
    t = t.filter(F.datediff("day", "first") < days).withColumn("move", F.coalesce(F.abs(F.col("price") / F.lag("price").over(along) - 1), F.lit(0.0)))
    daily = t.groupBy("symbol", "day").agg(
        F.sum(F.col("price") * F.col("quantity")).alias("dollar"), F.sum("quantity").alias("volume"), F.sum("move").alias("path"), ((F.max("price") - F.min("price")) / F.expr("percentile(price, 0.5)")).alias("span")
    )
    size = {"dollar": "dollar", "volume": "volume", "volatility": "path", "range": "span", "renko": "span", "hybrid": "dollar"}[kind]
    second = F.expr("percentile(path, 0.5)") / PER_DAY["hybrid"] if kind == "hybrid" else F.lit(float("inf"))
    return daily.groupBy("symbol").agg((F.expr(f"percentile({size}, 0.5)") / PER_DAY[kind]).alias("target"), second.alias("second_target"))


def info_bars(ticks: DataFrame, kind: str, params: BarParams) -> DataFrame:
    """Bars of one kind from ``symbol, ts, trade_id, price, quantity, is_buyer_maker``, every series with the same start values."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of bars: {kind}")
    return sessions(ticks, ["symbol"], ["ts", "trade_id"], ["ts", "price", "quantity", "is_buyer_maker"], lambda: InfoBars(kind, params), BAR)
