"""Backtest of a direction signal with profit target and stop, one position at a time per series.

A bar's signal is acted on at its open: a change of direction closes the position and opens the other one. Then the bar's high
and low are held against target and stop. Prices of the bar are known in no order: with fixed levels, the low side counts as
touched first; with a trailing stop, the stop that held at the bar's beginning is checked before the target, and is raised only
for the bars that follow. What is open in the end stays open. A balance below half of the first one ends trading.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewright.operators.scan import ordered_scan


@dataclass(frozen=True)
class Rules:
    """Shares of the entry price, percent a trade, money."""

    target: float = 0.04
    stop: float = 0.02
    trail: float | None = None  # distance of a trailing stop; None: fixed levels
    activation: float = 0.0  # gain from which the stop trails
    leverage: float = 1.0
    fee: float = 0.05
    slippage: float = 0.02
    balance: float = 1000.0
    size: float = 1000.0
    broken: float = 0.5


COLUMNS = {"closed": T.IntegerType(), "pnl": T.DoubleType(), "reason": T.StringType(), "position": T.IntegerType(), "entry": T.DoubleType(), "balance": T.DoubleType()}


class Account:
    """State of one series; called with the columns of a stretch of it."""

    def __init__(self, rules: Rules) -> None:
        self.r, self.side, self.wish, self.entry, self.level, self.trailing, self.balance = rules, 0, 0, 0.0, 0.0, False, rules.balance

    def __call__(self, x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        rows = [self.bar(*v) for v in zip(x["o"].tolist(), x["h"].tolist(), x["l"].tolist(), x["signal"].tolist(), strict=True)]
        return {name: np.array(c, object if name == "reason" else None) for name, c in zip(COLUMNS, zip(*rows, strict=True), strict=True)}

    def bar(self, o: float, h: float, l: float, signal: float) -> tuple:  # noqa: E741
        self.closed, self.pnl, self.reason = 0, 0.0, None
        if self.balance >= self.r.broken * self.r.balance:
            self.wish = int(signal) if signal == signal and signal != 0 else self.wish
            if self.side and self.side != self.wish:
                self._close(o, "direction change")
            if not self.side and self.wish:
                self._open(o)
            if self.side:
                (self._fixed if self.r.trail is None else self._trailed)(h, l)
        return self.closed, self.pnl, self.reason, self.side, self.entry if self.side else None, self.balance

    def _open(self, price: float) -> None:
        self.side, self.entry = self.wish, price
        self.level, self.trailing = price * (1 - self.side * self.r.stop), self.r.activation <= 0

    def _close(self, price: float, reason: str) -> None:
        self._settle(self.side * (price - self.entry) / self.entry * 100, reason)

    def _settle(self, percent: float, reason: str) -> None:
        pnl = percent * self.r.leverage - self.r.fee - self.r.slippage
        self.closed, self.pnl, self.reason, self.side = self.closed + 1, self.pnl + pnl, reason, 0
        self.balance += self.r.size * pnl / 100

    def _fixed(self, h: float, l: float) -> None:  # noqa: E741
        target, stop = self.entry * (1 + self.side * self.r.target), self.entry * (1 - self.side * self.r.stop)
        low_side, high_side = (l <= stop, h >= target) if self.side > 0 else (l <= target, h >= stop)
        won = (not low_side and high_side) if self.side > 0 else low_side
        if low_side or high_side:
            self._settle(self.r.target * 100 if won else -self.r.stop * 100, "target" if won else "stop")

    def _trailed(self, h: float, l: float) -> None:  # noqa: E741
        target = self.entry * (1 + self.side * self.r.target)
        best, worst = (h, l) if self.side > 0 else (l, h)
        if self.side * (worst - self.level) <= 0:
            self._close(self.level, "trailing")
        elif self.side * (best - target) >= 0:
            self._close(target, "target")
        else:
            self.trailing = self.trailing or self.side * (best - self.entry * (1 + self.side * self.r.activation)) >= 0
            if self.trailing:
                moved = best * (1 - self.side * self.r.trail)
                self.level = max(self.level, moved) if self.side > 0 else min(self.level, moved)


def backtest(bars: DataFrame, rules: Rules = Rules(), by: str = "symbol", ts: str = "ts") -> DataFrame:
    """Per bar of ``bars`` (``o, h, l`` and ``signal``: 1, -1, or 0 and null for no change): trades closed in it, what they paid in
    percent, why, the position after it, its entry price, the balance.
    """
    return ordered_scan(bars, [by], [ts], ["o", "h", "l", "signal"], lambda: Account(rules), COLUMNS)


def trades(run: DataFrame) -> DataFrame:
    """The ledger of a run: its bars with closed trades."""
    return run.filter("closed > 0").select(*[c for c in run.columns if c not in ("position", "entry")])
