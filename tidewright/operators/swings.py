"""Swing points, breaks of structure and order blocks as one carried-state scan."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .scan import sessions

STRUCTURE = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("event", T.StringType()),
        T.StructField("level", T.DoubleType()),
        T.StructField("bars_since_swing", T.LongType()),
    ]
)


class _Structure:
    """Swings are extremes among ``reach`` bars on both sides, known that much later. A close beyond the last swing is a
    break of structure in the direction of the trend and a change of character against it; the last opposite candle before
    it is the order block. A wick beyond a swing with the close inside is a sweep.
    """

    def __init__(self, reach: int) -> None:
        self.reach, self.window, self.k = reach, deque(maxlen=2 * reach + 1), 0
        self.high: tuple | None = None
        self.low: tuple | None = None
        self.trend = 0
        self.last_down: tuple | None = None
        self.last_up: tuple | None = None

    def push(self, row: tuple) -> list[tuple]:
        ts, o, h, low, c = row
        self.k += 1
        out = []
        self.window.append((ts, h, low, self.k))
        if len(self.window) == 2 * self.reach + 1:
            at, mh, ml, k = self.window[self.reach]
            if mh == max(x[1] for x in self.window):
                self.high = (mh, k)
                out.append((at, "swing_high", mh, 0))
            elif ml == min(x[2] for x in self.window):
                self.low = (ml, k)
                out.append((at, "swing_low", ml, 0))
        if self.high and h > self.high[0]:
            if c > self.high[0]:
                out.append((ts, "bos_up" if self.trend >= 0 else "choch_up", self.high[0], self.k - self.high[1]))
                if self.last_down:
                    out.append((self.last_down[0], "order_block_up", self.last_down[1], self.k - self.last_down[2]))
                self.trend, self.high = 1, None
            else:
                out.append((ts, "sweep_high", self.high[0], self.k - self.high[1]))
        if self.low and low < self.low[0]:
            if c < self.low[0]:
                out.append((ts, "bos_down" if self.trend <= 0 else "choch_down", self.low[0], self.k - self.low[1]))
                if self.last_up:
                    out.append((self.last_up[0], "order_block_down", self.last_up[1], self.k - self.last_up[2]))
                self.trend, self.low = -1, None
            else:
                out.append((ts, "sweep_low", self.low[0], self.k - self.low[1]))
        if c < o:
            self.last_down = (ts, low, self.k)
        elif c > o:
            self.last_up = (ts, h, self.k)
        return out

    def close(self) -> list[tuple]:
        return []


def market_structure(bars: DataFrame, reach: int = 5) -> DataFrame:
    """Events ``symbol, ts, event, level, bars_since_swing`` of ``symbol, ts, o, h, l, c`` bars."""
    return sessions(bars, ["symbol"], ["ts"], ["ts", "o", "h", "l", "c"], lambda: _Structure(reach), STRUCTURE)
