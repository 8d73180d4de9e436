"""Order blocks and what becomes of them: one carried-state scan a series, open blocks in heaps."""

from __future__ import annotations

import heapq
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .scan import sessions

BLOCK = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType()), T.StructField("kind", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in ("top", "bottom", "volume", "balance")),
        T.StructField("made_at", T.TimestampNTZType()), T.StructField("mitigated_at", T.TimestampNTZType()), T.StructField("removed_at", T.TimestampNTZType()),
    ]
)


class _Side:
    """Blocks of one direction. Prices come in mirrored for the bearish side, so that here all is as for the bullish one."""

    def __init__(self, kind: int, by_close: bool) -> None:
        self.kind, self.by_close, self.made = kind, by_close, 0
        self.swing: float | None = None  # the last swing's level, until a close is beyond it
        self.far: tuple | None = None  # since that swing: the lowest bar, of equal ones the last
        self.open: list[tuple] = []  # by bottom, highest first
        self.broken: list[tuple] = []  # by top, lowest first

    def check(self, ts, high: float, low: float, body: float) -> list[tuple]:
        """Blocks that this bar removes; those that it mitigates wait for a later one."""
        out = []
        while self.broken and self.broken[0][0] < high:
            out.append((*heapq.heappop(self.broken)[2], ts))
        reached = body if self.by_close else low
        while self.open and -self.open[0][0] > reached:
            _, n, block = heapq.heappop(self.open)
            heapq.heappush(self.broken, (block[2] if self.kind > 0 else -block[3], n, (*block, ts)))
        return out

    def cross(self, ts, close: float, before: tuple, volumes: list[float]) -> None:
        """A close beyond the last swing makes the lowest bar since then, or the bar before this one, a block."""
        if self.swing is None or close <= self.swing:
            return
        at, top, bottom = self.far or before
        late, early = sum(volumes[-2:]), volumes[-3] if len(volumes) > 2 else 0.0
        most = max(late, early)
        sides = (top, bottom) if self.kind > 0 else (-bottom, -top)
        block = (at, self.kind, *sides, late + early, min(late, early) / most * 100 if most else 100.0, ts)
        self.made += 1
        heapq.heappush(self.open, (-bottom, self.made, block))
        self.swing = None

    def turn(self, level: float) -> None:
        self.swing, self.far = level, None

    def pass_(self, ts, high: float, low: float) -> None:
        if self.far is None or low <= self.far[2]:
            self.far = (ts, high, low)

    def rest(self) -> list[tuple]:
        return [(*b, None, None) for _, _, b in self.open] + [(*b, None) for _, _, b in self.broken]


class _Blocks:
    def __init__(self, by_close: bool) -> None:
        self.up, self.down, self.volumes, self.before = _Side(1, by_close), _Side(-1, by_close), deque(maxlen=3), None

    def push(self, row: tuple) -> list[tuple]:
        ts, o, h, low, c, v, swing = row
        self.volumes.append(v)
        out = self.up.check(ts, h, low, min(o, c)) + self.down.check(ts, -low, -h, -max(o, c))
        if self.before:
            self.up.cross(ts, c, self.before, list(self.volumes))
            self.down.cross(ts, -c, (self.before[0], -self.before[2], -self.before[1]), list(self.volumes))
        self.up.pass_(ts, h, low)
        self.down.pass_(ts, -low, -h)
        if swing == 1:
            self.up.turn(h)
        elif swing == -1:
            self.down.turn(-low)
        self.before = (ts, h, low)
        return out

    def close(self) -> list[tuple]:
        return self.up.rest() + self.down.rest()


def order_blocks(bars: DataFrame, by_close: bool = False) -> DataFrame:
    """Order blocks ``symbol, ts, kind, top, bottom, volume, balance, made_at, mitigated_at, removed_at`` of bars with their swings.

    ``bars`` has ``symbol, ts, o, h, l, c, v, swing`` (1 at a swing high, -1 at a low). The first close above the last swing high makes the
    bar with the lowest low since that swing (of equal ones the last, the swing's own bar if none lies between) a bullish block;
    mirrored for bearish ones. A later low below its bottom (``by_close``: open and close both reach below it) mitigates it, a high
    above its top after that removes it. ``volume`` is that of the bar that made it and the two before, ``balance`` the smaller of
    (the last two, the first) in percent of the larger.
    """
    return sessions(bars, ["symbol"], ["ts"], ["ts", "o", "h", "l", "c", "v", "swing"], lambda: _Blocks(by_close), BLOCK)
