"""Market regimes: trend, volatility and momentum states of a series with hysteresis, as one carried-state scan.

Exponential averages run over the whole series; bars of the warm-up, and as many after a gap in time, have no result but
``INSUFFICIENT_DATA`` for labels.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left, insort
from collections import deque
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import Step, ordered_scan, sessions

EPS = 1e-10
NONE, STILL, GAP = "INSUFFICIENT_DATA", "INSUFFICIENT_VOLATILITY", "GAP_DETECTED"


@dataclass(frozen=True)
class RegimeConfig:
    """Fixed values of the engine: speeds, thresholds, hysteresis and lengths."""

    alpha_fast: float = 0.15
    alpha_slow: float = 0.04
    alpha_vol: float = 0.10
    alpha_expansion: float = 0.05
    alpha_z: float = 0.02
    alpha_persistence: float = 0.10
    alpha_confidence: float = 0.02
    alpha_min: float = 0.02
    alpha_max: float = 0.20
    alpha_interval: float = 0.10
    trend: float = 1.0
    vol_high: float = 0.75
    vol_low: float = 0.25
    accelerating: float = 1.5
    transition_in: float = 2.5
    transition_out: float = 1.5
    hysteresis: float = 0.10
    hysteresis_vol: float = 0.15
    min_duration: int = 3
    ring: int = 500
    gap: float = 5.0
    steepness: float = 5.0
    stability_cap: int = 100
    floor: float = 1e-8
    floor_bars: int = 20
    epsilon: float = 0.05
    #: After a gap begin anew, with a row that says so, instead of carrying the averages over it.
    reset_on_gap: bool = False

    @property
    def warmup(self) -> int:
        """Bars until the slowest average has forgotten its seed."""
        return math.ceil(math.log(self.epsilon) / math.log(1 - self.alpha_min))


class _Average:
    """Exponential average that begins at ``seed``, or at its first value."""

    def __init__(self, alpha: float, seed: float | None = None) -> None:
        self.alpha, self.value = alpha, seed

    def __call__(self, x: float) -> float:
        self.value = x if self.value is None else self.alpha * x + (1 - self.alpha) * self.value
        return self.value


class _Spread:
    """Average of values and of their squared distances from it."""

    def __init__(self, alpha: float) -> None:
        self.mean, self.var = _Average(alpha), _Average(alpha, 0.0)

    def __call__(self, x: float) -> float:
        m = self.mean(x)
        return self.var((x - m) ** 2)


class _Held:
    """A label that changes when another one has stood far enough from its threshold for some bars in a row."""

    def __init__(self, bars: int) -> None:
        self.bars, self.label, self.next, self.count = bars, None, None, 0

    def __call__(self, raw: str, distance: float, buffer: float) -> str:
        if self.label is None or raw == "TRANSITION":
            self.label, self.next, self.count = raw, None, 0
        elif raw == self.label or distance <= buffer:
            self.next, self.count = None, 0
        else:
            self.next, self.count = raw, self.count + 1 if self.next == raw else 1
            if self.count >= self.bars:
                self.label, self.next, self.count = raw, None, 0
        return self.label


def _clip(x: float) -> float:
    return max(0.0, min(1.0, x))


class _State:
    def __init__(self, cfg: RegimeConfig) -> None:
        k = self.cfg = cfg
        self.n, self.last_c, self.last_ts, self.z, self.sign = 0, None, None, 0.0, 0
        self.fast, self.slow, self.mean, self.var = _Average(k.alpha_fast), _Average(k.alpha_slow), _Average(k.alpha_z), _Average(k.alpha_z, 0.0)
        self.up, self.down, self.expansion, self.persistence = _Average(k.alpha_vol), _Average(k.alpha_vol), _Average(k.alpha_expansion), _Average(k.alpha_persistence)
        self.spread_z, self.spread_p = _Spread(k.alpha_confidence), _Spread(k.alpha_confidence)
        self.ring, self.sorted, self.interval, self.since_gap, self.quiet = deque(), [], None, None, 0
        self.transition, self.trend, self.vol, self.momentum = False, _Held(k.min_duration), _Held(k.min_duration), _Held(k.min_duration)
        self.label, self.run = None, 0

    def _gap(self, ts: float) -> bool:
        passed, self.last_ts = (0.0 if self.last_ts is None else ts - self.last_ts), ts
        if passed <= 0:
            return False
        if self.interval is None:
            self.interval = passed
        elif passed > self.cfg.gap * self.interval:
            self.interval = None
            return True
        else:
            self.interval = self.cfg.alpha_interval * passed + (1 - self.cfg.alpha_interval) * self.interval
        return False

    def _rank(self, level: float) -> float:
        rank = bisect_left(self.sorted, level) / len(self.sorted) if self.sorted else 0.0
        self.ring.append(level)
        insort(self.sorted, level)
        if len(self.ring) > self.cfg.ring:
            self.sorted.pop(bisect_left(self.sorted, self.ring.popleft()))
        return rank

    def step(self, ts: float, c: float) -> tuple:
        k = self.cfg
        gap = self._gap(ts)
        if gap and k.reset_on_gap:
            self.__init__(k)
            self.step(ts, c)
            return (GAP,) * 4 + (math.nan,) * (len(OUT) - 4)
        self.since_gap = 0 if gap else None if self.since_gap is None else self.since_gap + 1
        r = math.log(c / self.last_c) if self.last_c else 0.0
        self.last_c, self.n = c, self.n + 1
        raw = math.log(self.fast(c) / self.slow(c))
        before = self.z
        self.z = z = (raw - self.mean.value) / math.sqrt(self.var.value + EPS) if self.n > 1 else 0.0
        self.var((raw - self.mean(raw)) ** 2)
        persistence = self.persistence(float(np.sign(r)))
        up, down = math.sqrt(self.up(max(r, 0.0) ** 2)), math.sqrt(self.down(max(-r, 0.0) ** 2))
        level = max(up, down)
        pct = self._rank(level)
        pressure = abs(z - before) * level / (self.expansion(level) + EPS)
        sd_z, sd_p = math.sqrt(self.spread_z(abs(z))) + EPS, math.sqrt(self.spread_p(pressure)) + EPS
        sign = int(np.sign(z))
        if self.transition:
            self.transition = pressure >= k.transition_out
        else:
            self.transition = sign != self.sign and self.sign != 0 and pressure > k.transition_in
        self.sign = sign
        self.quiet = self.quiet + 1 if level < k.floor else 0
        trend = vol = momentum = label = NONE
        if self.n >= k.warmup:
            buffer = k.hysteresis + k.hysteresis_vol * pct
            raw_trend = "TRANSITION" if self.transition else "BULL" if z > k.trend else "BEAR" if z < -k.trend else "RANGE"
            trend = self.trend(raw_trend, abs(abs(z) - k.trend), buffer)
            vol = self.vol("HIGH_VOL" if pct > k.vol_high else "LOW_VOL" if pct < k.vol_low else "NORMAL_VOL", min(abs(pct - k.vol_high), abs(pct - k.vol_low)), buffer)
            momentum = self.momentum("ACCELERATING" if pressure > k.accelerating else "STABLE", abs(pressure - k.accelerating), buffer)
            trend = "TRANSITION" if self.transition else trend
            label = "TRANSITION" if trend == "TRANSITION" else f"{trend}_{vol}_{momentum}"
        masked = self.n < k.warmup or self.since_gap is not None and self.since_gap < k.warmup - 1
        if self.quiet >= k.floor_bars and not masked:
            trend = vol = momentum = label = STILL
        self.run, self.label = (self.run + 1 if label == self.label else 1), label
        if masked:
            return (NONE,) * 4 + (math.nan,) * (len(OUT) - 4)
        confidence = _clip((_clip((abs(z) - k.trend) / sd_z) + _clip(abs(pct - 0.5) / 0.25) + _clip((pressure - k.accelerating) / sd_p)) / (3 + EPS))
        soft = lambda x: 1 / (1 + math.exp(-max(-50.0, min(50.0, k.steepness * x))))
        scores = (z - k.trend, -z - k.trend, k.trend - abs(z), pressure - k.transition_in, pct - k.vol_high, k.vol_low - pct, pressure - k.accelerating)
        return trend, vol, momentum, label, confidence, z, pct, pressure, min(self.run / k.stability_cap, 1.0), down / (up + EPS), z - before, k.alpha_min + (k.alpha_max - k.alpha_min) * pct, up, down, persistence, *map(soft, scores)


    # What a later run goes on from, as JSON: numbers come back as they were.

    _PLAIN = "n last_c last_ts z sign interval since_gap quiet transition label run".split()
    _AVERAGES = "fast slow mean var up down expansion persistence".split()

    def dump(self) -> str:
        held = {n: [getattr(self, n).label, getattr(self, n).next, getattr(self, n).count] for n in ("trend", "vol", "momentum")}
        spreads = {n: [getattr(self, n).mean.value, getattr(self, n).var.value] for n in ("spread_z", "spread_p")}
        return json.dumps({**{n: getattr(self, n) for n in self._PLAIN}, **{n: getattr(self, n).value for n in self._AVERAGES}, **spreads, **held, "ring": list(self.ring)})

    @classmethod
    def load(cls, cfg: RegimeConfig, text: str) -> _State:
        found, out = json.loads(text), cls(cfg)
        for n in cls._PLAIN:
            setattr(out, n, found[n])
        for n in cls._AVERAGES:
            getattr(out, n).value = found[n]
        for n in ("spread_z", "spread_p"):
            getattr(out, n).mean.value, getattr(out, n).var.value = found[n]
        for n in ("trend", "vol", "momentum"):
            h = getattr(out, n)
            h.label, h.next, h.count = found[n]
        out.ring, out.sorted = deque(found["ring"]), sorted(found["ring"])
        return out


OUT = {
    **dict.fromkeys(("regime_trend", "regime_volatility", "regime_momentum", "regime_label"), T.StringType()),
    **dict.fromkeys(
        "regime_confidence trend_strength_z vol_percentile transition_pressure regime_stability volatility_skew trend_acceleration adaptive_alpha up_vol down_vol directional_persistence "
        "score_bull score_bear score_range score_transition score_high_vol score_low_vol score_accelerating".split(),
        T.DoubleType(),
    ),
}


def regime_engine(bars: DataFrame, cfg: RegimeConfig = RegimeConfig(), by: str = "symbol", order: str = "ts") -> DataFrame:
    """Regime columns (:data:`OUT`) for every bar; numbers are null and labels ``INSUFFICIENT_DATA`` in the warm-up and after a gap."""

    def make() -> Step:
        state = _State(cfg)

        def step(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            seconds = x[order].astype("datetime64[us]").astype(np.int64) / 1e6
            rows = [state.step(t, c) for t, c in zip(seconds.tolist(), x["c"].tolist(), strict=True)]
            return {n: np.array(col, object if isinstance(t, T.StringType) else float) for (n, t), col in zip(OUT.items(), zip(*rows, strict=True), strict=True)}

        return step

    return ordered_scan(bars, [by], [order], ["c", order], make, OUT)


class _Resumed:
    """A series' bars after those of its stored state, which comes as its first row; the last bar's row has the new state."""

    def __init__(self, cfg: RegimeConfig) -> None:
        self.cfg, self.state, self.waiting = cfg, _State(cfg), None

    def push(self, row: tuple) -> list[tuple]:
        ts, c, stored = row
        if stored is not None:
            self.state = _State.load(self.cfg, stored)
            return []
        at = ts.replace(tzinfo=timezone.utc).timestamp()
        if c is None or self.state.last_ts is not None and at <= self.state.last_ts:
            return []
        out, self.waiting = [self.waiting] if self.waiting else [], (ts, *(None if v != v else v for v in self.state.step(at, c)), None)
        return out

    def close(self) -> list[tuple]:
        return [(*self.waiting[:-1], self.state.dump())] if self.waiting else []


def regime_update(bars: DataFrame, states: DataFrame | None = None, cfg: RegimeConfig = RegimeConfig(), by: str = "symbol", order: str = "ts") -> DataFrame:
    """:func:`regime_engine` on the bars that come after a stored state: its columns and ``state``, which each series' last row has.

    ``states`` holds ``by, state`` of an earlier run; series without one begin anew. Bars up to a state's last one have been processed and
    are left out, as are bars without a close and bars of a time that has been. Series without new bars have no rows: their state stays.
    """
    ntz = bars.select(by, F.col(order).cast("timestamp_ntz").alias(order), F.col("c").cast("double").alias("c"), F.lit(None).cast("string").alias("state"))
    if states is not None:
        ntz = ntz.unionByName(states.select(by, F.lit(datetime(1, 1, 1)).cast("timestamp_ntz").alias(order), F.lit(None).cast("double").alias("c"), "state"))
    schema = T.StructType([T.StructField(order, T.TimestampNTZType()), *(T.StructField(n, t) for n, t in OUT.items()), T.StructField("state", T.StringType())])
    return sessions(ntz, [by], [order], [order, "c", "state"], lambda: _Resumed(cfg), schema)
