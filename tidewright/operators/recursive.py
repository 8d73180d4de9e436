"""Indicators that feed on their own last value, as carried-state scans."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .scan import Step, ordered_scan

NAN = float("nan")


class Ema:
    """Exponential average; ``seed`` values are averaged first, nothing comes out before."""

    def __init__(self, n: int, seed: int = 0, alpha: float | None = None) -> None:
        self.alpha, self.seed, self.seen, self.value = alpha if alpha is not None else 2 / (n + 1), seed, 0, 0.0

    def __call__(self, x: float) -> float:
        if x != x:
            return NAN
        self.seen += 1
        if self.seen <= max(self.seed, 1):
            self.value += (x - self.value) / self.seen
            return self.value if self.seen >= self.seed else NAN
        self.value += self.alpha * (x - self.value)
        return self.value


def wilder(n: int) -> Ema:
    return Ema(n, n, 1 / n)


class TrueRange:
    def __init__(self) -> None:
        self.last = NAN

    def __call__(self, h: float, low: float, c: float) -> float:
        tr = h - low if self.last != self.last else max(h - low, abs(h - self.last), abs(low - self.last))
        self.last = c
        return tr


class Rsi:
    def __init__(self, n: int = 14) -> None:
        self.up, self.down, self.last = wilder(n), wilder(n), NAN

    def __call__(self, c: float) -> float:
        last, self.last = self.last, c
        if last != last:
            return NAN
        up, down = self.up(max(c - last, 0.0)), self.down(max(last - c, 0.0))
        return 100 * up / (up + down) if up + down > 0 else (NAN if up != up else 0.0)


class Adx:
    """Directional movement: +DI, -DI, DX and ADX."""

    def __init__(self, n: int = 14) -> None:
        self.tr, self.plus, self.minus, self.adx = wilder(n), wilder(n), wilder(n), wilder(n)
        self.h = self.low = self.c = NAN

    def __call__(self, h: float, low: float, c: float) -> tuple[float, float, float, float]:
        ph, pl, pc = self.h, self.low, self.c
        self.h, self.low, self.c = h, low, c
        if pc != pc:
            return NAN, NAN, NAN, NAN
        up, down = h - ph, pl - low
        tr = self.tr(max(h - low, abs(h - pc), abs(low - pc)))
        plus, minus = self.plus(up if up > down and up > 0 else 0.0), self.minus(down if down > up and down > 0 else 0.0)
        if tr != tr or tr <= 0:
            return NAN, NAN, NAN, NAN
        p, m = 100 * plus / tr, 100 * minus / tr
        dx = 100 * abs(p - m) / (p + m) if p + m > 0 else 0.0
        return p, m, dx, self.adx(dx)


class Kama:
    def __init__(self, n: int = 30) -> None:
        self.n, self.past, self.value = n, [], NAN

    def __call__(self, c: float) -> float:
        self.past.append(c)
        if len(self.past) <= self.n:
            return NAN
        if len(self.past) > self.n + 1:
            self.past.pop(0)
        moves = sum(abs(b - a) for a, b in zip(self.past, self.past[1:], strict=False))
        er = abs(c - self.past[0]) / moves if moves > 0 else 1.0
        s = (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2
        self.value = (self.past[-2] if self.value != self.value else self.value) + s * (c - (self.past[-2] if self.value != self.value else self.value))
        return self.value


class Supertrend:
    def __init__(self, n: int = 10, mult: float = 3.0) -> None:
        self.atr, self.tr, self.mult = wilder(n), TrueRange(), mult
        self.upper = self.lower = self.last = NAN
        self.trend = 1

    def __call__(self, h: float, low: float, c: float) -> tuple[float, float]:
        atr = self.atr(self.tr(h, low, c))
        last, self.last = self.last, c
        if atr != atr:
            return NAN, NAN
        mid = (h + low) / 2
        up, down = mid + self.mult * atr, mid - self.mult * atr
        if self.upper == self.upper:
            up = up if up < self.upper or last > self.upper else self.upper
            down = down if down > self.lower or last < self.lower else self.lower
            self.trend = 1 if c > self.upper else -1 if c < self.lower else self.trend
        self.upper, self.lower = up, down
        return (down if self.trend > 0 else up), float(self.trend)


class Sar:
    def __init__(self, step: float = 0.02, most: float = 0.2) -> None:
        self.step, self.most, self.rising, self.sar, self.ep, self.af = step, most, True, NAN, NAN, step
        self.h = self.low = NAN

    def __call__(self, h: float, low: float) -> float:
        ph, pl = self.h, self.low
        self.h, self.low = h, low
        if ph != ph:
            return NAN
        if self.sar != self.sar:
            self.rising = not (pl - low > max(h - ph, 0.0))
            self.sar, self.ep = (pl, h) if self.rising else (ph, low)
        else:
            self.sar += self.af * (self.ep - self.sar)
            self.sar = min(self.sar, pl) if self.rising else max(self.sar, ph)
        if (self.rising and low < self.sar) or (not self.rising and h > self.sar):
            self.rising, self.sar = not self.rising, self.ep
            self.ep, self.af = (h if self.rising else low), self.step
        elif (self.rising and h > self.ep) or (not self.rising and low < self.ep):
            self.ep, self.af = (h if self.rising else low), min(self.af + self.step, self.most)
        return self.sar


class SarExt(Sar):
    """The stop with its side in the sign: negative while falling."""

    def __call__(self, h: float, low: float) -> float:
        value = super().__call__(h, low)
        return value if self.rising else -value


class Mama:
    """Adaptive average by the phase of the dominant cycle, and its follower."""

    # Taps of the discrete Hilbert transform.
    TAPS = (0.0962, 0.0, 0.5769, 0.0, -0.5769, 0.0, -0.0962)

    def __init__(self, fast: float = 0.5, slow: float = 0.05) -> None:
        self.fast, self.slow, self.seen = fast, slow, 0
        self.price, self.smooth, self.detrended, self.q, self.i = ([0.0] * 7 for _ in range(5))
        self.i2 = self.q2 = self.re = self.im = self.period = self.phase = 0.0
        self.mama = self.fama = NAN

    def _turned(self, past: list[float], scale: float) -> float:
        return sum(w * x for w, x in zip(self.TAPS, past, strict=True)) * scale

    def __call__(self, x: float) -> tuple[float, float]:
        self.seen += 1
        shift = lambda past, v: past.__setitem__(slice(None), [v, *past[:-1]])
        shift(self.price, x)
        if self.mama != self.mama:
            self.mama = self.fama = x
        if self.seen < 7:
            return NAN, NAN
        p = self.price
        shift(self.smooth, (4 * p[0] + 3 * p[1] + 2 * p[2] + p[3]) / 10)
        scale = 0.075 * self.period + 0.54
        shift(self.detrended, self._turned(self.smooth, scale))
        shift(self.q, self._turned(self.detrended, scale))
        shift(self.i, self.detrended[3])
        i2, q2 = self.i[0] - self._turned(self.q, scale), self.q[0] + self._turned(self.i, scale)
        before_i, before_q = self.i2, self.q2
        self.i2, self.q2 = 0.2 * i2 + 0.8 * before_i, 0.2 * q2 + 0.8 * before_q
        self.re = 0.2 * (self.i2 * before_i + self.q2 * before_q) + 0.8 * self.re
        self.im = 0.2 * (self.i2 * before_q - self.q2 * before_i) + 0.8 * self.im
        period = self.period
        if self.im and self.re:
            period = 2 * math.pi / math.atan(self.im / self.re)
        period = min(max(period, 0.67 * self.period), 1.5 * self.period if self.period else period)
        self.period = 0.2 * min(max(period, 6.0), 50.0) + 0.8 * self.period
        phase = math.degrees(math.atan(self.q[0] / self.i[0])) if self.i[0] else self.phase
        delta, self.phase = max(self.phase - phase, 1.0), phase
        alpha = max(self.fast / delta, self.slow)
        self.mama += alpha * (x - self.mama)
        self.fama += 0.5 * alpha * (self.mama - self.fama)
        return (self.mama, self.fama) if self.seen > 32 else (NAN, NAN)


class Cusum:
    """Symmetric filter: 1 or -1 where the sum of moves passes ``h``; the side that fired starts anew."""

    def __init__(self, h: float) -> None:
        self.h, self.up, self.down = h, 0.0, 0.0

    def __call__(self, r: float) -> float:
        if r != r:
            return 0.0
        self.up, self.down = max(0.0, self.up + r), min(0.0, self.down + r)
        if self.down < -self.h:
            self.down = 0.0
            return -1.0
        if self.up > self.h:
            self.up = 0.0
            return 1.0
        return 0.0


class _Last:
    """The values ``n`` rows ago."""

    def __init__(self, n: int) -> None:
        self.past = [NAN] * n

    def __call__(self, x: float) -> float:
        self.past.append(x)
        return self.past.pop(0)


NAMES = (
    "ema_5 ema_12 ema_20 ema_26 ema_50 ema_200 dema_20 tema_20 t3_5 trix_15 macd macd_signal macd_hist rsi_14 rsi_slope cmo_14 atr_14 natr_14 atr_percent keltner_upper bb_squeeze adx_14 plus_di minus_di dx adx_slope kama_30 "
    "adxr_14 stochrsi_k stochrsi_d sarext mama fama supertrend supertrend_dir sar volume_ema_ratio volume_compression range_compression_ratio chaikin_oscillator ema_slope cusum ewm_vol"
).split()


def _indicators() -> Step:
    e = {n: Ema(n, n) for n in (5, 12, 20, 26, 50, 200)}
    signal, rsi, tr, atr, atr5, atr20, adx = Ema(9, 9), Rsi(), TrueRange(), wilder(14), wilder(5), wilder(20), Adx()
    d2, t2, t3 = Ema(20, 20), Ema(20, 20), Ema(20, 20)
    chain, triple = [Ema(5, 5) for _ in range(6)], [Ema(15, 15) for _ in range(3)]
    kama, trend, sar, v5, v20, c3, c10 = Kama(), Supertrend(), Sar(), Ema(5), Ema(20), Ema(3), Ema(10)
    rsi3, adx5, ema5, last_triple, keltner = _Last(3), _Last(5), _Last(5), _Last(1), wilder(10)
    adx13, sarext, mama, strength, fastk = _Last(13), SarExt(), Mama(), [], []
    cusum, mean, var = Cusum(0.5), Ema(50), Ema(50)
    window: list[float] = []
    state = {"c": NAN, "ad": 0.0}

    def step(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out: dict[str, list[float]] = {n: [] for n in NAMES}
        for h, low, c, v in zip(x["h"].tolist(), x["l"].tolist(), x["c"].tolist(), x["v"].tolist(), strict=True):
            row = {f"ema_{n}": f(c) for n, f in e.items()}
            e20 = row["ema_20"]
            dd = d2(e20)
            row["dema_20"] = 2 * e20 - dd
            tt = t2(e20)
            row["tema_20"] = 3 * e20 - 3 * tt + t3(tt)
            g = c
            parts = []
            for f in chain:
                g = f(g)
                parts.append(g)
            b = 0.7
            row["t3_5"] = -(b**3) * parts[5] + (3 * b**2 + 3 * b**3) * parts[4] + (-6 * b**2 - 3 * b - 3 * b**3) * parts[3] + (1 + 3 * b + b**3 + 3 * b**2) * parts[2]
            g = c
            for f in triple:
                g = f(g)
            before = last_triple(g)
            row["trix_15"] = 100 * (g / before - 1) if before == before and before else NAN
            macd = row["ema_12"] - row["ema_26"]
            row["macd"], row["macd_signal"] = macd, signal(macd)
            row["macd_hist"] = macd - row["macd_signal"]
            value = rsi(c)
            row["rsi_14"], row["rsi_slope"], row["cmo_14"] = value, (value - rsi3(value)) / 3, 2 * value - 100
            true = tr(h, low, c)
            a, k10 = atr(true), keltner(true)
            row["atr_14"], row["natr_14"], row["atr_percent"] = a, 100 * a / c, 100 * a / (c + 1e-8)
            row["keltner_upper"] = e20 + 2 * k10
            window.append(c)
            if len(window) > 20:
                window.pop(0)
            m = sum(window) / len(window)
            sd = math.sqrt(max(sum((w - m) ** 2 for w in window) / len(window), 0.0))
            row["bb_squeeze"] = 4 * sd / (3 * a) if len(window) == 20 and a == a and a > 1e-8 else NAN
            row["plus_di"], row["minus_di"], row["dx"], row["adx_14"] = adx(h, low, c)
            row["adx_slope"] = (row["adx_14"] - adx5(row["adx_14"])) / 5
            row["adxr_14"] = (row["adx_14"] + adx13(row["adx_14"])) / 2
            strength.append(value)
            del strength[:-14]
            low14, high14 = (min(strength), max(strength)) if len(strength) == 14 and strength[0] == strength[0] else (NAN, NAN)
            row["stochrsi_k"] = (100 * (value - low14) / (high14 - low14) if high14 > low14 else 0.0) if high14 == high14 else NAN
            fastk.append(row["stochrsi_k"])
            del fastk[:-3]
            row["stochrsi_d"] = sum(fastk) / 3 if len(fastk) == 3 else NAN
            row["sarext"] = sarext(h, low)
            row["mama"], row["fama"] = mama(c)
            row["kama_30"] = kama(c)
            row["supertrend"], row["supertrend_dir"] = trend(h, low, c)
            row["sar"] = sar(h, low)
            fast, slow = v5(v), v20(v)
            row["volume_ema_ratio"] = fast / slow if slow > 1e-8 else NAN
            row["volume_compression"] = v / slow if slow > 1e-8 else NAN
            short, long = atr5(true), atr20(true)
            row["range_compression_ratio"] = short / long if long == long and long > 1e-8 else NAN
            state["ad"] += ((c - low) - (h - c)) / (h - low) * v if h > low else 0.0
            row["chaikin_oscillator"] = c3(state["ad"]) - c10(state["ad"])
            row["ema_slope"] = (e20 - ema5(e20)) / 5
            r = math.log(c / state["c"]) if state["c"] == state["c"] else NAN
            state["c"] = c
            row["cusum"] = cusum(r)
            if r == r:
                mu = mean(r)
                row["ewm_vol"] = math.sqrt(max(var((r - mu) ** 2), 0.0))
            else:
                row["ewm_vol"] = NAN
            for n in NAMES:
                out[n].append(row[n])
        return {n: np.array(v, float) for n, v in out.items()}

    return step


def recursive_indicators(bars: DataFrame, by: str = "symbol", order: str = "ts") -> DataFrame:
    """All of :data:`NAMES` in one sort and one pass over ``h, l, c, v``; null until an indicator has its first value."""
    return ordered_scan(bars, [by], [order], ["h", "l", "c", "v"], _indicators, dict.fromkeys(NAMES, T.DoubleType()))


def simple_ema(bars: DataFrame, n: int, by: str = "symbol", order: str = "ts") -> DataFrame:
    """Exponential average of the close that starts with the first close."""

    def make() -> Callable:
        ema = Ema(n)
        return lambda x: {"ema": np.array([ema(c) for c in x["c"].tolist()])}

    return ordered_scan(bars, [by], [order], ["c"], make, {"ema": T.DoubleType()})
