"""Information bars from minute rows, in runs that go on from one another.

A run takes each series' stored state - open bar, last close, parameters, recent bars - works on the rows after it and hands a new
state on; the first state comes from a calibration, whose rows are not made into bars. Any cut of the rows into runs gives the same
bars.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import sessions

# Fixed values of all kinds.
ALPHA_FLOOR, ALPHA_CEILING = 0.03, 0.40
PER_DAY_BOUNDS = (2.0, 100.0)
MIN_MINUTES, MIN_MINUTES_MOST, MAX_MINUTES_LEAST, MAX_MINUTES = 2.0, 60.0, 30.0, 1440.0
MONITOR_EVERY, OPTIMISE_EVERY, COOLDOWN, RECENT, HISTORY, EVENTS = 50, 200, 400, 50, 20, 10
EVEN_SIZES, FAIR_SIZES, EVEN_MINUTES = 0.15, 0.40, (0.3, 0.6)


@dataclass(frozen=True)
class Kind:
    """What sets a kind of bars apart: bounds of its target, what its parameters do when its bars are uneven.

    ``grow``: ``pace`` aims at a tenth more bars a day, ``size`` makes bars larger. ``later`` is added to the shortest duration, up to
    ``latest``. ``capped``: sizes count up to twice the target. ``extreme``: that multiple of the target closes a bar after half of
    the shortest duration. ``second`` bounds another target, of the path of closes.
    """

    bounds: tuple[float, float]
    per_day: float
    grow: str = "pace"
    later: float = 0.0
    latest: float = 0.0
    capped: bool = True
    extreme: float = math.inf
    longest: float = MAX_MINUTES
    second: tuple[float, float] | None = None


KINDS = {
    "dollar": Kind((1e5, 1e9), 4.2, later=2, latest=30, capped=False, extreme=3.0, longest=480.0),
    "volume": Kind((1e3, 5e7), 8.7, grow="size", later=1, latest=15),
    "volatility": Kind((1e-4, 0.2), 4.4),
    "range": Kind((1e-6, 0.5), 4.4, later=1, latest=15),
    "renko": Kind((1e-4, 0.5), 6.0, later=1, latest=15),
    "hybrid": Kind((1e5, 1e9), 8.0, later=2, latest=30, second=(1e-6, 0.5)),
}


def valid(o: float, h: float, low: float, c: float, v: float) -> bool:
    return min(o, h, low, c) > 0 and h >= low and h >= max(o, c) and low <= min(o, c) and v >= 0


def quality(sizes: list[float], minutes: list[float]) -> tuple[float, float]:
    """How even sizes are without their outliers, and how near the spread of durations is to what it should be, 0 to 1 each."""
    s, m = np.array(sizes), np.array(minutes)
    q1, q3 = np.percentile(s, [25, 75])
    for reach in (1.5, 2.5):
        kept = s[(s >= q1 - reach * (q3 - q1)) & (s <= q3 + reach * (q3 - q1))] if q3 > q1 else s
        if len(kept) >= 0.7 * len(s):
            break
    even = 0.5
    if len(kept) > 5 and kept.mean() > 0:
        cv = kept.std() / kept.mean()
        even = 1.0 if cv <= EVEN_SIZES else 1 - 0.3 * (cv - EVEN_SIZES) / (FAIR_SIZES - EVEN_SIZES) if cv <= FAIR_SIZES else max(0.0, 0.7 - 0.7 * (cv - FAIR_SIZES) / 0.6)
    pace = 0.5
    if m.std() > 0:
        cv = m.std() / m.mean()
        pace = cv / EVEN_MINUTES[0] if cv < EVEN_MINUTES[0] else 1.0 if cv <= EVEN_MINUTES[1] else max(0.0, 1 - (cv - EVEN_MINUTES[1]) / 0.8)
    return float(even), float(pace)


@dataclass
class MinuteBars:
    """One series: ``push`` minute rows, get closed bars."""

    kind: str
    spec: Kind
    p: dict
    bar: dict | None = None
    last_close: float | None = None
    last_ts: str | None = None

    @classmethod
    def load(cls, kind: str, spec: Kind, text: str) -> MinuteBars:
        s = json.loads(text)
        return cls(kind, spec, s["p"], s["bar"], s["last_close"], s["last_ts"])

    def dump(self) -> str:
        return json.dumps({"p": self.p, "bar": self.bar, "last_close": self.last_close, "last_ts": self.last_ts})

    def push(self, ts: datetime, o: float, h: float, low: float, c: float, v: float) -> tuple | None:
        self.last_ts = ts.isoformat()
        if min(o, h, low, c) <= 0:
            return None
        good = valid(o, h, low, c, v)
        if not good and self.kind in ("renko", "hybrid"):
            return None
        b, at = self.bar, ts.replace(tzinfo=timezone.utc).timestamp() / 60
        if b is None:
            b = self.bar = {"start": at, "o": o, "h": h, "l": low, "v": 0.0, "size": 0.0, "path": 0.0, "n": 0, "from": o}
        b["h"], b["l"], b["c"], b["end"] = max(b["h"], h), min(b["l"], low), c, at
        b["v"] += v
        b["n"] += 1
        if good:
            self._measure(b, h, low, c, v)
        if self._full(b, at - b["start"]):
            return self._finish()
        return None

    def _measure(self, b: dict, h: float, low: float, c: float, v: float) -> None:
        moved = abs(c - self.last_close) / self.last_close if self.last_close else 0.0
        if self.kind in ("dollar", "hybrid"):
            b["size"] += c * v
        elif self.kind == "volume":
            b["size"] += v
        elif self.kind == "range":
            b["size"] += (h - low) / c
        elif self.kind == "volatility":
            b["size"] += moved
        else:
            b["size"] = abs(c - b["from"]) / b["from"]
        if self.kind in ("volatility", "hybrid"):
            b["path"] += moved
            self.last_close = c

    def _full(self, b: dict, minutes: float) -> bool:
        p = self.p
        full = b["size"] >= p["target"] or self.spec.second is not None and b["path"] >= p["second"]
        extreme = b["size"] >= self.spec.extreme * p["target"] and minutes >= p["min_minutes"] / 2
        return full and minutes >= p["min_minutes"] or minutes >= p["max_minutes"] or extreme

    def _finish(self) -> tuple:
        b, p = self.bar, self.p
        self.bar = None
        minutes, span = b["end"] - b["start"], b["h"] - b["l"]
        # Minutes of a day and an epoch that are whole come back exactly.
        start, end = (datetime.fromtimestamp(b[x] * 60, timezone.utc).replace(tzinfo=None) for x in ("start", "end"))
        row = (start, end, b["o"], b["h"], b["l"], b["c"], b["v"], b["size"], p["target"], b["path"], minutes, b["c"] / b["o"] - 1, span / b["o"], (b["c"] - b["l"]) / span if span > 0 else 0.5, b["n"])
        p["recent"] = [*p["recent"], [b["size"], float(int(minutes))]][-RECENT:]
        self._learn(b)
        return row

    def _learn(self, b: dict) -> None:
        p, a = self.p, self.p["alpha"]
        p["closed"] += 1
        if self.spec.second is None:
            seen = min(b["size"], 2 * p["target"]) if self.spec.capped else b["size"]
            p["target"] = (1 - a) * p["target"] + a * seen
        else:  # only what closed the bar is followed
            for key, size in (("target", b["size"]), ("second", b["path"])):
                if size >= 0.99 * p[key]:
                    p[key] = (1 - a) * p[key] + a * min(size, 2 * p[key])
        p["monitored"] += 1
        p["since"] += 1
        if p["monitored"] >= MONITOR_EVERY:
            p["monitored"] = 0
            self._monitor()
        if p["since"] >= OPTIMISE_EVERY:
            p["since"] = 0
            if (not p["events"] or p["closed"] - p["events"][-1] >= COOLDOWN) and len(p["recent"]) >= RECENT:
                self._optimise()
        self._bound()

    def _monitor(self) -> None:
        p = self.p
        p["history"] = [*p["history"], p["target"]][-HISTORY:]
        if len(p["history"]) >= 5:
            h = np.array(p["history"])
            low, high = max(p["alpha_min"], ALPHA_FLOOR), min(p["alpha_max"], ALPHA_CEILING)
            alpha = low + (high - low) * min(1.0, float(h.std() / h.mean()) / 0.8)
            if abs(alpha - p["alpha"]) > 0.01:
                p["alpha"] = alpha

    def _optimise(self) -> None:
        p, spec = self.p, self.spec
        even, pace = quality([s for s, _ in p["recent"]], [m for _, m in p["recent"]])
        if 0.6 * even + 0.4 * pace < 0.5:
            if even < 0.4 and spec.grow == "size":
                p["target"] = min(p["target"] * 1.15, p["target"] + 10_000)
            elif even < 0.4:
                more = min(PER_DAY_BOUNDS[1], p["per_day"] * 1.1)
                for key in ("target", "second") if spec.second else ("target",):
                    p[key] *= p["per_day"] / more
                p["per_day"] = more
            if pace < 0.4 and spec.later:
                p["min_minutes"] = min(p["min_minutes"] + spec.later, spec.latest)
        p["events"] = [*p["events"], p["closed"]][-EVENTS:]

    def _bound(self) -> None:
        p, spec = self.p, self.spec
        p["alpha"] = max(max(p["alpha_min"], ALPHA_FLOOR), min(min(p["alpha_max"], ALPHA_CEILING), p["alpha"]))
        p["per_day"] = max(PER_DAY_BOUNDS[0], min(PER_DAY_BOUNDS[1], p["per_day"]))
        p["min_minutes"] = max(MIN_MINUTES, min(MIN_MINUTES_MOST, p["min_minutes"]))
        p["max_minutes"] = max(MAX_MINUTES_LEAST, min(MAX_MINUTES, p["max_minutes"]))
        if p["min_minutes"] >= p["max_minutes"]:
            p["max_minutes"] = 2 * p["min_minutes"]
        p["target"] = max(spec.bounds[0], min(spec.bounds[1], p["target"]))
        if spec.second:
            p["second"] = max(spec.second[0], min(spec.second[1], p["second"]))


BAR = T.StructType(
    [
        *(T.StructField(n, T.TimestampNTZType()) for n in ("datetime_start", "datetime_end")),
        *(T.StructField(n, T.DoubleType()) for n in ("open", "high", "low", "close", "volume", "bar_size", "target", "path", "duration_minutes", "bar_return", "price_range", "close_position")),
        T.StructField("tick_count", T.LongType()),
        T.StructField("state", T.StringType()),
    ]
)


def calibrated(minutes: DataFrame, kind: str, rows: int, spec: Kind | None = None, alpha: float = 0.15, alpha_min: float = 0.05, alpha_max: float = 0.35) -> DataFrame:
    """``symbol, state`` to begin with, from each series' first ``rows`` rows: median of the days' sizes over the bars a day it aims at.

    The longest duration is three times what a bar should last, between an hour and the kind's bound. The state counts those rows as
    done; the last close among them is the first reference.
    """
    spec = spec or KINDS[kind]
    order = Window.partitionBy("symbol").orderBy("ts")
    first = minutes.filter("least(o, h, l, c) > 0").withColumn("k_", F.row_number().over(order)).filter(F.col("k_") <= rows)
    first = first.withColumn("moved_", F.coalesce(F.abs(F.col("c") / F.lag("c").over(order) - 1), F.lit(0.0)))
    path, span = F.sum("moved_"), (F.max("h") - F.min("l")) / F.expr("percentile(c, 0.5)")
    size = {"dollar": F.sum(F.col("c") * F.col("v")), "volume": F.sum("v"), "volatility": path, "range": F.sum((F.col("h") - F.col("l")) / F.col("c")), "renko": span, "hybrid": F.sum(F.col("c") * F.col("v"))}[kind]
    days = first.groupBy("symbol", F.to_date("ts").alias("day")).agg(size.alias("size"), path.alias("path"), F.count("*").alias("n"), F.max("ts").alias("last"), F.max_by("c", "ts").alias("close"))
    found = days.groupBy("symbol").agg(F.expr("percentile(size, 0.5)").alias("size"), F.expr("percentile(path, 0.5)").alias("path"), F.avg("n").alias("n"), F.max("last").alias("last"), F.max_by("close", "last").alias("close"))
    aims = lambda x, b: F.greatest(F.lit(float(b[0])), F.least(F.lit(float(b[1])), F.col(x) / spec.per_day))
    longest = F.greatest(F.lit(60.0), F.least(F.lit(float(spec.longest)), F.floor(F.col("n") / spec.per_day * 3).cast("double")))
    fixed = {"alpha": alpha, "alpha_min": alpha_min, "alpha_max": alpha_max, "per_day": spec.per_day}
    p = F.struct(
        aims("size", spec.bounds).alias("target"), (aims("path", spec.second) if spec.second else F.lit(0.0)).alias("second"), F.lit(MIN_MINUTES).alias("min_minutes"), longest.alias("max_minutes"),
        *(F.lit(float(v)).alias(n) for n, v in fixed.items()), *(F.lit(0).alias(n) for n in ("closed", "monitored", "since")), *(F.array().cast("array<double>").alias(n) for n in ("history", "events")), F.array().cast("array<array<double>>").alias("recent"),
    )
    text = F.to_json(F.struct(p.alias("p"), F.lit(None).cast("map<string,double>").alias("bar"), F.col("close").alias("last_close"), F.date_format("last", "yyyy-MM-dd'T'HH:mm:ss").alias("last_ts")), {"ignoreNullFields": "false"})
    return found.select("symbol", text.alias("state"))


class _Run:
    def __init__(self, kind: str, spec: Kind) -> None:
        self.kind, self.spec, self.machine, self.done = kind, spec, None, None

    def push(self, row: tuple) -> list[tuple]:
        ts, o, h, low, c, v, state = row
        if state is not None:
            self.machine = MinuteBars.load(self.kind, self.spec, state)
            self.done = datetime.fromisoformat(self.machine.last_ts) if self.machine.last_ts else None
            return []
        if self.machine is None or self.done is not None and ts <= self.done or None in (o, h, low, c, v):
            return []
        bar = self.machine.push(ts, o, h, low, c, v)
        return [(*bar, None)] if bar else []

    def close(self) -> list[tuple]:
        return [(None,) * (len(BAR) - 1) + (self.machine.dump(),)] if self.machine else []


def minute_bars(minutes: DataFrame, kind: str, states: DataFrame, spec: Kind | None = None) -> DataFrame:
    """Bars that ``symbol, ts, o, h, l, c, v`` close after the stored states, and a row per series whose ``state`` alone is set.

    Rows up to a state's last one are left out, as are rows with a null or a price of 0 or less, and series without a state: those
    want a calibration first. A row that contradicts itself (high below close) counts in the bar's prices, not in its size; renko
    and hybrid bars leave it out. The bar that is open at the end is in the state.
    """
    spec = spec or KINDS[kind]
    need = ["symbol", "ts", "o", "h", "l", "c", "v"]
    rows = minutes.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), *(F.col(c).cast("double").alias(c) for c in need[2:]), F.lit(None).cast("string").alias("state"))
    first = states.select("symbol", F.lit(datetime(1, 1, 1)).cast("timestamp_ntz").alias("ts"), *(F.lit(None).cast("double").alias(c) for c in need[2:]), "state")
    return sessions(rows.unionByName(first), ["symbol"], ["ts"], [*need[1:], "state"], lambda: _Run(kind, spec), BAR)
