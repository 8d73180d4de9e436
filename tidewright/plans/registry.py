"""Registered queries of the time-series engine and their twins in the checking engine."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .dialect import Dialect, Duck, Spark
from tidewright.operators import backtest, info_bars, montecarlo, recursive, regimes, swings, touches, window_stats

from tidewright.sources.staging import staged

from . import checked, modelling, portfolio, research, structure  # noqa: F401  they register their queries
from .series import SERIES, STEPS, _signals, _swings, bars, ledger, ticks

FLAGSHIP = "features_returns"
_TABLE = re.compile(r"\{(\w+)\}")


def run_sql(spark: SparkSession, text: str, sf_dir: str) -> DataFrame:
    """Run SQL whose ``{table}`` marks are Parquet tables of a folder, or steps, each run once."""
    kept: dict[str, DataFrame] = {}

    def table(name: str) -> DataFrame:
        if name not in kept:
            kept[name] = staged(resolve(f"SELECT * FROM {STEPS[name](Spark())} s")) if name in STEPS else spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return kept[name]

    def resolve(text: str) -> DataFrame:
        return spark.sql(text, **{t: table(t) for t in sorted(set(_TABLE.findall(text)))})

    return resolve(text)


def _query(make: Callable[[Dialect], str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_sql(spark, make(Spark()), sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(make) for name, make in SERIES.items()}
ORACLES: dict[str, str] = {name: _TABLE.sub(r"\1", make(Duck())) for name, make in SERIES.items()}


# ---- sequential operators: one sort and one pass per series -----------------------------------------------------------------


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, f"SELECT * FROM {bars(Spark())} b", sf_dir)


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, f"SELECT * FROM {ticks()} t", sf_dir)


def _info(kind: str, params: info_bars.BarParams):
    return lambda spark, sf_dir: info_bars.info_bars(_ticks(spark, sf_dir), kind, params)


_BAR_PARAMS = {
    "dollar": info_bars.BarParams(60_000.0), "volume": info_bars.BarParams(250.0), "volatility": info_bars.BarParams(60.0), "range": info_bars.BarParams(50.0),
    "renko": info_bars.BarParams(20.0), "hybrid": info_bars.BarParams(60_000.0, second_target=100.0),
}
_BAR_NUMBERS = "open high low close volume dollar_volume vwap bar_size target duration_minutes buy_share bar_return price_range close_position".split()


def _bars_of(kind: str, p: info_bars.BarParams):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _info(kind, p)(spark, sf_dir).selectExpr("symbol", "datetime_start", "datetime_end", *[f"round({n}, 6) + 0D AS {n}" for n in _BAR_NUMBERS], "tick_count", "direction")

    return query


def _bars_sql(kind: str, p: info_bars.BarParams) -> str:
    """The open bar and its parameters carried from tick to tick."""
    size = {"dollar": "d", "volume": "v", "volatility": "path", "range": "(h - l) / price", "renko": "abs(price - ref) / ref", "hybrid": "d"}[kind]
    full = f"size >= target OR path >= {p.second_target}" if kind == "hybrid" else "size >= target"
    rows = f"rows AS MATERIALIZED (SELECT symbol, ts, price, quantity, is_buyer_maker AS seller, row_number() OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS k FROM {ticks()} t WHERE price > 0 AND quantity > 0)"
    carried = "o h l v d buy path".split()
    first = f"SELECT symbol, CAST(0 AS BIGINT) AS k, false AS running, CAST(NULL AS TIMESTAMP) AS start, {', '.join(f'0e0 AS {n}' for n in carried)}, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS ref, CAST(NULL AS DOUBLE) AS last, {p.target}::DOUBLE AS target, {p.alpha}::DOUBLE AS alpha, {p.min_minutes}::DOUBLE AS mn, CAST(0 AS BIGINT) AS closed, CAST(0 AS BIGINT) AS tuned, []::DOUBLE[] AS targets, []::DOUBLE[] AS sizes, []::DOUBLE[] AS mins, false AS done, CAST(NULL AS TIMESTAMP) AS ts, 0e0 AS price, 0e0 AS size, 0e0 AS minutes, 0e0 AS was FROM rows WHERE k = 1"
    a = f"SELECT r.symbol, r.k, r.ts, r.price, a.target, a.alpha, a.mn, a.closed, a.tuned, a.targets, a.sizes, a.mins, CASE WHEN a.running THEN a.start ELSE r.ts END AS start, CASE WHEN a.running THEN a.o ELSE r.price END AS o, CASE WHEN a.running THEN greatest(a.h, r.price) ELSE r.price END AS h, CASE WHEN a.running THEN least(a.l, r.price) ELSE r.price END AS l, CASE WHEN a.running THEN a.v ELSE 0 END + r.quantity AS v, CASE WHEN a.running THEN a.d ELSE 0 END + r.price * r.quantity AS d, CASE WHEN a.running THEN a.buy ELSE 0 END + CASE WHEN r.seller THEN 0 ELSE r.price * r.quantity END AS buy, CASE WHEN a.running THEN a.path ELSE 0 END + CASE WHEN a.last IS NULL THEN 0 ELSE abs(r.price - a.last) / a.last END AS path, CASE WHEN a.running THEN a.n ELSE 0 END + 1 AS n, coalesce(a.ref, r.price) AS ref FROM acc a JOIN rows r ON r.symbol = a.symbol AND r.k = a.k + 1"
    b = f"SELECT *, {size} AS size, (epoch(ts) - epoch(start)) / 60 AS minutes FROM ({a})"
    c = f"SELECT *, (({full}) AND minutes >= mn) OR minutes >= {p.max_minutes} AS done FROM ({b})"
    seen = "size" if kind == "dollar" else "least(size, 2 * target)"
    e = f"SELECT *, closed + done::INT AS closed2, CASE WHEN done THEN (1 - alpha) * target + alpha * {seen} ELSE target END AS target2, CASE WHEN done THEN list_append(sizes[-199:], size) ELSE sizes END AS sizes2, CASE WHEN done THEN list_append(mins[-199:], minutes) ELSE mins END AS mins2 FROM ({c})"
    f = f"SELECT *, CASE WHEN done THEN list_append(targets[-19:], target2) ELSE targets END AS targets2, done AND closed2 % {p.optimise_every} = 0 AND closed2 - tuned >= least({p.cooldown}, closed2) AND len(sizes2) >= 50 AS tune FROM ({e})"
    g = f"SELECT *, CASE WHEN done AND closed2 % {p.monitor_every} = 0 AND len(targets2) >= 5 THEN {p.alpha_min} + {p.alpha_max - p.alpha_min!r} * least(1e0, list_stddev_pop(targets2) / list_avg(targets2) / 0.8) ELSE alpha END AS alpha2, 1 / (1 + list_stddev_pop(sizes2) / greatest(list_avg(sizes2), 1e-12)) AS even, 1 / (1 + list_stddev_pop(mins2) / greatest(list_avg(mins2), 1e-12)) AS pace FROM ({f})"
    step = f"SELECT symbol, k, NOT done AS running, start, {', '.join(carried)}, n, CASE WHEN done THEN price ELSE ref END AS ref, price AS last, CASE WHEN tune AND (even + pace) / 2 < 0.5 AND even < 0.4 THEN target2 / 1.1 ELSE target2 END AS target, CASE WHEN abs(alpha2 - alpha) > 0.01 THEN alpha2 ELSE alpha END AS alpha, CASE WHEN tune AND pace < 0.4 THEN least(mn + 1, {p.max_minutes / 2}) ELSE mn END AS mn, closed2 AS closed, CASE WHEN tune THEN closed2 ELSE tuned END AS tuned, targets2 AS targets, sizes2 AS sizes, mins2 AS mins, done, ts, price, size, minutes, target AS was FROM ({g})"
    values = ("o", "h", "l", "price", "v", "d", "d / v", "size", "was", "minutes", "buy / d", "price / o - 1", "(h - l) / o", "CASE WHEN h > l THEN (price - l) / (h - l) ELSE 0.5 END")
    numbers = ", ".join(f"round({v}, 6) + 0e0 AS {name}" for v, name in zip(values, _BAR_NUMBERS, strict=True))
    return f"WITH RECURSIVE {rows}, acc AS ({first} UNION ALL {step}) SELECT symbol, start AS datetime_start, ts AS datetime_end, {numbers}, n AS tick_count, CASE WHEN price >= o THEN 'bullish' ELSE 'bearish' END AS direction FROM acc WHERE done"


for _kind, _p in _BAR_PARAMS.items():
    QUERIES[f"bars_{_kind}"] = _bars_of(_kind, _p)
    ORACLES[f"bars_{_kind}"] = _TABLE.sub(r"\1", _bars_sql(_kind, _p))


def _calibration(kind: str):
    """Query and twin of one kind's start values."""
    size = {"dollar": "sum(price * quantity)", "volume": "sum(quantity)", "volatility": "sum(move)", "hybrid": "sum(price * quantity)"}.get(kind, "(max(price) - min(price)) / quantile_cont(price, 0.5)")
    moves = f"SELECT *, CAST(ts AS DATE) AS day, min(CAST(ts AS DATE)) OVER (PARTITION BY symbol) AS first, coalesce(abs(price / lag(price) OVER (PARTITION BY symbol ORDER BY ts, trade_id) - 1), 0) AS move FROM {ticks()} t"
    per_day = f"SELECT symbol, day, {size} AS size FROM ({moves}) m WHERE date_diff('day', first, day) < 14 GROUP BY symbol, day"
    twin = f"SELECT symbol, round(quantile_cont(size, 0.5) / {info_bars.PER_DAY[kind]}, 4) AS target FROM ({per_day}) d GROUP BY symbol"
    return lambda spark, sf_dir: info_bars.calibrate(_ticks(spark, sf_dir), kind).selectExpr("symbol", "round(target, 4) AS target"), _TABLE.sub(r"\1", twin)


for _kind in info_bars.KINDS:
    QUERIES[f"calibrate_{_kind}"], ORACLES[f"calibrate_{_kind}"] = _calibration(_kind)
QUERIES["indicators_recursive"] = lambda spark, sf_dir: recursive.recursive_indicators(_bars(spark, sf_dir))
QUERIES["window_stats"] = lambda spark, sf_dir: window_stats.window_stats(_bars(spark, sf_dir))
QUERIES["smc_structure"] = lambda spark, sf_dir: swings.market_structure(_bars(spark, sf_dir))


def _ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recursive.simple_ema(_bars(spark, sf_dir), 12).selectExpr("symbol", "ts", "round(ema, 6) AS ema")


QUERIES["ema_recursive"] = _ema
_D = Duck()
ORACLES["ema_recursive"] = _TABLE.sub(
    r"\1",
    f"""WITH RECURSIVE b AS MATERIALIZED (SELECT symbol, ts, c, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM {bars(_D)} x),
e(symbol, ts, k, ema) AS (SELECT symbol, ts, k, c FROM b WHERE k = 1 UNION ALL SELECT b.symbol, b.ts, b.k, e.ema + 2e0 / 13 * (b.c - e.ema) FROM e JOIN b ON b.symbol = e.symbol AND b.k = e.k + 1)
SELECT symbol, ts, round(ema, 6) AS ema FROM e""",
)


# ---- backtests: the twin carries the account from bar to bar in a recursive query --------------------------------------------

_RULES = {"fixed": backtest.Rules(), "trailing": backtest.Rules(target=0.5, stop=0.2, trail=0.1, activation=0.05)}


def _signal_bars(d: Dialect) -> str:
    return f"SELECT b.symbol, b.ts, b.o, b.h, b.l, s.signal FROM {bars(d)} b JOIN (SELECT symbol, ts, {d.lag('trend_signals')} AS signal FROM {_signals(d)} g) s ON s.symbol = b.symbol AND s.ts = b.ts"


def _backtest(r: backtest.Rules):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        run = backtest.backtest(run_sql(spark, _signal_bars(Spark()), sf_dir), r)
        return run.selectExpr("symbol", "ts", "closed", "round(pnl, 6) + 0D AS pnl", "reason", "position", "round(entry, 6) AS entry", "round(balance, 6) AS balance")

    return query


def _account_sql(r: backtest.Rules) -> str:
    cost, begin = r.fee + r.slippage, "symbol, ts, k, o, h, l, signal"
    rows = f"rows AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM ({_signal_bars(Duck())}) q)"
    # One bar: wish, close on a change, open, touch.
    step = f"""SELECT symbol, ts, k, o, h, l, wish, bal, alive, alive AND side <> 0 AND side <> wish AS flip, side, entry, lvl, act FROM (
      SELECT r.symbol, r.ts, r.k, r.o, r.h, r.l, a.side, a.entry, a.lvl, a.act, a.bal, a.bal >= {r.broken * r.balance} AS alive, CASE WHEN a.bal >= {r.broken * r.balance} AND coalesce(r.signal, 0) <> 0 THEN CAST(r.signal AS INT) ELSE a.wish END AS wish FROM acc a JOIN rows r ON r.symbol = a.symbol AND r.k = a.k + 1)"""
    opened = f"""SELECT *, CASE WHEN flip THEN side * (o - entry) / entry * 100 * {r.leverage} - {cost} ELSE 0e0 END AS pnl1, CASE WHEN alive AND (side = 0 OR flip) THEN wish ELSE side END AS s1, alive AND (side = 0 OR flip) AND wish <> 0 AS fresh FROM ({step})"""
    entered = f"SELECT *, CASE WHEN fresh THEN o ELSE entry END AS e1, CASE WHEN fresh THEN o * (1 - wish * {r.stop}) ELSE lvl END AS l1, CASE WHEN fresh THEN {r.activation <= 0} ELSE act END AS a1 FROM ({opened})"
    if r.trail is None:
        low = f"(s1 > 0 AND l <= e1 * (1 - s1 * {r.stop})) OR (s1 < 0 AND l <= e1 * (1 + s1 * {r.target}))"
        high = f"(s1 > 0 AND h >= e1 * (1 + s1 * {r.target})) OR (s1 < 0 AND h >= e1 * (1 - s1 * {r.stop}))"
        reason = f"CASE WHEN NOT alive OR s1 = 0 THEN NULL WHEN {low} THEN CASE WHEN s1 > 0 THEN 'stop' ELSE 'target' END WHEN {high} THEN CASE WHEN s1 > 0 THEN 'target' ELSE 'stop' END END"
        paid, level, active = f"CASE why WHEN 'target' THEN {r.target * 100} ELSE -{r.stop * 100} END", "l1", "a1"
    else:
        best, worst = "(CASE WHEN s1 > 0 THEN h ELSE l END)", "(CASE WHEN s1 > 0 THEN l ELSE h END)"
        reason = f"CASE WHEN NOT alive OR s1 = 0 THEN NULL WHEN s1 * ({worst} - l1) <= 0 THEN 'trailing' WHEN s1 * ({best} - e1 * (1 + s1 * {r.target})) >= 0 THEN 'target' END"
        paid = f"s1 * ((CASE why WHEN 'target' THEN e1 * (1 + s1 * {r.target}) ELSE l1 END) - e1) / e1 * 100"
        active = f"(a1 OR s1 * ({best} - e1 * (1 + s1 * {r.activation})) >= 0)"
        level = f"CASE WHEN NOT {active} THEN l1 WHEN s1 > 0 THEN greatest(l1, h * {1 - r.trail}) ELSE least(l1, l * {1 + r.trail}) END"
    touched = f"SELECT *, {reason} AS why FROM ({entered})"
    paid_ = f"SELECT *, CASE WHEN why IS NULL THEN 0e0 ELSE ({paid}) * {r.leverage} - {cost} END AS pnl2 FROM ({touched})"
    state = f"""SELECT symbol, ts, k, wish, CASE WHEN why IS NULL THEN s1 ELSE 0 END AS side, e1 AS entry, CASE WHEN why IS NULL AND s1 <> 0 AND alive THEN {level} ELSE l1 END AS lvl, CASE WHEN why IS NULL AND s1 <> 0 AND alive THEN {active} ELSE a1 END AS act,
      bal + {r.size} * pnl1 / 100 + {r.size} * pnl2 / 100 AS bal, CAST(flip AS INT) + CASE WHEN why IS NULL THEN 0 ELSE 1 END AS closed, pnl1 + pnl2 AS pnl, coalesce(why, CASE WHEN flip THEN 'direction change' END) AS reason FROM ({paid_})"""
    first = f"SELECT symbol, CAST(NULL AS TIMESTAMP) AS ts, CAST(0 AS BIGINT) AS k, 0 AS wish, 0 AS side, 0e0 AS entry, 0e0 AS lvl, false AS act, {r.balance}::DOUBLE AS bal, 0 AS closed, 0e0 AS pnl, CAST(NULL AS VARCHAR) AS reason FROM rows WHERE k = 1"
    del begin
    return f"WITH RECURSIVE {rows}, acc AS ({first} UNION ALL {state}) SELECT symbol, ts, closed, round(pnl, 6) + 0e0 AS pnl, reason, side AS position, CASE WHEN side <> 0 THEN round(entry, 6) END AS entry, round(bal, 6) AS balance FROM acc WHERE k > 0"


for _kind, _r in _RULES.items():
    QUERIES[f"backtest_{_kind}_stops"] = _backtest(_r)
    ORACLES[f"backtest_{_kind}_stops"] = _TABLE.sub(r"\1", _account_sql(_r))


# ---- levels and their first touch: the twin is a range join ------------------------------------------------------------------


def _gaps(d: Dialect) -> str:
    """Fair value gaps as levels, known at the last of their three candles: back to the near edge."""
    bull, bear = f"{d.lag('h', 2)} < l AND {d.lag('c')} > {d.lag('o')}", f"{d.lag('l', 2)} > h AND {d.lag('c')} < {d.lag('o')}"
    rows = f"SELECT symbol, ts, row_number() OVER ({d.over}) AS id, CASE WHEN {bull} THEN l WHEN {bear} THEN h END AS level, CASE WHEN {bull} THEN false WHEN {bear} THEN true END AS up FROM {bars(d)} b"
    return f"(SELECT * FROM ({rows}) g WHERE level IS NOT NULL)"


def _swing_levels(d: Dialect) -> str:
    return f"(SELECT symbol, ts, k AS id, level, side = 1 AS up FROM {_swings(d)} w)"


def _touched(levels: Callable[[Dialect], str], select: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        level = run_sql(spark, f"SELECT * FROM {levels(Spark())} l", sf_dir)
        found = touches.first_touches(level, _bars(spark, sf_dir))
        return spark.sql(select.format(rows="{rows}", bars="{bars}"), rows=found, bars=_bars(spark, sf_dir))

    inner = f"(SELECT v.*, (SELECT min(b.ts) FROM {bars(Duck())} b WHERE b.symbol = v.symbol AND b.ts > v.ts AND CASE WHEN v.up THEN b.h >= v.level ELSE b.l <= v.level END) AS touched FROM {levels(Duck())} v)"
    return query, _TABLE.sub(r"\1", select.format(rows=inner, bars=bars(Duck())))


for _name, _levels, _select in (
    ("smc_fvg_mitigation", _gaps, "SELECT r.symbol, r.ts, r.level, r.up, r.touched FROM {rows} r"),
    ("smc_mitigation_blocks", _gaps, "SELECT r.symbol, r.touched AS ts, CASE WHEN r.up THEN -1 ELSE 1 END AS kind, round(b.h, 2) AS top, round(b.l, 2) AS bottom, r.ts AS gap_ts FROM {rows} r JOIN {bars} b ON b.symbol = r.symbol AND b.ts = r.touched"),
    ("smc_liquidity_sweeps", _swing_levels, "SELECT r.symbol, r.ts, CASE WHEN r.up THEN 1 ELSE -1 END AS side, r.level, r.touched FROM {rows} r"),
):
    QUERIES[_name], ORACLES[_name] = _touched(_levels, _select)


# ---- regimes: the twin carries the averages, then the labels, from bar to bar --------------------------------------------------


def _regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = regimes.regime_engine(_bars(spark, sf_dir))
    return out.selectExpr("symbol", "ts", *[n if t.typeName() == "string" else f"round({n}, 5) + 0D AS {n}" for n, t in regimes.OUT.items()])


def _regime_sql(k: regimes.RegimeConfig) -> str:
    e = regimes.EPS
    avg = lambda a, x, old: f"({a} * ({x}) + {1 - a!r} * {old})"
    rows = f"rows AS MATERIALIZED (SELECT symbol, ts, c, row_number() OVER w AS k, coalesce(ln(c / lag(c) OVER w), 0e0) AS r, coalesce(epoch(ts) - epoch(lag(ts) OVER w), 0e0) AS iv FROM {bars(Duck())} b WINDOW w AS (PARTITION BY symbol ORDER BY ts))"
    zero = "fast slow mean var z was up2 dn2 ex per zm zv pm pv pressure level iva".split()
    first = f"SELECT symbol, k, " + ", ".join(f"{'c' if n in ('fast', 'slow') else '0e0'} AS {n}" for n in zero) + ", false AS started, false AS gap FROM rows WHERE k = 1"
    a = f"SELECT r.symbol, r.k, r.r, r.iv, {avg(k.alpha_fast, 'r.c', 'm.fast')} AS fast, {avg(k.alpha_slow, 'r.c', 'm.slow')} AS slow, m.mean AS mean0, m.var AS var0, m.z AS was, {avg(k.alpha_vol, 'power(greatest(r.r, 0), 2)', 'm.up2')} AS up2, {avg(k.alpha_vol, 'power(greatest(-r.r, 0), 2)', 'm.dn2')} AS dn2, m.ex AS ex0, {avg(k.alpha_persistence, 'sign(r.r)', 'm.per')} AS per, m.zm AS zm0, m.zv AS zv0, m.pm AS pm0, m.pv AS pv0, m.iva AS iva0, m.started AS s0 FROM m JOIN rows r ON r.symbol = m.symbol AND r.k = m.k + 1"
    b = f"SELECT *, ln(fast / slow) AS raw, (ln(fast / slow) - mean0) / sqrt(var0 + {e}) AS z, {avg(k.alpha_z, 'ln(fast / slow)', 'mean0')} AS mean, sqrt(greatest(up2, dn2)) AS level FROM ({a})"
    c = f"SELECT *, {avg(k.alpha_z, 'power(raw - mean, 2)', 'var0')} AS var, {avg(k.alpha_expansion, 'level', 'ex0')} AS ex, {avg(k.alpha_confidence, 'abs(z)', 'zm0')} AS zm FROM ({b})"
    d = f"SELECT *, abs(z - was) * level / (ex + {e}) AS pressure, {avg(k.alpha_confidence, 'power(abs(z) - zm, 2)', 'zv0')} AS zv FROM ({c})"
    f = f"SELECT *, {avg(k.alpha_confidence, 'pressure', 'pm0')} AS pm FROM ({d})"
    step = f"SELECT symbol, k, fast, slow, mean, var, z, was, up2, dn2, ex, per, zm, zv, pm, {avg(k.alpha_confidence, 'power(pressure - pm, 2)', 'pv0')} AS pv, pressure, level, CASE WHEN iv <= 0 THEN iva0 WHEN NOT s0 THEN iv WHEN iv > {k.gap} * iva0 THEN iva0 ELSE {avg(k.alpha_interval, 'iv', 'iva0')} END AS iva, CASE WHEN iv <= 0 THEN s0 WHEN NOT s0 THEN true ELSE iv <= {k.gap} * iva0 END AS started, iv > 0 AND s0 AND iv > {k.gap} * iva0 AS gap FROM ({f})"
    ranked = f"SELECT *, list(level) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN {k.ring} PRECEDING AND 1 PRECEDING) AS past FROM m"
    pct = "CASE WHEN len(past) > 0 THEN len(list_filter(past, lambda q: q < level)) / len(past) ELSE 0e0 END"
    masks = f"k < {k.warmup} OR max(gap::INT) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN {k.warmup - 2} PRECEDING AND CURRENT ROW) = 1"
    x = f"x AS MATERIALIZED (SELECT *, {pct} AS pct, {masks} AS masked, CASE WHEN z > {k.trend} THEN 'BULL' WHEN z < -{k.trend} THEN 'BEAR' ELSE 'RANGE' END AS rt, sum(CASE WHEN level >= {k.floor} THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN {k.floor_bars - 1} PRECEDING AND CURRENT ROW) = 0 AND k >= {k.floor_bars} AS quiet FROM ({ranked}) q)"
    held = lambda n, raw, far: (  # noqa: E731  label, waiting label, its bars
        f"CASE WHEN {n}l IS NULL OR {raw} = 'TRANSITION' THEN {raw} WHEN {raw} <> {n}l AND {far} > buf AND CASE WHEN {n}w = {raw} THEN {n}n + 1 ELSE 1 END >= {k.min_duration} THEN {raw} ELSE {n}l END AS {n}l2",
        f"CASE WHEN {n}l IS NULL OR {raw} = 'TRANSITION' OR {raw} = {n}l OR {far} <= buf OR CASE WHEN {n}w = {raw} THEN {n}n + 1 ELSE 1 END >= {k.min_duration} THEN NULL ELSE {raw} END AS {n}w2",
        f"CASE WHEN {n}l IS NULL OR {raw} = 'TRANSITION' OR {raw} = {n}l OR {far} <= buf OR CASE WHEN {n}w = {raw} THEN {n}n + 1 ELSE 1 END >= {k.min_duration} THEN 0 WHEN {n}w = {raw} THEN {n}n + 1 ELSE 1 END AS {n}n2",
    )
    dims = [held("t", "rawt", f"abs(abs(z) - {k.trend})"), held("v", "rawv", f"least(abs(pct - {k.vol_high}), abs(pct - {k.vol_low}))"), held("a", "rawa", f"abs(pressure - {k.accelerating})")]
    names = [f"{n}{y}" for n in "tva" for y in "lwn"]
    begin = "SELECT symbol, CAST(0 AS BIGINT) AS k, false AS tr, 0e0 AS sg, " + ", ".join(f"CAST(NULL AS VARCHAR) AS {n}" if n[1] != "n" else f"0 AS {n}" for n in names) + ", CAST(NULL AS VARCHAR) AS label, 0 AS run FROM rows WHERE k = 1"
    g = f"SELECT x.symbol, x.k, x.z, x.pct, x.pressure, x.rt, x.masked, x.quiet, {', '.join('l.' + n for n in names)}, l.label AS label0, l.run AS run0, CASE WHEN l.tr THEN x.pressure >= {k.transition_out} ELSE sign(x.z) <> l.sg AND l.sg <> 0 AND x.pressure > {k.transition_in} END AS tr, sign(x.z) AS sg FROM l JOIN x ON x.symbol = l.symbol AND x.k = l.k + 1"
    h = f"SELECT *, CASE WHEN tr THEN 'TRANSITION' ELSE rt END AS rawt, CASE WHEN pct > {k.vol_high} THEN 'HIGH_VOL' WHEN pct < {k.vol_low} THEN 'LOW_VOL' ELSE 'NORMAL_VOL' END AS rawv, CASE WHEN pressure > {k.accelerating} THEN 'ACCELERATING' ELSE 'STABLE' END AS rawa, {k.hysteresis} + {k.hysteresis_vol} * pct AS buf FROM ({g})"
    i = f"SELECT *, {', '.join(y for dim in dims for y in dim)} FROM ({h})"
    now = f"CASE WHEN quiet AND NOT masked THEN '{regimes.STILL}' WHEN k < {k.warmup} THEN '{regimes.NONE}' WHEN tr OR tl2 = 'TRANSITION' THEN 'TRANSITION' ELSE tl2 || '_' || vl2 || '_' || al2 END"
    kept = ", ".join(f"CASE WHEN k < {k.warmup} THEN {n} ELSE {n}2 END AS {n}" for n in names)
    labels = f"SELECT symbol, k, tr, sg, {kept}, {now} AS label, CASE WHEN {now} = label0 THEN run0 + 1 ELSE 1 END AS run FROM ({i})"
    num = lambda v: f"CASE WHEN NOT masked THEN round({v}, 5) + 0e0 END"
    lab = lambda v: f"CASE WHEN masked THEN '{regimes.NONE}' WHEN quiet THEN '{regimes.STILL}' ELSE {v} END"
    clip = lambda v: f"greatest(0e0, least(1e0, {v}))"
    conf = clip(f"({clip(f'(abs(z) - {k.trend}) / (sqrt(zv) + {e})')} + {clip('abs(pct - 0.5) / 0.25')} + {clip(f'(pressure - {k.accelerating}) / (sqrt(pv) + {e})')}) / {3 + e!r}")
    soft = lambda v: num(f"1 / (1 + exp(-greatest(-50e0, least(50e0, {k.steepness} * ({v})))))")
    values = {
        "regime_trend": lab("CASE WHEN l.tr THEN 'TRANSITION' ELSE tl END"), "regime_volatility": lab("vl"), "regime_momentum": lab("al"), "regime_label": lab("label"), "regime_confidence": num(conf), "trend_strength_z": num("z"), "vol_percentile": num("pct"), "transition_pressure": num("pressure"),
        "regime_stability": num(f"least(run / {k.stability_cap}, 1)"), "volatility_skew": num(f"sqrt(dn2) / (sqrt(up2) + {e})"), "trend_acceleration": num("z - was"), "adaptive_alpha": num(f"{k.alpha_min} + {k.alpha_max - k.alpha_min!r} * pct"), "up_vol": num("sqrt(up2)"), "down_vol": num("sqrt(dn2)"),
        "directional_persistence": num("per"), "score_bull": soft(f"z - {k.trend}"), "score_bear": soft(f"-z - {k.trend}"), "score_range": soft(f"{k.trend} - abs(z)"), "score_transition": soft(f"pressure - {k.transition_in}"), "score_high_vol": soft(f"pct - {k.vol_high}"), "score_low_vol": soft(f"{k.vol_low} - pct"), "score_accelerating": soft(f"pressure - {k.accelerating}"),
    }
    return f"WITH RECURSIVE {rows}, m AS ({first} UNION ALL {step}), {x}, l AS ({begin} UNION ALL {labels}) SELECT r.symbol, r.ts, {', '.join(f'{v} AS {n}' for n, v in values.items())} FROM x JOIN l ON l.symbol = x.symbol AND l.k = x.k JOIN rows r ON r.symbol = x.symbol AND r.k = x.k"


QUERIES["regime_engine"] = _regimes
ORACLES["regime_engine"] = _TABLE.sub(r"\1", _regime_sql(regimes.RegimeConfig()))


def _regimes_in_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the month, then everything again from the states that it left: what was processed is left out."""
    bars_ = _bars(spark, sf_dir)
    first = regimes.regime_update(bars_.filter("ts < timestamp_ntz'2024-01-16 00:00:00'"))
    rest = regimes.regime_update(bars_, first.filter("state IS NOT NULL").select("symbol", "state"))
    return first.unionByName(rest).selectExpr("symbol", "ts", *[n if t.typeName() == "string" else f"round({n}, 5) + 0D AS {n}" for n, t in regimes.OUT.items()])


QUERIES["regime_in_runs"] = _regimes_in_runs
ORACLES["regime_in_runs"] = ORACLES["regime_engine"]


# ---- resampled paths -----------------------------------------------------------------------------------------------------------


def _monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = montecarlo.resampled_paths(run_sql(spark, f"SELECT * FROM {ledger()} t", sf_dir), "trade_return_pct")
    return paths.selectExpr("path", *[f"round({n}, 8) + 0D AS {n}" for n in ("final", "max_drawdown", "total_return")])


def _monte_carlo_sql(paths: int = 50, seed: int = 42) -> str:
    prime = montecarlo.PRIME
    first = f"SELECT id, trade_return_pct / 10000 AS r, path, (id * 48271 + 11) % {prime} AS x FROM {ledger()} t CROSS JOIN (SELECT unnest(range(1, {paths + 1})) AS path) p"
    mixed = lambda salt: f"(power_{salt} * power_{salt} + x) % {prime}"
    second = f"SELECT *, (x * x + path * 69621 + {seed}) % {prime} AS power_0, (x * x + path * 69621 + {seed + 1}) % {prime} AS power_1 FROM ({first}) f"
    # Poisson with mean 1 by inversion of its distribution function.
    terms, total = [], 0.0
    for k in range(6):
        total += math.exp(-1) / math.factorial(k)
        terms.append(f"(u >= {total!r})::INT")
    drawn = f"SELECT path, id, r, place, {' + '.join(terms)} AS times FROM (SELECT *, ({mixed(0)}) / {float(prime)!r} AS u, {mixed(1)} AS place FROM ({second}) s) v"
    wealth = f"SELECT path, exp(sum(ln(1 + r) * times) OVER (PARTITION BY path ORDER BY place, id)) AS w, ln(1 + r) * times AS g, place, id FROM ({drawn}) d WHERE times > 0"
    falls = f"SELECT path, g, w / greatest(1, max(w) OVER (PARTITION BY path ORDER BY place, id)) - 1 AS fall FROM ({wealth}) w"
    return f"SELECT path::INT AS path, round(exp(sum(g)), 8) + 0e0 AS final, round(min(fall), 8) + 0e0 AS max_drawdown, round(exp(sum(g)) - 1, 8) + 0e0 AS total_return FROM ({falls}) f GROUP BY path"


QUERIES["monte_carlo"] = _monte_carlo
ORACLES["monte_carlo"] = _TABLE.sub(r"\1", _monte_carlo_sql())


# ---- modelling steps -----------------------------------------------------------------------------------------------------------


def _framed(build: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(lambda text: run_sql(spark, text, sf_dir))


for _name, (_build, _twin) in {**modelling.FRAMES, **structure.FRAMES, **checked.FRAMES}.items():
    QUERIES[_name] = _framed(_build)
    if _twin:
        ORACLES[_name] = _TABLE.sub(r"\1", _twin)
