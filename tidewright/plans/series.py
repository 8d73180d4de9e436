"""Queries over tick, bar and ledger series, each one text for both engines.

``{events}``, ``{orders}``, ``{lineitem}`` stand for tables. A :class:`~tidewright.plans.dialect.Dialect` spells what differs.
"""

from __future__ import annotations

from collections.abc import Callable

from tidewright.functions.features import FAMILIES, FEATURES, features_sql
from tidewright.functions.patterns import PATTERNS
from tidewright.plans.dialect import Dialect, corr

SERIES: dict[str, Callable[[Dialect], str]] = {}


def series(fn: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
    SERIES[fn.__name__] = fn
    return fn


#: Steps by name, which Spark runs once per query and keeps.
STEPS: dict[str, Callable[[Dialect], str]] = {}


def step(fn: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
    """A step used more than once: Spark's text names it by a mark, and each query runs it once; the twin repeats its text."""
    name = fn.__name__.lstrip("_")
    STEPS[name] = fn
    return lambda d: f"{{{name}}}" if d.name == "spark" else fn(d)


def r6(x: str) -> str:
    """Six digits; a rounded negative zero is zero."""
    return f"(round(CAST({x} AS DOUBLE), 6) + 0e0)"


# ---- projections -----------------------------------------------------------------------------------------------------------


def ticks() -> str:
    return "(SELECT event_type AS symbol, ts, event_id AS trade_id, value AS price, CAST(user_id % 10 + 1 AS DOUBLE) AS quantity, user_id % 2 = 0 AS is_buyer_maker FROM {events} WHERE value > 0)"


def bars(d: Dialect, hours: int = 1) -> str:
    """Clock bars; an hour or a day without ticks has none."""
    return (
        f"(SELECT symbol, {d.bucket('ts', hours)} AS ts, {d.first_by('price', 'trade_id')} AS o, max(price) AS h, min(price) AS l, {d.last_by('price', 'trade_id')} AS c, "
        f"sum(quantity) AS v, count(*) AS n FROM {ticks()} t GROUP BY symbol, {d.bucket('ts', hours)})"
    )


def ledger() -> str:
    """Closed trades made of orders and their last shipping date."""
    return (
        "(SELECT o_orderkey AS id, o_orderdate AS entry_datetime, q.exit_datetime, round(q.ret, 6) AS trade_return_pct, CASE WHEN o_orderstatus = 'F' THEN 'Short' ELSE 'Long' END AS direction, "
        "o_orderpriority AS regime, o_totalprice AS size FROM {orders} JOIN (SELECT l_orderkey, max(l_shipdate) AS exit_datetime, sum(l_discount - l_tax) * 100 AS ret FROM {lineitem} GROUP BY l_orderkey) q "
        "ON q.l_orderkey = o_orderkey WHERE q.exit_datetime > o_orderdate)"
    )


@step
def _closed(d: Dialect) -> str:
    """The ledger, for queries that read it several times."""
    return ledger()


def daily() -> str:
    """Long daily series of order prices."""
    return (
        "(SELECT 'orders' AS symbol, o_orderdate AS ts, min_by(o_totalprice, o_orderkey) AS o, max(o_totalprice) AS h, min(o_totalprice) AS l, max_by(o_totalprice, o_orderkey) AS c, "
        "CAST(count(*) AS DOUBLE) AS v FROM {orders} GROUP BY o_orderdate)"
    )


# ---- validation, bars, cleaning --------------------------------------------------------------------------------------------


@series
def ticks_validated(d):
    return f"SELECT symbol, trade_id, price, quantity, is_buyer_maker FROM {ticks()} t WHERE price > 0 AND quantity > 0"


@series
def ohlcv_1h(d):
    return f"SELECT symbol, ts, o, h, l, c, v, n FROM {bars(d, 1)} b"


@series
def ohlcv_1d(d):
    return f"SELECT symbol, ts, o, h, l, c, v, n FROM {bars(d, 24)} b"


@series
def bars_valid(d):
    return f"SELECT symbol, ts FROM {bars(d)} b WHERE o > 0 AND h > 0 AND l > 0 AND c > 0 AND h >= l AND h >= greatest(o, c) AND l <= least(o, c) AND v >= 0"


@series
def outliers_removed(d):
    """Closes within 1.5 interquartile ranges; 2.5 where less than 70 % would stay."""
    edges = f"SELECT symbol, {d.quantile('c', 0.25)} AS q1, {d.quantile('c', 0.75)} AS q3 FROM {bars(d)} b GROUP BY symbol"
    inside = "b.c BETWEEN e.q1 - {k} * (e.q3 - e.q1) AND e.q3 + {k} * (e.q3 - e.q1)"
    share = f"SELECT b.symbol, e.q1, e.q3, avg(CASE WHEN {inside.replace('{k}', '1.5')} THEN 1e0 ELSE 0e0 END) AS kept FROM {bars(d)} b JOIN ({edges}) e ON e.symbol = b.symbol GROUP BY b.symbol, e.q1, e.q3"
    rule = f"b.c BETWEEN e.q1 - (CASE WHEN e.kept < 0.7 THEN 2.5 ELSE 1.5 END) * (e.q3 - e.q1) AND e.q3 + (CASE WHEN e.kept < 0.7 THEN 2.5 ELSE 1.5 END) * (e.q3 - e.q1)"
    return f"SELECT b.symbol, b.ts, b.c FROM {bars(d)} b JOIN ({share}) e ON e.symbol = b.symbol WHERE {rule}"


@series
def dedupe_keep_first(d):
    return f"SELECT symbol, hour_ts, trade_id, price FROM (SELECT symbol, {d.bucket('ts', 1)} AS hour_ts, trade_id, price, row_number() OVER (PARTITION BY symbol, {d.bucket('ts', 1)} ORDER BY trade_id) AS k FROM {ticks()} t) q WHERE k = 1"


@series
def dedupe_keep_last(d):
    return f"SELECT symbol, hour_ts, trade_id, price FROM (SELECT symbol, {d.bucket('ts', 1)} AS hour_ts, trade_id, price, row_number() OVER (PARTITION BY symbol, {d.bucket('ts', 1)} ORDER BY trade_id DESC) AS k FROM {ticks()} t) q WHERE k = 1"


def _calendar(d: Dialect) -> str:
    """Every hour between a symbol's first and last bar, with its bar where there is one."""
    if d.name == "spark":
        grid = f"SELECT symbol, explode(sequence(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM {bars(d)} b GROUP BY symbol"
    else:
        grid = f"SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM {bars(d)} b GROUP BY symbol"
    return f"(SELECT g.symbol, g.ts, b.o, b.h, b.l, b.c, b.v FROM ({grid}) g LEFT JOIN {bars(d)} b ON b.symbol = g.symbol AND b.ts = g.ts)"


@series
def gapfill_ffill(d):
    return f"SELECT symbol, ts, {d.last('c')} AS c, coalesce(v, 0e0) AS v FROM {_calendar(d)} g"


@series
def gapfill_linear(d):
    inner = f"SELECT *, {d.last('c')} AS c0, {d.next('c')} AS c1, {d.last('CASE WHEN c IS NOT NULL THEN k END')} AS k0, {d.next('CASE WHEN c IS NOT NULL THEN k END')} AS k1 FROM (SELECT *, row_number() OVER ({d.over}) AS k FROM {_calendar(d)} g) n"
    return f"SELECT symbol, ts, {r6('CASE WHEN k1 = k0 THEN c0 ELSE c0 + (c1 - c0) * (k - k0) / (k1 - k0) END')} AS c FROM ({inner}) q"


@series
def zero_volume_repair(d):
    """Zero volumes take the last volume, at the head the next one, 1 if there is none; bars of a single tick count as without volume."""
    odd = f"(SELECT symbol, ts, CASE WHEN n < 2 THEN 0e0 ELSE v END AS v FROM {bars(d)} b)"
    return f"SELECT symbol, ts, coalesce({d.last('nullif(v, 0)')}, {d.next('nullif(v, 0)')}, 1e0) AS v FROM {odd} z"


@series
def resample_daily_ffill(d):
    """Hourly rows of a daily series, each with the last daily close."""
    return f"SELECT g.symbol, g.ts, {d.last('c')} AS c FROM (SELECT b.symbol, b.ts, e.c FROM {bars(d)} b LEFT JOIN {bars(d, 24)} e ON e.symbol = b.symbol AND e.ts = b.ts) g"


@series
def price_precision(d):
    rule = "CASE WHEN c >= 100 THEN 2 WHEN c >= 10 THEN 3 WHEN c >= 1 THEN 4 WHEN c >= 0.1 THEN 5 WHEN c >= 0.01 THEN 6 ELSE 8 END"
    return f"SELECT symbol, ts, {rule} AS digits FROM {bars(d)} b"


@series
def downsample_average(d):
    """At most 50 buckets of equal rows per series."""
    inner = f"SELECT symbol, c, floor((row_number() OVER ({d.over}) - 1) * 50.0 / greatest(count(*) OVER (PARTITION BY symbol), 50)) AS bucket FROM {bars(d)} b"
    return f"SELECT symbol, CAST(bucket AS INT) AS bucket, {r6('avg(c)')} AS c FROM ({inner}) q GROUP BY symbol, bucket"


@series
def unpivot_metrics(d):
    if d.name == "spark":  # one pass over the bars
        return f"SELECT symbol, ts, metric, value FROM {bars(d, 24)} b LATERAL VIEW stack(4, 'o', o, 'h', h, 'l', l, 'c', c) u AS metric, value"
    parts = " UNION ALL ".join(f"SELECT symbol, ts, '{m}' AS metric, {m} AS value FROM {bars(d, 24)} b" for m in ("o", "h", "l", "c"))
    return f"SELECT symbol, ts, metric, value FROM ({parts}) u"


@series
def bar_load_columns(d):
    return f"SELECT symbol, ts, {r6('ln(c / ' + d.lag('c') + ')')} AS log_return, {r6('(h - l) / c')} AS hl_range, {d.hour('ts')} AS hour FROM {bars(d)} b"


# ---- joins -----------------------------------------------------------------------------------------------------------------


def _asof(d: Dialect, left: str, right: str, forward: bool = False, strict: bool = False, value: str = "v") -> str:
    """Latest (or next) row of ``right`` (symbol, ts, value) for each row of ``left`` (symbol, ts, id): union, sort, carry.

    One shuffle and one sort for both sides, linear in their rows, whatever the number of matches.
    """
    first, second = ("1", "0") if strict else ("0", "1")
    side = f"SELECT symbol, ts, {second} AS side, id, CAST(NULL AS DOUBLE) AS v, CAST(NULL AS TIMESTAMP) AS bar_ts FROM {left} l UNION ALL SELECT symbol, ts, {first} AS side, NULL AS id, v, ts AS bar_ts FROM {right} r"
    if forward:
        side = f"SELECT symbol, ts, {first} AS side, id, CAST(NULL AS DOUBLE) AS v, CAST(NULL AS TIMESTAMP) AS bar_ts FROM {left} l UNION ALL SELECT symbol, ts, {second} AS side, NULL AS id, v, ts AS bar_ts FROM {right} r"
    # Forward is carried in the reverse order: a frame that ends with the series is read anew for every row.
    frame = f"PARTITION BY symbol ORDER BY {'ts DESC, side DESC' if forward else 'ts, side'} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    pick = lambda x: f"{d.ignoring('last_value', x)} OVER ({frame})"
    return f"(SELECT symbol, ts, id, {value}, bar_ts FROM (SELECT symbol, ts, id, {pick('v')} AS {value}, {pick('bar_ts')} AS bar_ts FROM ({side}) u) q WHERE id IS NOT NULL)"


def _native_asof(d: Dialect, left: str, right: str, op: str) -> str:
    return f"(SELECT l.symbol, l.ts, l.id, r.v, r.ts AS bar_ts FROM {left} l ASOF LEFT JOIN {right} r ON r.symbol = l.symbol AND l.ts {op} r.ts)"


def asof(d: Dialect, left: str, right: str, forward: bool = False, strict: bool = False) -> str:
    if d.name == "spark":
        return _asof(d, left, right, forward, strict)
    return _native_asof(d, left, right, {(False, False): ">=", (False, True): ">", (True, False): "<=", (True, True): "<"}[forward, strict])


def _trades(d: Dialect) -> str:
    """Every event is a trade."""
    return "(SELECT event_type AS symbol, CAST(ts AS TIMESTAMP) AS ts, event_id AS id FROM {events})"


def _closes(d: Dialect, hours: int = 1) -> str:
    return f"(SELECT symbol, CAST(ts AS TIMESTAMP) AS ts, c AS v FROM {bars(d, hours)} b)"


@series
def asof_backward(d):
    return f"SELECT symbol, id, v, bar_ts FROM {asof(d, _trades(d), _closes(d))} j"


@series
def asof_forward(d):
    return f"SELECT symbol, id, v, bar_ts FROM {asof(d, _trades(d), _closes(d), forward=True)} j"


@series
def asof_forward_strict(d):
    return f"SELECT symbol, id, v, bar_ts FROM {asof(d, _trades(d), _closes(d, 24), forward=True, strict=True)} j"


@series
def asof_clip(d):
    """Backward, trades before the first bar get the first bar."""
    first = f"SELECT symbol, {d.first_by('c', 'ts')} AS v0 FROM {bars(d)} b GROUP BY symbol"
    return f"SELECT j.symbol, j.id, coalesce(j.v, f.v0) AS v FROM {asof(d, _trades(d), _closes(d), strict=True)} j JOIN ({first}) f ON f.symbol = j.symbol"


@series
def multi_timeframe(d):
    left = f"(SELECT symbol, CAST(ts AS TIMESTAMP) AS ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS id FROM {bars(d)} b)"
    return f"SELECT symbol, ts, id, v AS close_1d FROM {asof(d, left, _closes(d, 24))} j"


@series
def range_join_intervals(d):
    """Ticks in [bar, next bar) of every sixth hourly bar; the interval is found by carrying its start, so no range join is needed."""
    marks = f"(SELECT symbol, CAST(ts AS TIMESTAMP) AS ts, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) AS DOUBLE) AS v FROM {bars(d)} b WHERE {d.hour('ts')} % 6 = 0)"
    all_ticks = "(SELECT event_type AS symbol, CAST(ts AS TIMESTAMP) AS ts, event_id AS id FROM {events} WHERE value > 0)"
    return f"SELECT symbol, CAST(v AS INT) AS interval_id, count(*) AS ticks, min(id) AS first_id, max(id) AS last_id FROM {asof(d, all_ticks, marks)} j WHERE v IS NOT NULL GROUP BY symbol, v"


def _concurrency(trades: str | None = None) -> str:
    """Open trades on each day of the ledger: +1 at entry, -1 on the day after exit."""
    trades = trades or ledger()
    steps = f"SELECT entry_datetime AS day, 1 AS step FROM {trades} a UNION ALL SELECT exit_datetime AS day, -1 AS step FROM {trades} b"
    return f"(SELECT day, sum(step) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open_trades FROM (SELECT day, sum(step) AS step FROM ({steps}) s GROUP BY day) g)"


@series
def concurrency(d):
    return f"SELECT day, CAST(open_trades AS BIGINT) AS open_trades FROM {_concurrency()} q"


@series
def average_uniqueness(d):
    """Mean of 1/concurrency from entry to the day before exit, by differences of prefix sums."""
    c = f"SELECT day, CASE WHEN open_trades > 0 THEN 1e0 / open_trades ELSE 0e0 END AS u FROM {_concurrency()} q"
    p = f"SELECT day, sum(u) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - u AS before, row_number() OVER (ORDER BY day) AS k FROM ({c}) z"
    return f"SELECT t.id, {r6('(x.before - e.before) / (x.k - e.k)')} AS uniqueness FROM {ledger()} t JOIN ({p}) e ON e.day = t.entry_datetime JOIN ({p}) x ON x.day = t.exit_datetime"


@series
def equi_join_meta(d):
    return f"SELECT b.symbol, b.ts, m.kind, b.c FROM {bars(d, 24)} b JOIN (SELECT DISTINCT event_type AS symbol, substr(event_type, 1, 2) AS kind FROM {{events}}) m ON m.symbol = b.symbol"


# ---- features, patterns, structure -----------------------------------------------------------------------------------------


def _family(family: str) -> Callable[[Dialect], str]:
    names = [n for n, f in FEATURES.items() if f.family == family]
    digits = {"statistics": 5, "volatility": 5, "volume": 5, "indicators": 5}.get(family, 6)
    return lambda d: features_sql(d, names, f"{bars(d)} b", digits)


for _f in FAMILIES:
    SERIES[f"features_{_f}"] = _family(_f)
SERIES["features_daily_trend"] = lambda d: features_sql(d, ["price_sma_distance", "donchian_upper", "bb_bandwidth", "returns_4hr", "max_drawdown"], f"{daily()} b", 4)


@series
def candle_patterns(d):
    lags = ", ".join(f"lag({x}, {k}) OVER ({d.over}) AS {x}{k}" for k in (1, 2, 3, 4) for x in "ohlc")
    body = f"{d.w('avg', 'abs(c - o)', -10, -1)} AS body, {d.w('avg', 'h - l', -10, -1)} AS span, {d.w('avg', 'c', -10, -1)} AS mid, row_number() OVER ({d.over}) AS rn"
    codes = ", ".join(f"CASE WHEN rn <= 14 THEN 0 {sql} ELSE 0 END AS {name}" for name, sql in PATTERNS.items())
    return f"SELECT symbol, ts, {codes} FROM (SELECT symbol, ts, o, h, l, c, {lags}, {body} FROM {bars(d)} b) q"


@series
def smc_fair_value_gap(d):
    bull, bear = f"{d.lag('h', 2)} < l AND {d.lag('c')} > {d.lag('o')}", f"{d.lag('l', 2)} > h AND {d.lag('c')} < {d.lag('o')}"
    return (
        f"SELECT symbol, ts, CASE WHEN {bull} THEN 1 WHEN {bear} THEN -1 ELSE 0 END AS fvg, CASE WHEN {bull} THEN l WHEN {bear} THEN {d.lag('l', 2)} END AS top, "
        f"CASE WHEN {bull} THEN {d.lag('h', 2)} WHEN {bear} THEN h END AS bottom FROM {bars(d)} b"
    )


@series
def smc_previous_high_low(d):
    day = f"SELECT symbol, ts, {d.lag('h')} AS prev_high, {d.lag('l')} AS prev_low FROM {bars(d, 24)} b"
    inner = f"SELECT b.symbol, b.ts, b.h, b.l, p.prev_high, p.prev_low, {d.bucket('b.ts', 24)} AS day FROM {bars(d)} b JOIN ({day}) p ON p.symbol = b.symbol AND p.ts = {d.bucket('b.ts', 24)}"
    run = "OVER (PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"SELECT symbol, ts, prev_high, prev_low, max(CASE WHEN h > prev_high THEN 1 ELSE 0 END) {run} AS broken_high, max(CASE WHEN l < prev_low THEN 1 ELSE 0 END) {run} AS broken_low FROM ({inner}) q"


#: Session name, first and last hour (UTC); fixed values.
SESSIONS = (("Sydney", 21, 6), ("Tokyo", 0, 9), ("London", 7, 16), ("New York", 13, 22), ("Asian kill zone", 0, 4), ("London open kill zone", 6, 9), ("New York kill zone", 11, 14), ("London close kill zone", 14, 16))


@series
def smc_sessions(d):
    """Whether a bar lies in a session, and the session's high and low so far; every bar meets every session once."""
    inside = " OR ".join(f"(session = '{name}' AND ({d.hour('ts')} >= {a} {'AND' if a < b else 'OR'} {d.hour('ts')} < {b}))" for name, a, b in SESSIONS)
    named = ", ".join(f"('{name}')" for name, _, _ in SESSIONS)
    starts = f"SELECT session, symbol, ts, h, l, CASE WHEN {inside} THEN 1 ELSE 0 END AS active FROM {bars(d)} x CROSS JOIN (VALUES {named}) AS n(session)"
    groups = f"SELECT *, sum(CASE WHEN active = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, session ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM ({starts}) y"
    run = "OVER (PARTITION BY symbol, session, g ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"SELECT session, symbol, ts, active, CASE WHEN active = 1 THEN max(CASE WHEN active = 1 THEN h END) {run} END AS high, CASE WHEN active = 1 THEN min(CASE WHEN active = 1 THEN l END) {run} END AS low FROM ({groups}) z"


@series
def smc_swing_candidates(d):
    """Highs and lows that are extreme among five bars on either side."""
    return f"SELECT symbol, ts, CASE WHEN h = {d.w('max', 'h', -5, 5)} THEN 1 WHEN l = {d.w('min', 'l', -5, 5)} THEN -1 ELSE 0 END AS swing FROM {bars(d)} b"


#: Bars on the far side of a swing point.
REACH = 5


def _swings(d: Dialect) -> str:
    """Swing points ``symbol, ts, k, side, level``: extremes among the bars around, and of neighbours on one side the most extreme."""
    ranked = f"SELECT symbol, ts, h, l, row_number() OVER ({d.over}) AS k, count(*) OVER (PARTITION BY symbol) AS n, {d.w('max', 'h', -REACH + 1, REACH)} AS top, {d.w('min', 'l', -REACH + 1, REACH)} AS low FROM {bars(d)} b"
    points = f"SELECT symbol, ts, k, CASE WHEN h = top THEN 1 ELSE -1 END AS side, CASE WHEN h = top THEN h ELSE l END AS level FROM ({ranked}) r WHERE k >= {REACH} AND k <= n - {REACH} AND (h = top OR l = low)"
    turns = f"SELECT *, CASE WHEN side = {d.lag('side')} THEN 0 ELSE 1 END AS turn FROM ({points}) p"
    runs = f"SELECT *, sum(turn) OVER ({d.over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM ({turns}) t"
    best = f"SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY side * level DESC, ts) AS place FROM ({runs}) u"
    return f"(SELECT symbol, ts, k, side, level FROM ({best}) v WHERE place = 1)"


@series
def smc_swing_points(d):
    return f"SELECT symbol, ts, side, level FROM {_swings(d)} s"


@series
def smc_retracements(d):
    """How far a bar is back from the last swing towards the one before, in percent, and the deepest so far, a bar late."""
    joined = f"SELECT b.symbol, b.ts, b.h, b.l, s.side, CASE WHEN s.side = 1 THEN s.level END AS high_, CASE WHEN s.side = -1 THEN s.level END AS low_ FROM {bars(d)} b LEFT JOIN {_swings(d)} s ON s.symbol = b.symbol AND s.ts = b.ts"
    state = f"SELECT symbol, ts, h, l, {d.last('side')} AS side, {d.last('high_')} AS top, {d.last('low_')} AS bottom, sum(CASE WHEN side IS NULL THEN 0 ELSE 1 END) OVER ({d.over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM ({joined}) j"
    back = f"SELECT *, CASE WHEN top > bottom AND side = 1 THEN 100 - (l - bottom) / (top - bottom) * 100 WHEN top > bottom AND side = -1 THEN 100 - (h - top) / (bottom - top) * 100 END AS now FROM ({state}) s"
    deep = f"SELECT *, greatest(0, max(now) OVER (PARTITION BY symbol, run ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS deepest FROM ({back}) k"
    return f"SELECT symbol, ts, {d.lag('side')} AS direction, {r6(d.lag('now'))} AS retracement, {r6(d.lag('deepest'))} AS deepest FROM ({deep}) q"


@series
def smc_breaker_blocks(d):
    """Between a swing and the next beyond it on the same side: the first bar that breaks the earlier level, and its rejection wick."""
    w = "PARTITION BY symbol ORDER BY ts"
    legs = f"SELECT symbol, k AS k2, side, level AS level2, lag(k) OVER ({w}) AS k1, lag(level, 2) OVER ({w}) AS level0 FROM {_swings(d)} s"
    numbered = f"(SELECT symbol, ts, o, h, l, c, row_number() OVER ({d.over}) AS k FROM {bars(d)} b)"
    # A bar lies in one leg only, which is carried to it from the leg's end.
    marked = f"SELECT b.*, s.k AS mark FROM {numbered} b LEFT JOIN {_swings(d)} s ON s.symbol = b.symbol AND s.k = b.k"
    leg_of = f"SELECT symbol, ts, o, h, l, c, k, min(mark) OVER ({d.over} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ends FROM ({marked}) m"
    if d.name == "spark":  # the next end, carried against time: a frame that ends with the series would be read anew for every row
        leg_of = f"SELECT symbol, ts, o, h, l, c, k, last_value(mark, true) OVER (PARTITION BY symbol ORDER BY ts DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ends FROM ({marked}) m"
    broken = f"SELECT q.*, g.side, row_number() OVER (PARTITION BY q.symbol, q.ends ORDER BY q.ts) AS place FROM ({leg_of}) q JOIN ({legs}) g ON g.symbol = q.symbol AND g.k2 = q.ends WHERE q.k >= g.k1 AND g.side * g.level2 > g.side * g.level0 AND CASE WHEN g.side = 1 THEN q.h > g.level0 ELSE q.l < g.level0 END"
    wick = "CASE WHEN side = 1 THEN h - greatest(o, c) ELSE least(o, c) - l END"
    return f"SELECT symbol, ts, -side AS kind, CASE WHEN side = 1 THEN h ELSE l END AS level, {r6(f'CASE WHEN abs(c - o) > 0 THEN least(100e0, ({wick}) / abs(c - o) * 100) END')} AS strength FROM ({broken}) z WHERE place = 1"


@series
def regime_vol_percentile(d):
    """Share of up to 500 earlier volatilities strictly below the current one."""
    inner = f"SELECT symbol, ts, CASE WHEN rn > 20 THEN vol END AS vol FROM (SELECT symbol, ts, row_number() OVER ({d.over}) AS rn, {d.w('stddev_pop', 'lr', -19, 0)} AS vol FROM (SELECT symbol, ts, ln(c) - ln({d.lag('c')}) AS lr FROM {bars(d)} b) a) q"
    xs = d.list("vol", -500, -1)
    if d.name == "duckdb":
        xs = f"list_filter({xs}, lambda z: z IS NOT NULL)"
    return f"SELECT symbol, ts, {r6(d.ratio('1.0 * ' + d.size(d.keep(xs, 'q', 'q < vol')), d.size(xs)))} AS vol_percentile FROM (SELECT * FROM ({inner}) a WHERE vol IS NOT NULL) b"


# ---- labels, sampling, cross-validation ------------------------------------------------------------------------------------


@series
def labels_fixed_pct(d, horizon: int = 20, threshold: float = 0.02):
    """Sign of the return over ``horizon`` bars where it exceeds the threshold."""
    ahead = f"({d.lead('c', horizon)} / c - 1)"
    return f"SELECT symbol, ts, CASE WHEN {ahead} > {threshold} THEN 1 WHEN {ahead} < -{threshold} THEN -1 ELSE 0 END AS label FROM {bars(d)} b"


@series
def labels_regression(d):
    return f"SELECT symbol, ts, {r6(d.lead('c', 5) + ' / c - 1')} AS forward_return, {r6('ln(' + d.lead('c', 5) + ' / c)')} AS forward_log_return FROM {bars(d)} b"


@series
def labels_triple_barrier(d):
    """First close beyond +-1 ATR in ten bars; 0 where neither is met, on a tie and in the last ten bars."""
    atr = f"SELECT symbol, ts, c, rn, total, atr FROM (SELECT symbol, ts, c, row_number() OVER ({d.over}) AS rn, count(*) OVER (PARTITION BY symbol) AS total, {d.w('avg', 'tr', -13, 0)} AS atr FROM (SELECT symbol, ts, c, greatest(h - l, coalesce(abs(h - {d.lag('c')}), 0.0), coalesce(abs(l - {d.lag('c')}), 0.0)) AS tr FROM {bars(d)} b) t) q"
    inner = f"SELECT symbol, ts, c, rn, total, atr, {d.list('c', 1, 10)} AS ahead FROM ({atr}) a"
    hit = lambda cond: d.size(d.keep(d.over_index(10, "i", f"CASE WHEN {cond} THEN i END"), "z", "z IS NOT NULL"))
    first = lambda cond: d.at(d.keep(d.over_index(10, "i", f"CASE WHEN {cond} THEN i END"), "z", "z IS NOT NULL"), "1")
    up, down = f"{d.at('ahead', 'i')} >= c + atr", f"{d.at('ahead', 'i')} <= c - atr"
    return f"SELECT symbol, ts, CASE WHEN rn < 14 OR rn > total - 10 THEN 0 WHEN {hit(up)} = 0 AND {hit(down)} = 0 THEN 0 WHEN coalesce({first(up)}, 99) < coalesce({first(down)}, 99) THEN 1 WHEN coalesce({first(down)}, 99) < coalesce({first(up)}, 99) THEN -1 ELSE 0 END AS label FROM ({inner}) w"


@series
def labels_trend_scan(d):
    """t value of the forward regression with the largest one in size, over horizons of 5, 10, 15 and 20 bars."""
    def t(n: int) -> str:
        a = {k: d.w2(k, "c", "rn", 0, n - 1) for k in ("regr_slope", "regr_sxx", "regr_syy", "regr_sxy")}
        rss = f"({a['regr_syy']} - {a['regr_sxy']} * {a['regr_sxy']} / {a['regr_sxx']})"
        return f"(CASE WHEN rn <= total - {n - 1} THEN {a['regr_slope']} / nullif(sqrt(greatest({rss}, 0.0) / {n - 2} / {a['regr_sxx']}), 0) END)"
    inner = f"SELECT symbol, ts, {', '.join(f'{t(n)} AS t{n}' for n in (5, 10, 15, 20))} FROM (SELECT symbol, ts, c, row_number() OVER ({d.over}) AS rn, count(*) OVER (PARTITION BY symbol) AS total FROM {bars(d)} b) q"
    best = "greatest(abs(t5), abs(t10), abs(t15), abs(t20))"
    pick = " ".join(f"WHEN abs(t{n}) = {best} THEN t{n}" for n in (5, 10, 15, 20))
    return f"SELECT symbol, ts, round(CAST(CASE WHEN t20 IS NOT NULL THEN CASE {pick} END END AS DOUBLE), 4) AS t_value FROM ({inner}) w"


@series
def frac_diff_fixed_width(d, order: float = 0.4, width: int = 20):
    weights = [1.0]
    for k in range(1, width):
        weights.append(-weights[-1] * (order - k + 1) / k)
    terms = " + ".join(f"({w!r}) * {d.lag('x', k) if k else 'x'}" for k, w in enumerate(weights))
    return f"SELECT symbol, ts, {r6(terms)} AS fd FROM (SELECT symbol, ts, ln(c) AS x FROM {bars(d)} b) q"


@series
def microstructure(d):
    inner = f"SELECT *, c - {d.lag('c')} AS dp, CASE WHEN c > {d.lag('c')} THEN v WHEN c < {d.lag('c')} THEN -v END AS sv_, row_number() OVER ({d.over}) AS rn FROM {bars(d)} b"
    mid = f"SELECT *, {d.lag('dp')} AS dp1, abs(dp / (c - dp)) / nullif(v * c, 0) AS illiq FROM ({inner}) a"
    return (
        f"SELECT symbol, ts, CASE WHEN rn > 21 THEN round(2 * sqrt(greatest(-{d.w2('covar_samp', 'dp', 'dp1', -19, 0)}, 0.0)), 5) END AS roll_spread, "
        f"CASE WHEN rn > 20 THEN round({d.w('avg', 'illiq', -19, 0)}, 6) END AS amihud, CASE WHEN rn > 20 THEN round({d.w2('regr_slope', 'dp', 'sv_', -19, 0)}, 5) END AS kyle_lambda FROM ({mid}) q"
    )


# ---- transformations -------------------------------------------------------------------------------------------------------


@series
def transforms(d):
    q = d.quantile
    fit = f"SELECT symbol, avg(c) AS m, stddev_samp(c) AS sd, {q('c', 0.5)} AS med, {q('c', 0.25)} AS q1, {q('c', 0.75)} AS q3, min(c) AS lo, max(c) AS hi FROM {bars(d)} b GROUP BY symbol"
    mad = f"SELECT b.symbol, {q('abs(b.c - f.med)', 0.5)} AS mad FROM {bars(d)} b JOIN ({fit}) f ON f.symbol = b.symbol GROUP BY b.symbol"
    joined = f"SELECT b.symbol, b.ts, b.c, f.m, f.sd, f.med, f.q1, f.q3, f.lo, f.hi, a.mad FROM {bars(d)} b JOIN ({fit}) f ON f.symbol = b.symbol JOIN ({mad}) a ON a.symbol = b.symbol"
    x = "CASE WHEN c / mad / 1.4826 > 300 THEN 1.0 ELSE (exp(2 * c / mad / 1.4826) - 1) / (exp(2 * c / mad / 1.4826) + 1) END"
    columns = {
        "signed_log": "sign(c) * ln(1 + abs(c))", "differencing": f"c - {d.lag('c')}", "log_difference": f"ln(c) - ln({d.lag('c')})", "z_score": "(c - m) / sd", "robust": "(c - med) / mad",
        "tanh_scaled": x, "bounded": "2 * (c - lo) / (hi - lo) - 1", "winsorized": "greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), c))", "signed_power": "sign(c) * power(abs(c), 0.3)",
        "rolling_z": d.div(f"c - {d.w('avg', 'c', -19, 0)}", d.w("stddev_samp", "c", -19, 0)), "log1p": "ln(1 + c)", "binary": "(sign(c - m) + 1) / 2",
    }
    return f"SELECT symbol, ts, {', '.join(f'{r6(v)} AS {k}' for k, v in columns.items())} FROM ({joined}) j"


@series
def quantile_transform(d):
    return f"SELECT symbol, ts, {r6('percent_rank() OVER (PARTITION BY symbol ORDER BY c)')} AS q FROM {bars(d)} b"


# ---- ledgers ---------------------------------------------------------------------------------------------------------------


def running(d: Dialect, rows: str, x: str, name: str, agg: str = "sum") -> str:
    """``rows`` (with ``exit_datetime, id``) with the running sum or maximum of ``x`` in order of exit, then id.

    Spark takes it in two levels, over days and within each day, so that no task holds the whole ledger; the twin over all rows.
    """
    along = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    if d.name == "duckdb":
        return f"(SELECT *, {agg}({x}) OVER (ORDER BY exit_datetime, id {along}) AS {name} FROM {rows} r_)"
    days = f"SELECT exit_datetime AS day_, {agg}({x}) AS part_ FROM {rows} d_ GROUP BY exit_datetime"
    before = f"SELECT day_, {agg}(part_) OVER (ORDER BY day_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_ FROM ({days}) p_"
    within = f"{agg}({x}) OVER (PARTITION BY exit_datetime ORDER BY id {along})"
    value = f"coalesce(before_, 0) + {within}" if agg == "sum" else f"greatest(before_, {within})"
    return f"(SELECT * EXCEPT (day_, before_), {value} AS {name} FROM {rows} r_ JOIN ({before}) b_ ON day_ = exit_datetime)"


def _equity(d: Dialect) -> str:
    """Trades by exit with running equity (sum of account returns of 1 % of a trade's) and its peak."""
    rows = f"(SELECT id, exit_datetime, trade_return_pct AS ret, direction, regime FROM {ledger()} t)"
    base = f"(SELECT * EXCEPT (gain), round(100 + gain, 6) AS equity FROM {running(d, rows, 'ret / 100', 'gain')} g)"
    base = base if d.name == "spark" else base.replace("* EXCEPT (gain)", "* EXCLUDE (gain)")
    top = running(d, base, "equity", "top", "max")
    return f"(SELECT id, exit_datetime, ret, direction, regime, equity, greatest(100, top) AS peak FROM {top} q)"


@series
def ledger_essential_stats(d):
    return (
        f"SELECT count(*) AS trades, {r6('avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END)')} AS win_rate, {r6('avg(ret)')} AS mean_return, {r6('min((equity - peak) / peak)')} AS max_drawdown, "
        f"{r6('avg(ret / 100) / stddev_samp(ret / 100) * sqrt(365.0)')} AS sharpe, {r6('sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / nullif(sum(CASE WHEN ret < 0 THEN -ret ELSE 0 END), 0)')} AS profit_factor, "
        f"{r6('avg(ret) * sqrt(365.0) / nullif(sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)), 0)')} AS sortino FROM {_equity(d)} e"
    )


@series
def ledger_trade_analysis(d):
    days = f"({d.hours_between('entry_datetime', 'exit_datetime')} / 24)"
    return (
        f"SELECT direction, count(*) AS trades, sum(CASE WHEN trade_return_pct > 0 THEN 1 ELSE 0 END) AS wins, {r6('max(trade_return_pct)')} AS best, {r6('min(trade_return_pct)')} AS worst, {r6('avg(trade_return_pct)')} AS mean, "
        f"{r6(d.quantile('trade_return_pct', 0.5))} AS median, {r6(f'avg({days})')} AS mean_days, {r6(f'max({days})')} AS longest_days, {r6('stddev_samp(trade_return_pct)')} AS sd FROM {ledger()} t GROUP BY direction"
    )


@series
def ledger_streaks(d):
    """Longest winning and losing runs per direction, by differences of row numbers. Spark counts rows by day first, then within it."""
    if d.name == "spark":
        signs = f"(SELECT direction, entry_datetime AS day, id, CASE WHEN trade_return_pct > 0 THEN 1 ELSE 0 END AS win FROM {_closed(d)} t)"
        days = f"SELECT direction, day, count(*) AS m, sum(win) AS w FROM {signs} s GROUP BY direction, day"
        before = f"SELECT direction, day, sum(m) OVER (PARTITION BY direction ORDER BY day) - m AS m, sum(w) OVER (PARTITION BY direction ORDER BY day) - w AS w FROM ({days}) x"
        within = "OVER (PARTITION BY s.direction, s.day ORDER BY s.id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        # Rows and wins so far, this one included: their difference stays the same along a winning run, the wins along a losing one.
        places = f"SELECT /*+ BROADCAST(b) */ s.direction, s.win, b.m + row_number() OVER (PARTITION BY s.direction, s.day ORDER BY s.id) AS k, b.w + sum(s.win) {within} AS wins FROM {signs} s JOIN ({before}) b ON b.direction = s.direction AND b.day = s.day"
        islands = f"SELECT direction, win, CASE WHEN win = 1 THEN k - wins ELSE wins END AS g FROM ({places}) p"
        return f"SELECT direction, win, max(n) AS longest FROM (SELECT direction, win, g, count(*) AS n FROM ({islands}) i GROUP BY direction, win, g) q GROUP BY direction, win"
    signs = f"SELECT direction, entry_datetime, id, CASE WHEN trade_return_pct > 0 THEN 1 ELSE 0 END AS win FROM {ledger()} t"
    islands = f"SELECT direction, win, row_number() OVER (PARTITION BY direction ORDER BY entry_datetime, id) - row_number() OVER (PARTITION BY direction, win ORDER BY entry_datetime, id) AS g FROM ({signs}) s"
    return f"SELECT direction, win, max(n) AS longest FROM (SELECT direction, win, g, count(*) AS n FROM ({islands}) i GROUP BY direction, win, g) q GROUP BY direction, win"


@series
def ledger_drawdowns(d):
    """Drawdown periods: from one equity peak to the next."""
    marked = running(d, _equity(d), "CASE WHEN equity >= peak THEN 1 ELSE 0 END", "period")
    return f"SELECT CAST(period AS BIGINT) AS period, count(*) AS trades, {r6('min((equity - peak) / peak)')} AS depth FROM {marked} m WHERE equity < peak GROUP BY period"


@series
def ledger_monthly(d):
    month = "year(exit_datetime) * 100 + month(exit_datetime)"
    last = f"SELECT {month} AS month, {d.last_by('equity', 'struct_(exit_datetime, id)')} AS balance FROM {_equity(d)} e GROUP BY {month}".replace("struct_(", "struct(" if d.name == "spark" else "row(")
    return f"SELECT month, {r6('balance')} AS balance, {r6('balance / lag(balance) OVER (ORDER BY month) - 1')} AS change FROM ({last}) q"


@series
def ledger_distribution(d):
    q = lambda p: r6(d.quantile("trade_return_pct", p))
    x = "trade_return_pct"
    skew = f"(avg(power({x}, 3)) - 3 * avg({x}) * avg(power({x}, 2)) + 2 * power(avg({x}), 3)) / power(stddev_pop({x}), 3)"
    return f"SELECT {q(0.01)} AS p01, {q(0.05)} AS p05, {q(0.25)} AS p25, {q(0.5)} AS p50, {q(0.75)} AS p75, {q(0.95)} AS p95, {q(0.99)} AS p99, {r6(skew)} AS skew, {r6(f'avg({x}) - 1.645 * stddev_samp({x})')} AS parametric_var FROM {ledger()} t"


@series
def ledger_ratios(d):
    x = "trade_return_pct / 100"
    return f"SELECT direction, {r6(f'avg({x}) / nullif(var_samp({x}), 0)')} AS kelly, {r6(f'exp(avg(ln(1 + {x}))) - 1')} AS geometric_mean, {r6(f'avg(CASE WHEN {x} > 0 THEN {x} END) / nullif(abs(avg(CASE WHEN {x} < 0 THEN {x} END)), 0)')} AS payoff FROM {ledger()} t GROUP BY direction"


@series
def ledger_long_short(d):
    return f"SELECT direction, regime, count(*) AS n, {r6('sum(trade_return_pct)')} AS total FROM {ledger()} t GROUP BY GROUPING SETS ((direction, regime), (direction), (regime), ())"


@series
def ledger_cash_flow(d):
    """Money in and out by day."""
    moves = f"SELECT entry_datetime AS day, -CAST(round(size * 100) AS BIGINT) AS flow FROM {ledger()} a UNION ALL SELECT exit_datetime AS day, CAST(round(size * (100 + trade_return_pct)) AS BIGINT) AS flow FROM {ledger()} b"
    return f"SELECT day, CAST(sum(flow) AS BIGINT) AS flow_cents FROM ({moves}) m GROUP BY day"


@series
def ledger_benchmark(d):
    """Daily returns of closed trades against a buy-and-hold of daily closes: beta, alpha, tracking error, capture."""
    mine = f"SELECT exit_datetime AS day, sum(trade_return_pct) / 10000 AS r FROM {ledger()} t GROUP BY exit_datetime"
    market = f"SELECT ts AS day, c / lag(c) OVER (ORDER BY ts) - 1 AS m FROM {daily()} b"
    x = f"SELECT k.day, coalesce(a.r, 0e0) AS r, k.m FROM ({market}) k LEFT JOIN ({mine}) a ON a.day = k.day WHERE k.m IS NOT NULL"
    return (
        f"SELECT count(*) AS days, {r6('covar_samp(r, m) / var_samp(m)')} AS beta, {r6('avg(r) - covar_samp(r, m) / var_samp(m) * avg(m)')} AS alpha, {r6('stddev_samp(r - m)')} AS tracking_error, "
        f"{r6('avg(r - m) / stddev_samp(r - m)')} AS information_ratio, {r6(corr('r', 'm'))} AS correlation, {r6('avg(CASE WHEN m > 0 THEN r END) / avg(CASE WHEN m > 0 THEN m END)')} AS up_capture FROM ({x}) z"
    )


@series
def ledger_daily_returns(d):
    return f"SELECT exit_datetime AS day, {r6('exp(sum(ln(1 + trade_return_pct / 10000))) - 1')} AS daily_return, count(*) AS trades FROM {ledger()} t GROUP BY exit_datetime"


@series
def ledger_underwater(d):
    return f"SELECT id, exit_datetime, {r6('(equity - peak) / peak')} AS drawdown FROM {_equity(d)} e"


@series
def ledger_exposure(d):
    return f"SELECT direction, count(*) AS n, {r6('avg(size)')} AS mean_size, {r6('stddev_pop(size)')} AS sd_size, {r6(d.quantile('size', 0.95))} AS p95_size, {r6('1e0 * count(*) / sum(count(*)) OVER ()')} AS share FROM {ledger()} t GROUP BY direction"


@series
def ledger_recent_performance(d):
    last = f"SELECT *, row_number() OVER (ORDER BY exit_datetime DESC) AS k FROM (SELECT exit_datetime, sum(ln(1 + trade_return_pct / 10000)) AS g FROM {ledger()} t GROUP BY exit_datetime) q"
    return f"SELECT days, {r6('exp(sum(g)) - 1')} AS total FROM (SELECT * FROM ({last}) z WHERE k <= 90) y JOIN (VALUES (1), (7), (15), (30), (45), (60), (90)) AS n(days) ON y.k <= n.days GROUP BY days"


@series
def ledger_monthly_heatmap(d):
    return f"SELECT year(exit_datetime) AS y, month(exit_datetime) AS m, {r6('sum(trade_return_pct)')} AS total FROM {ledger()} t GROUP BY year(exit_datetime), month(exit_datetime)"


@series
def ledger_value_at_risk(d):
    cut = f"SELECT {d.quantile('trade_return_pct', 0.05)} AS v FROM {ledger()} t"
    return f"SELECT {r6('max(v)')} AS var_95, {r6('avg(trade_return_pct)')} AS cvar_95, count(*) AS n FROM {ledger()} t CROSS JOIN ({cut}) q WHERE trade_return_pct <= v"


@series
def variance_ratio_test(d):
    """Lo-MacKinlay variance ratio of log returns for q of 2, 5 and 10."""
    x = f"SELECT symbol, ln(c) - ln({d.lag('c')}) AS r1, " + ", ".join(f"ln(c) - ln({d.lag('c', q)}) AS r{q}" for q in (2, 5, 10)) + f" FROM {bars(d)} b"
    return f"SELECT symbol, {', '.join(f'{r6(f"var_samp(r{q}) / ({q} * var_samp(r1))")} AS vr_{q}' for q in (2, 5, 10))} FROM ({x}) z GROUP BY symbol"


@series
def ic_conditional(d):
    """Correlation of momentum and next return in calm and in wild bars."""
    x = f"SELECT symbol, c / {d.lag('c', 5)} - 1 AS f, {d.lead('c')} / c - 1 AS y, abs(c / {d.lag('c')} - 1) AS m FROM {bars(d)} b"
    return f"SELECT symbol, {r6(corr('f', 'y', 'm < 0.5'))} AS calm, {r6(corr('f', 'y', 'm > 2'))} AS wild, {r6(corr('f', 'y'))} AS every FROM ({x}) z WHERE f IS NOT NULL AND y IS NOT NULL GROUP BY symbol"


@series
def ic_rolling_stability(d):
    x = f"SELECT symbol, ts, c / {d.lag('c', 5)} - 1 AS f, {d.lead('c')} / c - 1 AS y FROM {bars(d)} b"
    y = f"SELECT symbol, ts, CASE WHEN row_number() OVER ({d.over}) >= 60 THEN {d.w2('corr', 'f', 'y', -59, 0)} END AS ic FROM ({x}) z WHERE f IS NOT NULL AND y IS NOT NULL"
    return f"SELECT symbol, {r6('avg(ic)')} AS mean_ic, {r6('least(abs(avg(ic)) / nullif(stddev_samp(ic), 0), 100e0)')} AS stability FROM ({y}) q GROUP BY symbol"


@series
def signal_turnover(d):
    x = f"SELECT symbol, CASE WHEN trend_signals <> {d.lag('trend_signals')} THEN 1e0 ELSE 0e0 END AS flip FROM {_signals(d)} s"
    return f"SELECT symbol, {r6('avg(flip)')} AS turnover, count(*) AS n FROM ({x}) q GROUP BY symbol"


@series
def ledger_rolling(d):
    w = "OVER (PARTITION BY regime ORDER BY entry_datetime, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    k = "row_number() OVER (PARTITION BY regime ORDER BY entry_datetime, id)"
    return f"SELECT id, regime, CASE WHEN {k} >= 20 THEN {r6(f'avg(trade_return_pct) {w}')} END AS mean_20, CASE WHEN {k} >= 20 THEN {r6(f'avg(CASE WHEN trade_return_pct > 0 THEN 1e0 ELSE 0e0 END) {w}')} END AS win_20 FROM {ledger()} t"


# ---- trades by regime ------------------------------------------------------------------------------------------------------


def _tagged() -> str:
    """Trades with a regime at entry and at exit, a confidence in [0, 1] and a reason of exit."""
    return f"(SELECT *, lead(regime) OVER (PARTITION BY direction ORDER BY entry_datetime, id) AS exit_regime, CAST(id % 100 AS DOUBLE) / 100 AS confidence, CASE WHEN trade_return_pct < -5 THEN 'SL - Static' WHEN trade_return_pct > 5 THEN 'TP - Static' ELSE 'Signal' END AS action FROM {ledger()} t)"


@series
def regime_performance(d):
    x = "trade_return_pct"
    return f"SELECT coalesce(regime, 'all') AS regime, coalesce(direction, 'all') AS direction, count(*) AS n, {r6(f'avg({x})')} AS mean, {r6(f'stddev_pop({x})')} AS sd, {r6(f'avg(CASE WHEN {x} > 0 THEN 1e0 ELSE 0e0 END)')} AS win_rate FROM {_tagged()} g GROUP BY GROUPING SETS ((regime), (direction), (regime, direction))"


@series
def regime_transition_matrix(d):
    return f"SELECT regime, exit_regime, count(*) AS n, {r6('avg(trade_return_pct)')} AS mean FROM {_tagged()} g WHERE exit_regime IS NOT NULL GROUP BY regime, exit_regime"


@series
def regime_exit_breakdown(d):
    return f"SELECT regime, direction, sum(CASE WHEN action LIKE 'SL%' THEN 1 ELSE 0 END) AS stops, sum(CASE WHEN action LIKE 'TP%' THEN 1 ELSE 0 END) AS targets, sum(CASE WHEN action NOT LIKE 'SL%' AND action NOT LIKE 'TP%' THEN 1 ELSE 0 END) AS others FROM {_tagged()} g GROUP BY regime, direction"


@series
def regime_metric_quartiles(d):
    edges = f"SELECT {d.quantile('confidence', 0.25)} AS a, {d.quantile('confidence', 0.5)} AS b, {d.quantile('confidence', 0.75)} AS c FROM {_tagged()} g"
    return f"SELECT CASE WHEN confidence < a THEN 1 WHEN confidence < b THEN 2 WHEN confidence < c THEN 3 ELSE 4 END AS quartile, count(*) AS n, {r6('avg(trade_return_pct)')} AS mean FROM {_tagged()} g CROSS JOIN ({edges}) e GROUP BY CASE WHEN confidence < a THEN 1 WHEN confidence < b THEN 2 WHEN confidence < c THEN 3 ELSE 4 END"


@series
def regime_score_bins(d):
    bins = f"SELECT CAST(least(floor(confidence * 10), 9) AS INT) AS bin, count(*) AS n, avg(trade_return_pct) AS mean FROM {_tagged()} g GROUP BY CAST(least(floor(confidence * 10), 9) AS INT)"
    return f"SELECT bin, n, {r6('mean')} AS mean, CASE WHEN n >= 5 AND rank() OVER (ORDER BY CASE WHEN n >= 5 THEN mean END DESC NULLS LAST) = 1 THEN 1 ELSE 0 END AS best FROM ({bins}) q"


@series
def regime_confidence(d):
    b = "CASE WHEN confidence < 0.25 THEN 'low' WHEN confidence < 0.45 THEN 'medium' ELSE 'high' END"
    return f"SELECT {b} AS bucket, regime, count(*) AS n, {r6('avg(trade_return_pct)')} AS mean FROM {_tagged()} g GROUP BY {b}, regime"


@series
def regime_duration(d):
    days = f"{d.hours_between('entry_datetime', 'exit_datetime')} / 24"
    b = f"CASE WHEN {days} < 7 THEN 1 WHEN {days} < 14 THEN 2 WHEN {days} < 30 THEN 3 WHEN {days} < 60 THEN 4 WHEN {days} < 90 THEN 5 WHEN {days} < 120 THEN 6 ELSE 7 END"
    return f"SELECT {b} AS bucket, count(*) AS n, {r6('avg(trade_return_pct)')} AS mean FROM {_tagged()} g GROUP BY {b}"


@series
def regime_fitness(d):
    """Weighted win rate, capped profit factor, capped mean return and trade count of a regime, times a drawdown penalty."""
    run = "PARTITION BY regime ORDER BY exit_datetime, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    wealth = f"SELECT regime, exit_datetime, id, trade_return_pct AS x, exp(sum(ln(greatest(1 + trade_return_pct / 100, 1e-10))) OVER ({run})) AS w FROM {_tagged()} g"
    falls = f"SELECT regime, x, w / greatest(1e0, max(w) OVER ({run})) - 1 AS fall FROM ({wealth}) e"
    gain, loss = "sum(CASE WHEN x > 0 THEN x ELSE 0 END)", "sum(CASE WHEN x < 0 THEN -x ELSE 0 END)"
    if d.name == "duckdb":
        stats = f"SELECT regime, count(*) AS n, 100e0 * count(*) FILTER (x > 0) / count(*) AS win, CASE WHEN {loss} > 0 THEN {gain} / {loss} ELSE 0 END AS pf, avg(x) AS mean, min(fall) * 100 AS dd FROM ({falls}) f GROUP BY regime"
        return f"SELECT regime, round((least(greatest(win / 100, 0), 1) * 0.25e0 + least(greatest(pf, 0), 3) / 3 * 0.30e0 + least(greatest(mean, 0), 5) / 5 * 0.25e0 + least(n / 30.0, 1) * 0.20e0) * (1 - least(abs(dd) / 100, 1)), 4) AS fitness, n >= 30 AS reliable FROM ({stats}) s"
    score = f"25e-2 * avg(CASE WHEN x > 0 THEN 1e0 ELSE 0e0 END) + 3e-1 * least(coalesce({gain} / nullif({loss}, 0), 0), 3) / 3 + 25e-2 * least(greatest(avg(x), 0), 5) / 5 + 2e-1 * least(count(*) / 3e1, 1)"
    return f"SELECT regime, round(({score}) * (1 - least(-min(fall), 1)), 4) AS fitness, count(*) >= 30 AS reliable FROM ({falls}) f GROUP BY regime"


@series
def regime_changed_trades(d):
    return f"SELECT direction, CASE WHEN regime = exit_regime THEN 'same' ELSE 'changed' END AS kind, count(*) AS n, {r6('avg(trade_return_pct)')} AS mean FROM {_tagged()} g WHERE exit_regime IS NOT NULL GROUP BY direction, CASE WHEN regime = exit_regime THEN 'same' ELSE 'changed' END"


# ---- signals, backtest, quality --------------------------------------------------------------------------------------------


def _signals(d: Dialect) -> str:
    return f"(SELECT symbol, ts, o, c, CAST(sign(c - {d.lag('c')}) AS INT) AS momentum_signals, CASE WHEN c > {d.w('avg', 'c', -20, -1)} THEN 1 ELSE -1 END AS trend_signals, CASE WHEN c > o THEN 1 WHEN c < o THEN -1 ELSE 0 END AS body_signals FROM {bars(d)} b)"


@series
def majority_signal(d):
    votes = "coalesce(momentum_signals, 0) + trend_signals + body_signals"
    return f"SELECT symbol, ts, CAST(sign({votes}) AS INT) AS signal FROM {_signals(d)} s"


@series
def signal_edges(d):
    inner = f"SELECT symbol, ts, trend_signals AS s, {d.lag('trend_signals')} AS p FROM {_signals(d)} s"
    return f"SELECT symbol, ts, s, CASE WHEN p IS NULL OR s <> p THEN 1 ELSE 0 END AS entry FROM ({inner}) q"


@series
def backtest_next_open(d):
    """Position of the last bar's signal from this open to the next, fees on changes."""
    pos = f"SELECT symbol, ts, {d.lag('trend_signals')} AS pos, {d.lag('trend_signals', 2)} AS before, {d.lead('o')} / o - 1 AS move FROM {_signals(d)} s"
    pnl = f"SELECT symbol, ts, coalesce(pos, 0) * move / 100 - 0.0004 * abs(coalesce(pos, 0) - coalesce(before, 0)) AS pnl FROM ({pos}) p WHERE move IS NOT NULL"
    return f"SELECT symbol, count(*) AS bars, {r6('sum(pnl)')} AS total, {r6('avg(pnl) / nullif(stddev_samp(pnl), 0)')} AS sharpe FROM ({pnl}) q GROUP BY symbol"


@series
def bar_quality_stats(d):
    x = f"SELECT symbol, c, v, h, l, ln(c) - ln({d.lag('c')}) AS r FROM {bars(d)} b"
    kurt = "(avg(power(r, 4)) - 4 * avg(r) * avg(power(r, 3)) + 6 * power(avg(r), 2) * avg(power(r, 2)) - 3 * power(avg(r), 4)) / power(stddev_pop(r), 4)"
    skew = "(avg(power(r, 3)) - 3 * avg(r) * avg(power(r, 2)) + 2 * power(avg(r), 3)) / power(stddev_pop(r), 3)"
    return f"SELECT symbol, count(*) AS bars, {r6('avg(r)')} AS mean_r, {r6('stddev_pop(r)')} AS sd_r, {r6(skew)} AS skew, {r6(kurt)} AS kurtosis, {r6('count(r) / 6.0 * (power(' + skew + ', 2) + power(' + kurt + ' - 3, 2) / 4)')} AS jarque_bera, {r6('stddev_pop(v) / avg(v)')} AS volume_cv, {r6(d.quantile('r', 0.05))} AS p05, {r6(d.quantile('r', 0.95))} AS p95 FROM ({x}) q GROUP BY symbol HAVING count(*) >= 50"


@series
def return_entropy(d):
    """Entropy in bits of returns in 50 bins of equal width."""
    x = f"SELECT symbol, ln(c) - ln({d.lag('c')}) AS r FROM {bars(d)} b"
    m = f"SELECT symbol, r, min(r) OVER (PARTITION BY symbol) AS lo, max(r) OVER (PARTITION BY symbol) AS hi, count(r) OVER (PARTITION BY symbol) AS n FROM ({x}) a"
    binned = f"SELECT symbol, least(floor((r - lo) / (hi - lo) * 50), 49) AS bin, max(n) AS n, count(*) AS k FROM ({m}) q WHERE r IS NOT NULL GROUP BY symbol, least(floor((r - lo) / (hi - lo) * 50), 49)"
    return f"SELECT symbol, {r6('-sum(1.0 * k / n * log2(1.0 * k / n))')} AS entropy FROM ({binned}) z GROUP BY symbol"


@series
def rank_ic(d):
    """Spearman correlation of a feature with the return five bars ahead, average ranks."""
    x = f"SELECT symbol, c / {d.lag('c', 5)} - 1 AS f, {d.lead('c', 5)} / c - 1 AS y FROM {bars(d)} b"
    rank = lambda z: f"(rank() OVER (PARTITION BY symbol ORDER BY {z}) + (count(*) OVER (PARTITION BY symbol, {z}) - 1) / 2.0)"
    return f"SELECT symbol, {r6(corr('rf', 'ry'))} AS ic, count(*) AS n FROM (SELECT symbol, {rank('f')} AS rf, {rank('y')} AS ry FROM ({x}) a WHERE f IS NOT NULL AND y IS NOT NULL) q GROUP BY symbol"


@series
def ic_decay_profile(d):
    horizons = (1, 3, 5, 10, 20)
    moves = f"SELECT symbol, c / {d.lag('c', 5)} - 1 AS f, " + ", ".join(f"{d.lead('c', k)} / c - 1 AS y{k}" for k in horizons) + f" FROM {bars(d)} b"
    if d.name == "spark":  # one pass over the bars
        return f"SELECT symbol, horizon, {r6(corr('f', 'y'))} AS ic FROM ({moves}) a LATERAL VIEW stack({len(horizons)}, {', '.join(f'{k}, y{k}' for k in horizons)}) u AS horizon, y WHERE f IS NOT NULL AND y IS NOT NULL GROUP BY symbol, horizon"
    parts = " UNION ALL ".join(f"SELECT symbol, {k} AS horizon, {r6(corr('f', f'y{k}'))} AS ic FROM ({moves}) a WHERE f IS NOT NULL AND y{k} IS NOT NULL GROUP BY symbol" for k in horizons)
    return f"SELECT symbol, horizon, ic FROM ({parts}) u"


# ---- point look-ups, set operations ----------------------------------------------------------------------------------------


@series
def last_trade_topk(d):
    return f"SELECT id, entry_datetime FROM (SELECT id, entry_datetime, row_number() OVER (ORDER BY entry_datetime DESC, id DESC) AS k FROM {ledger()} t) q WHERE k <= 10"


@series
def open_trades(d):
    """Trades whose status is open: a filter that reaches the scan."""
    return "SELECT o_orderkey AS id, o_orderdate AS entry_datetime, o_totalprice AS size FROM {orders} WHERE o_orderstatus = 'O'"


@series
def series_extent(d):
    return "SELECT event_type AS symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM {events} GROUP BY event_type"


def _two_versions() -> str:
    """All trades as stored, two thirds of them closed, and all of them again as they come in later, beside a new one for each."""
    return (
        f"(SELECT id, direction, trade_return_pct AS ret, 1 AS version, CASE WHEN id % 3 = 0 THEN 'Open' ELSE 'Closed' END AS status FROM {ledger()} a "
        f"UNION ALL SELECT id, direction, trade_return_pct + 1 AS ret, 2 AS version, 'Closed' AS status FROM {ledger()} b "
        f"UNION ALL SELECT -1 - id AS id, direction, trade_return_pct AS ret, 2 AS version, 'Open' AS status FROM {ledger()} c)"
    )


@series
def upsert_latest_wins(d):
    if d.name == "duckdb":
        return f"WITH u AS MATERIALIZED (SELECT * FROM {_two_versions()}) SELECT id, ret, version FROM u WHERE version = 2 UNION ALL SELECT id, ret, version FROM u WHERE version = 1 AND id NOT IN (SELECT id FROM u WHERE version = 2)"
    return f"SELECT id, max_by(ret, version) AS ret, max(version) AS version FROM {_two_versions()} u GROUP BY id"


@series
def upsert_open_only(d):
    """Stored rows are replaced only while they are open."""
    if d.name == "duckdb":
        return f"WITH u AS MATERIALIZED (SELECT * FROM {_two_versions()}), old AS (SELECT * FROM u WHERE version = 1), new AS (SELECT * FROM u WHERE version = 2) SELECT n.id, CASE WHEN o.status = 'Closed' THEN o.ret ELSE n.ret END AS ret, CASE WHEN o.status = 'Closed' THEN 1 ELSE 2 END AS version FROM new n LEFT JOIN old o ON o.id = n.id"
    closed = "max(CASE WHEN version = 1 AND status = 'Closed' THEN 1 ELSE 0 END) = 1"
    return f"SELECT id, CASE WHEN {closed} THEN min_by(ret, version) ELSE max_by(ret, version) END AS ret, CASE WHEN {closed} THEN min(version) ELSE max(version) END AS version FROM {_two_versions()} u GROUP BY id"


@series
def insert_ignore(d):
    """First write wins."""
    if d.name == "duckdb":
        return f"WITH u AS MATERIALIZED (SELECT * FROM {_two_versions()}) SELECT id, ret, version FROM u WHERE version = 1 UNION ALL SELECT id, ret, version FROM u n WHERE version = 2 AND NOT EXISTS (SELECT 1 FROM u o WHERE o.version = 1 AND o.id = n.id)"
    return f"SELECT id, min_by(ret, version) AS ret, min(version) AS version FROM {_two_versions()} u GROUP BY id"


@series
def delete_by_key(d):
    return f"SELECT id, direction FROM {ledger()} t WHERE NOT (direction = 'Short' AND id % 2 = 0)"


@series
def json_props(d):
    value = "CAST(get_json_object(props, '$.k') AS BIGINT)" if d.name == "spark" else "CAST(json_extract_string(props, '$.k') AS BIGINT)"
    return f"SELECT event_type, count(*) AS n, sum({value}) AS total FROM {{events}} GROUP BY event_type"
