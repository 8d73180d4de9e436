"""Families of the carried-state indicators and window statistics, each with a twin that works another way.

The twins of the indicators carry their averages from bar to bar in one recursive query; those of the window statistics take windows
apart into rows and group them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tidewright.operators import recursive, swings, window_stats
from tidewright.plans.dialect import Duck, Spark
from tidewright.plans.series import bars

Run = Callable[[str], DataFrame]
FRAMES: dict[str, tuple[Callable[[Run], DataFrame], str]] = {}
_BARS = f"SELECT * FROM {bars(Spark())} b"

# ---- indicators ------------------------------------------------------------------------------------------------------------------

#: Averages: name -> (input, bars, seed bars, weight of the newest). Inputs are columns of the bar or outputs of averages of earlier levels.
_W = lambda x, n: (x, n, n, 1 / n)
_E = lambda x, n, seed=None: (x, n, n if seed is None else seed, 2 / (n + 1))
LEVELS = [
    {
        **{f"e{n}": _E("c", n) for n in (5, 12, 20, 26, 50, 200)}, "g1": _E("c", 5), "t1": _E("c", 15), "ru": _W("gain", 14), "rd": _W("loss", 14), "a14": _W("tr", 14), "a5": _W("tr", 5), "a20": _W("tr", 20), "a10": _W("tr", 10),
        "xt": _W("trx", 14), "xp": _W("up", 14), "xm": _W("dn", 14), "v5": _E("v", 5, 0), "v20": _E("v", 20, 0), "c3": _E("ad", 3, 0), "c10": _E("ad", 10, 0), "mu": _E("r", 50, 0),
    },
    {"d2": _E("e20", 20), "t2": _E("e20", 20), "g2": _E("g1", 5), "u2": _E("t1", 15), "sg": _E("(e12 - e26)", 9), "ax": _W("CASE WHEN xt > 0 THEN CASE WHEN xp + xm > 0 THEN 100 * abs(100 * xp / xt - 100 * xm / xt) / (100 * xp / xt + 100 * xm / xt) ELSE 0e0 END END", 14), "var": _E("power(r - mu, 2)", 50, 0)},
    {"t3": _E("t2", 20), "g3": _E("g2", 5), "u3": _E("u2", 15)},
    {"g4": _E("g3", 5)}, {"g5": _E("g4", 5)}, {"g6": _E("g5", 5)},
]


def _averages_sql() -> str:
    """``out``: every bar with the outputs of all averages, the adaptive average, the two stops, and the filter of sums."""
    w = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
    first = f"SELECT symbol, ts, h, l, c, v, row_number() OVER w AS k, lag(c) OVER w AS pc, lag(h) OVER w AS ph, lag(l) OVER w AS pl, c - lag(c) OVER w AS dc FROM {bars(Duck())} b {w}"
    second = f"SELECT *, CASE WHEN dc IS NOT NULL THEN greatest(dc, 0) END AS gain, CASE WHEN dc IS NOT NULL THEN greatest(-dc, 0) END AS loss, greatest(h - l, coalesce(abs(h - pc), 0e0), coalesce(abs(l - pc), 0e0)) AS tr, CASE WHEN pc IS NOT NULL THEN greatest(h - l, abs(h - pc), abs(l - pc)) END AS trx, CASE WHEN h - ph > pl - l AND h - ph > 0 THEN h - ph WHEN pc IS NOT NULL THEN 0e0 END AS up, CASE WHEN pl - l > h - ph AND pl - l > 0 THEN pl - l WHEN pc IS NOT NULL THEN 0e0 END AS dn, sum(CASE WHEN h > l THEN ((c - l) - (h - c)) / (h - l) * v ELSE 0e0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS ad, ln(c / pc) AS r, CASE WHEN row_number() OVER w > 30 THEN abs(c - lag(c, 30) OVER w) END AS way, sum(abs(dc)) OVER (w ROWS 29 PRECEDING) AS moves FROM ({first}) f {w}"
    rows = f"rows_ AS MATERIALIZED ({second})"
    names = [n for level in LEVELS for n in level]
    extra = "kama up_ lo_ trend sar ep af rising cu cd fired".split()
    null = "CAST(NULL AS DOUBLE)"
    zero = ", ".join(f"0 AS s_{n}, 0e0 AS v_{n}, {null} AS {n}" for n in names) + f", {null} AS kama, {null} AS up_, {null} AS lo_, 1 AS trend, {null} AS sar, {null} AS ep, 0.02::DOUBLE AS af, true AS rising, 0e0 AS cu, 0e0 AS cd, 0e0 AS fired"
    start = f"SELECT symbol, CAST(0 AS BIGINT) AS k, {zero} FROM rows_ WHERE k = 1"
    carried = ", ".join([*(f"a.s_{n}, a.v_{n}" for n in names), *(f"a.{e} AS {e}0" for e in extra if e != "fired")])
    x = f"SELECT r.*, {carried} FROM acc a JOIN rows_ r ON r.symbol = a.symbol AND r.k = a.k + 1"
    for level in LEVELS:
        x = f"SELECT *, {', '.join(f'{spec[0]} AS i_{n}' for n, spec in level.items())} FROM ({x})"
        seen = ", ".join(f"CASE WHEN i_{n} IS NULL THEN s_{n} ELSE s_{n} + 1 END AS z_{n}" for n in level)
        x = f"SELECT *, {seen} FROM ({x})"
        value = ", ".join(f"CASE WHEN i_{n} IS NULL THEN v_{n} WHEN z_{n} <= {max(seed, 1)} THEN v_{n} + (i_{n} - v_{n}) / z_{n} ELSE v_{n} + {alpha!r} * (i_{n} - v_{n}) END AS y_{n}" for n, (_, _, seed, alpha) in level.items())
        x = f"SELECT *, {value} FROM ({x})"
        x = f"SELECT *, {', '.join(f'CASE WHEN i_{n} IS NOT NULL AND z_{n} >= {seed} THEN y_{n} END AS {n}' for n, (_, _, seed, _) in level.items())} FROM ({x})"
    # Adaptive average; bands of the trend stop; the parabolic stop's move; the filter's sums.
    speed = "power((CASE WHEN moves > 0 THEN way / moves ELSE 1 END) * (2e0 / 3 - 2e0 / 31) + 2e0 / 31, 2)"
    x = f"SELECT *, CASE WHEN way IS NOT NULL THEN coalesce(kama0, pc) + {speed} * (c - coalesce(kama0, pc)) END AS kama, (h + l) / 2 + 3 * a10 AS hi, (h + l) / 2 - 3 * a10 AS lo, CASE WHEN sar0 IS NULL THEN NOT coalesce(pl - l > greatest(h - ph, 0), false) ELSE rising0 END AS ris, greatest(0, cu0 + r) AS cu1, least(0, cd0 + r) AS cd1 FROM ({x})"
    x = "SELECT *, CASE WHEN a10 IS NULL THEN up_0 WHEN up_0 IS NULL OR hi < up_0 OR pc > up_0 THEN hi ELSE up_0 END AS up_, CASE WHEN a10 IS NULL THEN lo_0 WHEN lo_0 IS NULL OR lo > lo_0 OR pc < lo_0 THEN lo ELSE lo_0 END AS lo_, CASE WHEN a10 IS NULL OR up_0 IS NULL THEN trend0 WHEN c > up_0 THEN 1 WHEN c < lo_0 THEN -1 ELSE trend0 END AS trend, " + (
        "CASE WHEN pc IS NULL THEN NULL WHEN sar0 IS NULL THEN CASE WHEN ris THEN pl ELSE ph END WHEN ris THEN least(sar0 + af0 * (ep0 - sar0), pl) ELSE greatest(sar0 + af0 * (ep0 - sar0), ph) END AS sar1, CASE WHEN sar0 IS NULL THEN CASE WHEN ris THEN h ELSE l END ELSE ep0 END AS ep1, CASE WHEN r IS NULL THEN 0e0 WHEN cd1 < -0.5 THEN -1e0 WHEN cu1 > 0.5 THEN 1e0 ELSE 0e0 END AS fired "
    ) + f"FROM ({x})"
    x = f"SELECT *, pc IS NOT NULL AND ((ris AND l < sar1) OR (NOT ris AND h > sar1)) AS turned FROM ({x})"
    further = "(ris AND h > ep1) OR (NOT ris AND l < ep1)"
    ends = (
        f"kama, up_, lo_, trend, CASE WHEN turned THEN ep1 ELSE sar1 END AS sar, CASE WHEN turned THEN CASE WHEN ris THEN l ELSE h END WHEN {further} THEN CASE WHEN ris THEN h ELSE l END ELSE ep1 END AS ep, CASE WHEN turned THEN 0.02 WHEN {further} THEN least(af0 + 0.02, 0.2) ELSE af0 END AS af, "
        "CASE WHEN pc IS NULL THEN true WHEN turned THEN NOT ris ELSE ris END AS rising, CASE WHEN r IS NULL THEN cu0 WHEN fired > 0 THEN 0 ELSE cu1 END AS cu, CASE WHEN r IS NULL THEN cd0 WHEN fired < 0 THEN 0 ELSE cd1 END AS cd, fired"
    )
    step = f"SELECT symbol, k, {', '.join(f'z_{n}, y_{n}, {n}' for n in names)}, {ends} FROM ({x})"
    keep = ", ".join(f"acc.{n}" for n in [*names, *extra])
    return f"WITH RECURSIVE {rows}, acc AS ({start} UNION ALL {step}), out AS MATERIALIZED (SELECT r.symbol, r.ts, r.k, r.h, r.l, r.c, r.v, r.r, {keep} FROM rows_ r JOIN acc USING (symbol, k))"


_LAG = lambda x, n: f"lag({x}, {n}) OVER w"
_RSI = "CASE WHEN ru + rd > 0 THEN 100 * ru / (ru + rd) WHEN ru IS NOT NULL THEN 0e0 END"
INDICATORS = {
    "indicators_averages": {
        **{f"ema_{n}": f"e{n}" for n in (5, 12, 20, 26, 50, 200)}, "dema_20": "2 * e20 - d2", "tema_20": "3 * e20 - 3 * t2 + t3", "t3_5": "-0.343 * g6 + (3 * 0.49 + 3 * 0.343) * g5 + (-6 * 0.49 - 2.1 - 3 * 0.343) * g4 + (1 + 2.1 + 0.343 + 3 * 0.49) * g3",
        "trix_15": f"100 * (u3 / nullif({_LAG('u3', 1)}, 0) - 1)", "macd": "e12 - e26", "macd_signal": "sg", "macd_hist": "e12 - e26 - sg", "kama_30": "kama", "ema_slope": f"(e20 - {_LAG('e20', 5)}) / 5",
    },
    "indicators_strength": {
        "rsi_14": "rsi", "rsi_slope": f"(rsi - {_LAG('rsi', 3)}) / 3", "cmo_14": "2 * rsi - 100", "plus_di": "CASE WHEN xt > 0 THEN 100 * xp / xt END", "minus_di": "CASE WHEN xt > 0 THEN 100 * xm / xt END", "dx": "i_dx", "adx_14": "ax", "adx_slope": f"(ax - {_LAG('ax', 5)}) / 5", "adxr_14": f"(ax + {_LAG('ax', 13)}) / 2",
        "stochrsi_k": "fastk", "stochrsi_d": "CASE WHEN count(fastk) OVER (w ROWS 2 PRECEDING) = 3 THEN sum(fastk) OVER (w ROWS 2 PRECEDING) / 3 END",
    },
    "indicators_ranges": {
        "atr_14": "a14", "natr_14": "100 * a14 / c", "atr_percent": "100 * a14 / (c + 1e-8)", "keltner_upper": "e20 + 2 * a10", "bb_squeeze": "CASE WHEN k >= 20 AND a14 > 1e-8 THEN 4 * stddev_pop(c) OVER (w ROWS 19 PRECEDING) / (3 * a14) END", "range_compression_ratio": "CASE WHEN a20 > 1e-8 THEN a5 / a20 END",
        "volume_ema_ratio": "CASE WHEN v20 > 1e-8 THEN v5 / v20 END", "volume_compression": "CASE WHEN v20 > 1e-8 THEN v / v20 END", "chaikin_oscillator": "c3 - c10", "ewm_vol": "CASE WHEN r IS NOT NULL THEN sqrt(greatest(var, 0)) END",
    },
    "indicators_stops": {"supertrend": "CASE WHEN a10 IS NOT NULL THEN CASE WHEN trend > 0 THEN lo_ ELSE up_ END END", "supertrend_dir": "CASE WHEN a10 IS NOT NULL THEN trend::DOUBLE END", "sar": "sar", "sarext": "CASE WHEN rising THEN sar ELSE -sar END", "cusum": "fired"},
}


def _indicators(names: list[str]):
    def query(run: Run) -> DataFrame:
        return recursive.recursive_indicators(run(_BARS)).selectExpr("symbol", "ts", *(f"round({n}, 4) + 0D AS {n}" for n in names))

    return query


def _indicators_sql(values: dict[str, str]) -> str:
    base = f"SELECT *, {_RSI} AS rsi, {LEVELS[1]['ax'][0]} AS i_dx FROM out"
    fast = f"SELECT *, CASE WHEN count(rsi) OVER (w ROWS 13 PRECEDING) = 14 THEN CASE WHEN max(rsi) OVER (w ROWS 13 PRECEDING) > min(rsi) OVER (w ROWS 13 PRECEDING) THEN 100 * (rsi - min(rsi) OVER (w ROWS 13 PRECEDING)) / (max(rsi) OVER (w ROWS 13 PRECEDING) - min(rsi) OVER (w ROWS 13 PRECEDING)) ELSE 0e0 END END AS fastk FROM ({base}) b WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
    return f"{_averages_sql()} SELECT symbol, ts, {', '.join(f'round({v}, 4) + 0e0 AS {n}' for n, v in values.items())} FROM ({fast}) f WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


for _name, _values in INDICATORS.items():
    FRAMES[_name] = (_indicators(list(_values)), _indicators_sql(_values))

# ---- window statistics -------------------------------------------------------------------------------------------------------------

#: Families of statistics that share what their twins take apart.
WINDOWS = {
    "window_entropies": ["sample_entropy", "approximate_entropy", "permutation_entropy", "multiscale_entropy_1", "multiscale_entropy_2", "multiscale_entropy_4", "multiscale_entropy_8", "window_entropy"],
    "window_scaling": ["hurst_exponent", "scaling_function_tau", "lead_lag_signature", "transfer_entropy_5m_15m", "wasserstein_distance", "information_geometry_dist", "phase_space_recurrence", "lyapunov_exponent"],
    "window_events": ["hawkes_intensity", "extreme_event_clustering", "betti_0_mean_life", "betti_1_count", "drawdown_duration", "recovery_slope", "partial_directed_coherence", "multifractal_spectrum_width", "fisher_information"],
}
_EPS = "1e-8"
#: Digits; a correlation of events is a fraction that may end in a five at the fourth.
_DIGITS = {"extreme_event_clustering": 7}


def _windowed(names: list[str]):
    def query(run: Run) -> DataFrame:
        return window_stats.window_stats(run(_BARS), names).selectExpr("symbol", "ts", *(f"round({n}, {_DIGITS.get(n, 4)}) + 0D AS {n}" for n in names))

    return query


def _rows_sql() -> str:
    """``base``: bars with their return and place; ``win(n)`` later: a window's rows, counted from 0."""
    return f"base AS MATERIALIZED (SELECT symbol, ts, k, c, ln(c / lag(c) OVER w) AS r FROM (SELECT symbol, ts, c, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM {bars(Duck())} b) WINDOW w AS (PARTITION BY symbol ORDER BY k))"


def _win(name: str, n: int, x: str = "r") -> str:
    """The n rows before each bar that has as many returns (closes) before it."""
    least = n + 1 if x == "r" else n
    return f"{name} AS MATERIALIZED (SELECT a.symbol, a.k, b.k - a.k + {n} AS j, b.{x} AS x FROM base a JOIN base b ON b.symbol = a.symbol AND b.k BETWEEN a.k - {n} AND a.k - 1 WHERE a.k > {least})"


def _matched(name: str, source: str, m: int, templates: str) -> str:
    """Pairs of templates (first places up to ``templates``) whose m rows are all within ``near``: a row per template with its matches, itself included."""
    same = " AND ".join(f"abs(a.x{i} - b.x{i}) <= a.near" for i in range(m))
    return f"{name} AS MATERIALIZED (SELECT a.symbol, a.k, a.j, count(*) AS n FROM {source} a JOIN {source} b ON b.symbol = a.symbol AND b.k = a.k AND b.j <= {templates.replace('size', 'b.size')} AND {same} WHERE a.j <= {templates.replace('size', 'a.size')} GROUP BY a.symbol, a.k, a.j)"


def _entropies_sql() -> str:
    parts = [_rows_sql(), _win("w100", 100), _win("w20", 20)]
    over = "OVER (PARTITION BY symbol, k ORDER BY j)"
    lead = f"lead(x, 1) {over} AS x1, lead(x, 2) {over} AS x2"
    joined = []
    for scale in (1, 2, 4, 8):
        size = 100 // scale
        coarse = f"SELECT symbol, k, j // {scale} AS j, avg(x) AS x FROM w100 WHERE j < {size * scale} GROUP BY symbol, k, j // {scale}"
        standard = f"SELECT symbol, k, j, (x - avg(x) OVER (PARTITION BY symbol, k)) / nullif(stddev_pop(x) OVER (PARTITION BY symbol, k), 0) AS x, stddev_pop(x) OVER (PARTITION BY symbol, k) AS sd FROM ({coarse})"
        parts.append(f"z{scale} AS MATERIALIZED (SELECT symbol, k, j, x AS x0, {lead}, 0.2 AS near, {size} AS size FROM ({standard}) WHERE sd > {_EPS})")
        parts.append(_matched(f"b{scale}", f"z{scale}", 2, "size - 3"))
        parts.append(_matched(f"a{scale}", f"z{scale}", 3, "size - 3"))
        parts.append(f"s{scale} AS (SELECT symbol, k, -ln((an + {_EPS}) / (bn + {_EPS})) AS multiscale_entropy_{scale} FROM (SELECT symbol, k, sum(n - 1) AS bn FROM b{scale} GROUP BY symbol, k) b JOIN (SELECT symbol, k, sum(n - 1) AS an FROM a{scale} GROUP BY symbol, k) a USING (symbol, k))")
        joined.append(f"s{scale}")
    parts.append(f"y AS MATERIALIZED (SELECT symbol, k, j, x AS x0, {lead}, 0.2 * stddev_pop(x) OVER (PARTITION BY symbol, k) AS near, 100 AS size FROM w100)")
    parts += [_matched("p2", "y", 2, "98"), _matched("p3", "y", 3, "97")]
    parts.append("ap AS (SELECT symbol, k, f2 - f3 AS approximate_entropy FROM (SELECT symbol, k, avg(ln(n / 99e0)) AS f2 FROM p2 GROUP BY symbol, k) a JOIN (SELECT symbol, k, avg(ln(n / 98e0)) AS f3 FROM p3 GROUP BY symbol, k) b USING (symbol, k))")
    order = "(x0 <= x1)::INT || '' || (x0 <= x2)::INT || (x1 <= x2)::INT"
    parts.append(f"pe AS (SELECT symbol, k, -sum(n / 98e0 * ln(n / 98e0)) / ln(6e0) AS permutation_entropy FROM (SELECT symbol, k, {order} AS kind, count(*) AS n FROM y WHERE j <= 97 GROUP BY symbol, k, kind) q GROUP BY symbol, k)")
    bins = "SELECT symbol, k, least(9, floor((x - lo) / nullif(hi - lo, 0) * 10)) AS b, count(*) AS n FROM (SELECT *, min(x) OVER (PARTITION BY symbol, k) AS lo, max(x) OVER (PARTITION BY symbol, k) AS hi FROM w20) GROUP BY symbol, k, b"
    parts.append(f"we AS (SELECT symbol, k, -sum(n / 20e0 * ln(n / 20e0)) AS window_entropy FROM ({bins}) q GROUP BY symbol, k)")
    names = WINDOWS["window_entropies"]
    out = ", ".join(f"round({'multiscale_entropy_1' if n == 'sample_entropy' else n}, 4) + 0e0 AS {n}" for n in names)
    joins = " ".join(f"LEFT JOIN {t} USING (symbol, k)" for t in [*joined, "ap", "pe", "we"])
    return f"WITH {', '.join(parts)} SELECT symbol, ts, {out} FROM base {joins}"


def _scaling_sql() -> str:
    parts = [_rows_sql(), _win("w100", 100), _win("w20", 20), _win("w150", 150), _win("w200", 200), _win("w50", 50)]
    steps = "SELECT a.symbol, a.k, l.lag, stddev_pop(b.x - a.x) AS sd FROM w100 a JOIN (SELECT unnest(range(2, 20)) AS lag) l ON true JOIN w100 b ON b.symbol = a.symbol AND b.k = a.k AND b.j = a.j + l.lag GROUP BY a.symbol, a.k, l.lag"
    parts.append(f"hu AS (SELECT symbol, k, regr_slope(ln(greatest(sd, {_EPS})), ln(lag)) AS hurst_exponent FROM ({steps}) q GROUP BY symbol, k)")
    tau = " + ".join(f"{q} * ln(avg(power(abs(x), {q})) + {_EPS}) / ln(100e0)" for q in (1, 2, 3))
    parts.append(f"tau AS (SELECT symbol, k, ({tau}) / 3 AS scaling_function_tau FROM w100 GROUP BY symbol, k)")
    path = "SELECT symbol, k, j, sum(x) OVER (PARTITION BY symbol, k ORDER BY j) AS p FROM w20"
    pair = f"SELECT symbol, k, p AS a, lag(p, 5) OVER (PARTITION BY symbol, k ORDER BY j) AS b FROM ({path})"
    parts.append(f"ll AS (SELECT symbol, k, CASE WHEN stddev_pop(a) > {_EPS} AND stddev_pop(b) > {_EPS} THEN corr(a, b) END AS lead_lag_signature FROM ({pair}) WHERE b IS NOT NULL GROUP BY symbol, k)")
    parts.append("te AS (SELECT a.symbol, a.k, corr(a.x, b.x) AS transfer_entropy_5m_15m FROM w100 a JOIN w100 b ON b.symbol = a.symbol AND b.k = a.k AND b.j = a.j - 10 WHERE a.j BETWEEN 10 AND 94 GROUP BY a.symbol, a.k)")
    early = "SELECT symbol, k, x, row_number() OVER (PARTITION BY symbol, k ORDER BY x) - 1 AS i FROM w150 WHERE j < 100"
    late = "SELECT symbol, k, x, (row_number() OVER (PARTITION BY symbol, k ORDER BY x) - 1) * 99 / 49e0 AS at FROM w150 WHERE j >= 100"
    parts.append(f"er AS MATERIALIZED ({early})")
    parts.append(f"wa AS (SELECT l.symbol, l.k, avg(abs(l.x - (a.x + (l.at - floor(l.at)) * (coalesce(b.x, a.x) - a.x)))) AS wasserstein_distance FROM ({late}) l JOIN er a ON a.symbol = l.symbol AND a.k = l.k AND a.i = floor(l.at)::BIGINT LEFT JOIN er b ON b.symbol = l.symbol AND b.k = l.k AND b.i = floor(l.at)::BIGINT + 1 GROUP BY l.symbol, l.k)")
    cells = "SELECT symbol, k, b, sum((j >= 100)::INT) + 1e-8 AS p, sum((j < 100)::INT) + 1e-8 AS q FROM (SELECT symbol, k, j, least(9, floor((x - lo) / (hi - lo) * 10)) AS b FROM (SELECT *, min(x) OVER (PARTITION BY symbol, k) AS lo, max(x) OVER (PARTITION BY symbol, k) AS hi FROM w200)) GROUP BY symbol, k, b"
    total = "100 + 10 * 1e-8"
    parts.append(f"ig AS (SELECT symbol, k, sum(p / ({total}) * ln(p / q)) AS information_geometry_dist FROM ({cells}) c GROUP BY symbol, k)")
    parts.append("tri AS MATERIALIZED (SELECT symbol, k, j, x AS x0, lead(x, 1) OVER (PARTITION BY symbol, k ORDER BY j) AS x1, lead(x, 2) OVER (PARTITION BY symbol, k ORDER BY j) AS x2, stddev_pop(x) OVER (PARTITION BY symbol, k) AS sd FROM w50)")
    parts.append("re AS (SELECT a.symbol, a.k, avg((sqrt(power(a.x0 - b.x0, 2) + power(a.x1 - b.x1, 2) + power(a.x2 - b.x2, 2)) < 0.5 * a.sd)::INT) AS phase_space_recurrence FROM tri a JOIN tri b ON b.symbol = a.symbol AND b.k = a.k AND b.j > a.j AND b.j <= 47 GROUP BY a.symbol, a.k)")
    near = "SELECT a.symbol, a.k, arg_min(a.j, (abs(a.x - n.x), a.j)) AS i, min(abs(a.x - n.x)) AS d FROM w50 a JOIN w50 n ON n.symbol = a.symbol AND n.k = a.k AND n.j = 48 WHERE a.j < 48 GROUP BY a.symbol, a.k"
    parts.append(f"ly AS (SELECT q.symbol, q.k, ln((abs(z.x - y.x) + {_EPS}) / (d + {_EPS})) AS lyapunov_exponent FROM ({near}) q JOIN w50 y ON y.symbol = q.symbol AND y.k = q.k AND y.j = q.i + 1 JOIN w50 z ON z.symbol = q.symbol AND z.k = q.k AND z.j = 49)")
    joins = " ".join(f"LEFT JOIN {t} USING (symbol, k)" for t in ("hu", "tau", "ll", "te", "wa", "ig", "re", "ly"))
    return f"WITH {', '.join(parts)} SELECT symbol, ts, {', '.join(f'round({n}, 4) + 0e0 AS {n}' for n in WINDOWS['window_scaling'])} FROM base {joins}"


def _events_sql() -> str:
    parts = [_rows_sql(), _win("w100", 100), _win("w50", 50), _win("c100", 100, "c")]
    stats = "SELECT *, avg(x) OVER (PARTITION BY symbol, k) AS m, stddev_pop(x) OVER (PARTITION BY symbol, k) AS sd FROM "
    parts.append(f"ha AS (SELECT symbol, k, sum(CASE WHEN abs(x) > 0.5 * sd THEN 0.5 * exp(-0.5 * (99 - j)) ELSE 0 END) AS hawkes_intensity FROM ({stats} w100) GROUP BY symbol, k)")
    far = f"SELECT symbol, k, j, CASE WHEN abs(x - m) > 2 * sd THEN 1e0 ELSE 0e0 END AS e FROM ({stats} w100)"
    pair = f"SELECT symbol, k, e AS a, lag(e) OVER (PARTITION BY symbol, k ORDER BY j) AS b FROM ({far})"
    parts.append(f"cl AS (SELECT symbol, k, CASE WHEN stddev_pop(a) > {_EPS} AND stddev_pop(b) > {_EPS} THEN corr(a, b) ELSE 0e0 END AS extreme_event_clustering FROM ({pair}) WHERE b IS NOT NULL GROUP BY symbol, k)")
    parts.append("b0 AS (SELECT symbol, k, CASE WHEN count(*) FILTER (abs(x) > 0.01) > 1 THEN (max(j) FILTER (abs(x) > 0.01) - min(j) FILTER (abs(x) > 0.01)) / (count(*) FILTER (abs(x) > 0.01) - 1)::DOUBLE ELSE 0e0 END AS betti_0_mean_life FROM w50 GROUP BY symbol, k)")
    signs = f"SELECT symbol, k, sign(x) AS s, lag(sign(x)) OVER (PARTITION BY symbol, k ORDER BY j) AS before FROM ({stats} w50) WHERE abs(x) > 0.02 * sd"
    parts.append(f"b1 AS (SELECT symbol, k, sum(CASE WHEN s <> before THEN 1e0 ELSE 0e0 END) AS betti_1_count FROM ({signs}) GROUP BY symbol, k)")
    parts.append("du AS (SELECT symbol, k, 99e0 - arg_min(j, (-x, j)) AS drawdown_duration FROM c100 GROUP BY symbol, k)")
    parts.append("dd AS MATERIALIZED (SELECT symbol, k, j, x / max(x) OVER (PARTITION BY symbol, k ORDER BY j) - 1 AS dd FROM c100)")
    low = "SELECT symbol, k, arg_min(j, (dd, j)) AS lowest, min(dd) AS deep FROM dd GROUP BY symbol, k"
    parts.append(f"rc AS (SELECT symbol, k, CASE WHEN max(deep) < -0.05 AND count(*) > 2 THEN regr_slope(dd, j) END AS recovery_slope FROM dd JOIN ({low}) l USING (symbol, k) WHERE j >= lowest GROUP BY symbol, k)")
    wave = lambda f: f"atan2(-sum(x * sin(2 * pi() * {f} * j / 100)), sum(x * cos(2 * pi() * {f} * j / 100)))"
    parts.append(f"pd AS (SELECT symbol, k, {wave(5)} - {wave(6)} AS partial_directed_coherence FROM w100 GROUP BY symbol, k)")
    powers = f"SELECT symbol, k, i, -3 + 6e0 * i / 11 AS q, ln(avg(power(abs(x) + {_EPS}, -3 + 6e0 * i / 11))) / ln(100e0) AS tau FROM w100, (SELECT unnest(range(12)) AS i) GROUP BY symbol, k, i"
    slopes = f"SELECT symbol, k, (coalesce(lead(tau) OVER w, tau) - coalesce(lag(tau) OVER w, tau)) / (coalesce(lead(q) OVER w, q) - coalesce(lag(q) OVER w, q)) AS slope FROM ({powers}) WINDOW w AS (PARTITION BY symbol, k ORDER BY i)"
    parts.append(f"mf AS (SELECT symbol, k, max(slope) - min(slope) AS multifractal_spectrum_width FROM ({slopes}) GROUP BY symbol, k)")
    ends = "SELECT *, min(x) OVER (PARTITION BY symbol, k) AS lo, (max(x) OVER (PARTITION BY symbol, k) - min(x) OVER (PARTITION BY symbol, k)) / 10 AS width FROM w100"
    counted = f"SELECT symbol, k, width, least(9, floor((x - lo) / width)) AS b, count(*) AS n FROM ({ends}) WHERE width > 0 GROUP BY symbol, k, width, b"
    grid = f"SELECT g.symbol, g.k, g.width, i AS b, coalesce(n, 0) / (100 * g.width) AS p FROM (SELECT DISTINCT symbol, k, width FROM ({counted})) g CROSS JOIN (SELECT unnest(range(10)) AS i) LEFT JOIN ({counted}) c ON c.symbol = g.symbol AND c.k = g.k AND c.b = i"
    gradient = f"SELECT symbol, k, width, p, CASE WHEN width > {_EPS} THEN (coalesce(lead(p) OVER w, p) - coalesce(lag(p) OVER w, p)) / (width * CASE WHEN b IN (0, 9) THEN 1 ELSE 2 END) ELSE 0 END AS slope FROM ({grid}) WINDOW w AS (PARTITION BY symbol, k ORDER BY b)"
    parts.append(f"fi AS (SELECT symbol, k, sum(CASE WHEN p > {_EPS} THEN slope * slope / p ELSE 0 END) * max(width) AS fisher_information FROM ({gradient}) GROUP BY symbol, k)")
    joins = " ".join(f"LEFT JOIN {t} USING (symbol, k)" for t in ("ha", "cl", "b0", "b1", "du", "rc", "pd", "mf", "fi"))
    full = {"betti_1_count": "CASE WHEN hawkes_intensity IS NOT NULL OR betti_0_mean_life IS NOT NULL THEN coalesce(betti_1_count, 0e0) END"}
    return f"WITH {', '.join(parts)} SELECT symbol, ts, {', '.join(f'round({full.get(n, n)}, {_DIGITS.get(n, 4)}) + 0e0 AS {n}' for n in WINDOWS['window_events'])} FROM base {joins}"


for _name, _twin in (("window_entropies", _entropies_sql()), ("window_scaling", _scaling_sql()), ("window_events", _events_sql())):
    FRAMES[_name] = (_windowed(WINDOWS[_name]), _twin)


def _granger_window_sql(lag: int = 5, size: int = 100) -> str:
    """The lags are taken out of the window's returns one after the other."""
    own = [f"x{j}" for j in range(1, lag + 1)]
    over = "OVER (PARTITION BY symbol, k)"
    parts = [_rows_sql(), _win("w100", size)]
    parts.append(f"l AS MATERIALIZED (SELECT symbol, k, j, x AS y, {', '.join(f'lag(x, {j}) OVER (PARTITION BY symbol, k ORDER BY j) AS x{j}' for j in range(1, lag + 1))} FROM w100)")
    parts.append(f"q0 AS MATERIALIZED (SELECT symbol, k, {', '.join(f'{c} - avg({c}) {over} AS {c}' for c in ['y', *own])}, 0e0 AS total FROM l WHERE j >= {lag})")
    parts.append(f"t AS (SELECT symbol, k, sum(y * y) AS total FROM q0 GROUP BY symbol, k)")
    for i, c in enumerate(own):
        rest = ["y", *own[i + 1 :]]
        parts.append(f"q{i + 1} AS MATERIALIZED (SELECT symbol, k, {', '.join(f'{z} - sum({z} * {c}) {over} / nullif(sum({c} * {c}) {over}, 0) * {c} AS {z}' for z in rest)} FROM q{i})")
    free = size - 2 * lag - 1
    parts.append(f"f AS (SELECT symbol, k, CASE WHEN sum(y * y) > {_EPS} THEN (max(total) - sum(y * y)) / {lag} / (sum(y * y) / {free}) END AS granger_f_stat FROM q{lag} JOIN t USING (symbol, k) GROUP BY symbol, k)")
    return f"WITH {', '.join(parts)} SELECT symbol, ts, round(granger_f_stat, 4) + 0e0 AS granger_f_stat FROM base LEFT JOIN f USING (symbol, k)"


FRAMES["window_autoregression"] = (_windowed(["granger_f_stat"]), _granger_window_sql())


def _adaptive_sql() -> str:
    """Shift registers as lists that are carried from bar to bar."""
    turned = lambda x: f"(0.0962 * {x}[1] + 0.5769 * {x}[3] - 0.5769 * {x}[5] - 0.0962 * {x}[7])"  # noqa: E731  fixed taps
    w = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
    lags = lambda x, n: [f"coalesce(lag({x}, {j}) OVER w, 0)" if j else x for j in range(n)]
    p = lags("c", 4)
    first = f"SELECT symbol, ts, c, row_number() OVER w AS k, first_value(c) OVER w AS c0, CASE WHEN row_number() OVER w >= 7 THEN (4 * {p[0]} + 3 * {p[1]} + 2 * {p[2]} + {p[3]}) / 10 ELSE 0e0 END AS smooth FROM {bars(Duck())} b {w}"
    rows = f"rows_ AS MATERIALIZED (SELECT *, [{', '.join(lags('smooth', 7))}] AS sl FROM ({first}) f {w})"
    zeros = "[0e0, 0e0, 0e0, 0e0, 0e0, 0e0, 0e0]"
    start = f"SELECT symbol, CAST(6 AS BIGINT) AS k, {zeros} AS dl, {zeros} AS ql, {zeros} AS il, 0e0 AS i2, 0e0 AS q2, 0e0 AS re, 0e0 AS im, 0e0 AS period, 0e0 AS phase, c0 AS mama, c0 AS fama FROM rows_ WHERE k = 6"
    x = "SELECT r.symbol, r.k, r.c, r.sl, a.dl AS dl0, a.ql AS ql0, a.il AS il0, a.i2 AS i20, a.q2 AS q20, a.re AS re0, a.im AS im0, a.period AS period0, a.phase AS phase0, a.mama AS mama0, a.fama AS fama0, 0.075 * a.period + 0.54 AS scale FROM acc a JOIN rows_ r ON r.symbol = a.symbol AND r.k = a.k + 1"
    x = f"SELECT *, list_prepend({turned('sl')} * scale, dl0[1:6]) AS dl FROM ({x})"
    x = f"SELECT *, list_prepend({turned('dl')} * scale, ql0[1:6]) AS ql, list_prepend(dl[4], il0[1:6]) AS il FROM ({x})"
    x = f"SELECT *, 0.2 * (il[1] - {turned('ql')} * scale) + 0.8 * i20 AS i2, 0.2 * (ql[1] + {turned('il')} * scale) + 0.8 * q20 AS q2 FROM ({x})"
    x = f"SELECT *, 0.2 * (i2 * i20 + q2 * q20) + 0.8 * re0 AS re, 0.2 * (i2 * q20 - q2 * i20) + 0.8 * im0 AS im FROM ({x})"
    x = f"SELECT *, CASE WHEN im <> 0 AND re <> 0 THEN 2 * pi() / atan(im / re) ELSE period0 END AS p1, CASE WHEN il[1] <> 0 THEN degrees(atan(ql[1] / il[1])) ELSE phase0 END AS phase FROM ({x})"
    x = f"SELECT *, 0.2 * least(greatest(CASE WHEN period0 <> 0 THEN least(greatest(p1, 0.67 * period0), 1.5 * period0) ELSE p1 END, 6), 50) + 0.8 * period0 AS period, greatest(0.5 / greatest(phase0 - phase, 1), 0.05) AS alpha FROM ({x})"
    x = f"SELECT *, mama0 + alpha * (c - mama0) AS mama FROM ({x})"
    step = f"SELECT symbol, k, dl, ql, il, i2, q2, re, im, period, phase, mama, fama0 + 0.5 * alpha * (mama - fama0) FROM ({x})"
    return f"WITH RECURSIVE {rows}, acc AS ({start} UNION ALL {step}) SELECT r.symbol, r.ts, CASE WHEN r.k > 32 THEN round(a.mama, 4) + 0e0 END AS mama, CASE WHEN r.k > 32 THEN round(a.fama, 4) + 0e0 END AS fama FROM rows_ r LEFT JOIN acc a USING (symbol, k)"


FRAMES["indicators_adaptive"] = (_indicators(["mama", "fama"]), _adaptive_sql())


# ---- structure ---------------------------------------------------------------------------------------------------------------------


def smc_structure_sql(reach: int = 5) -> str:
    """The last swings and the trend carried from bar to bar; each kind of event picked from the bars that have it."""
    w = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
    frame = f"OVER (w ROWS {2 * reach} PRECEDING)"
    known = f"SELECT symbol, ts, o, h, l, c, row_number() OVER w AS k, lag(ts, {reach}) OVER w AS sts, lag(h, {reach}) OVER w AS sh, lag(l, {reach}) OVER w AS sl, max(h) {frame} AS top, min(l) {frame} AS low FROM {bars(Duck())} b {w}"
    last = lambda x, cond: f"last_value(CASE WHEN {cond} THEN {x} END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    marks = f"SELECT *, k > {2 * reach} AND sh = top AS is_high, k > {2 * reach} AND sh <> top AND sl = low AS is_low, {last('ts', 'c < o')} AS dts, {last('l', 'c < o')} AS dl, {last('k', 'c < o')} AS dk, {last('ts', 'c > o')} AS uts, {last('h', 'c > o')} AS uh, {last('k', 'c > o')} AS uk FROM ({known}) q {w}"
    rows = f"rows_ AS MATERIALIZED ({marks})"
    null = "CAST(NULL AS {})"
    start = f"SELECT symbol, CAST(0 AS BIGINT) AS k, {null.format('DOUBLE')} AS hi, {null.format('BIGINT')} AS hk, {null.format('DOUBLE')} AS lo, {null.format('BIGINT')} AS lk, 0 AS trend, 0 AS t0, 0 AS t1, {null.format('DOUBLE')} AS a, {null.format('BIGINT')} AS ak, {null.format('DOUBLE')} AS z, {null.format('BIGINT')} AS zk, false AS up, false AS over_, false AS down, false AS under FROM rows_ WHERE k = 1"
    x = f"SELECT r.symbol, r.k, r.h, r.l, r.c, CASE WHEN r.is_high THEN r.sh ELSE a.hi END AS a, CASE WHEN r.is_high THEN r.k - {reach} ELSE a.hk END AS ak, CASE WHEN r.is_low THEN r.sl ELSE a.lo END AS z, CASE WHEN r.is_low THEN r.k - {reach} ELSE a.lk END AS zk, a.trend AS t0 FROM acc a JOIN rows_ r ON r.symbol = a.symbol AND r.k = a.k + 1"
    x = f"SELECT *, coalesce(h > a AND c > a, false) AS up, coalesce(h > a AND c <= a, false) AS over_, coalesce(l < z AND c < z, false) AS down, coalesce(l < z AND c >= z, false) AS under FROM ({x})"
    x = f"SELECT *, CASE WHEN up THEN 1 ELSE t0 END AS t1 FROM ({x})"
    step = f"SELECT symbol, k, CASE WHEN NOT up THEN a END, CASE WHEN NOT up THEN ak END, CASE WHEN NOT down THEN z END, CASE WHEN NOT down THEN zk END, CASE WHEN down THEN -1 ELSE t1 END, t0, t1, a, ak, z, zk, up, over_, down, under FROM ({x})"
    found = "SELECT r.symbol, {0} AS ts, {1} AS event, {2} AS level, {3} AS bars_since_swing FROM rows_ r JOIN acc USING (symbol, k) WHERE {4}"
    events = [
        ("sts", "'swing_high'", "sh", "0", "is_high"), ("sts", "'swing_low'", "sl", "0", "is_low"), ("ts", "CASE WHEN t0 >= 0 THEN 'bos_up' ELSE 'choch_up' END", "a", "k - ak", "up"), ("dts", "'order_block_up'", "dl", "k - dk", "up AND dts IS NOT NULL"), ("ts", "'sweep_high'", "a", "k - ak", "over_"),
        ("ts", "CASE WHEN t1 <= 0 THEN 'bos_down' ELSE 'choch_down' END", "z", "k - zk", "down"), ("uts", "'order_block_down'", "uh", "k - uk", "down AND uts IS NOT NULL"), ("ts", "'sweep_low'", "z", "k - zk", "under"),
    ]
    return f"WITH RECURSIVE {rows}, acc AS ({start} UNION ALL {step}) SELECT symbol, ts, event, level, bars_since_swing::BIGINT AS bars_since_swing FROM ({' UNION ALL '.join(found.format(*e) for e in events)}) e"


FRAMES["smc_structure"] = (lambda run: swings.market_structure(run(_BARS)), smc_structure_sql())
