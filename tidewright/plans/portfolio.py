"""Queries over the daily returns and trades of a portfolio: ratios, risk, values, series for charts, regime analyses.

Windows without a key run over days, of which there are few whatever the number of trades.
"""

from __future__ import annotations

from tidewright.plans.dialect import Dialect, corr
from tidewright.plans.research import normal_cdf
from tidewright.plans.series import asof, daily, ledger, r6, running, series

#: Days a year; the 5 % point of the normal law.
ANN, Z05 = 365, -1.6448536269514722


def _market(d: Dialect) -> str:
    return f"(SELECT ts AS day, c / lag(c) OVER (ORDER BY ts) - 1 AS m FROM {daily()} b)"


def _days(d: Dialect) -> str:
    """Portfolio returns by day of exit (1 % of a trade's return each, compounded), wealth, its peak, the market's return."""
    own = f"SELECT exit_datetime AS day, exp(sum(ln(1 + trade_return_pct / 10000))) - 1 AS r FROM {ledger()} t GROUP BY exit_datetime"
    wealth = f"SELECT day, r, row_number() OVER (ORDER BY day) AS k, exp(sum(ln(1 + r)) OVER (ORDER BY day)) AS w FROM ({own}) o"
    top = f"SELECT *, max(w) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM ({wealth}) w"
    return f"(SELECT q.day, q.k, q.r, q.w, q.top, m.m FROM ({top}) q LEFT JOIN {_market(d)} m ON m.day = q.day)"


@series
def portfolio_ratios(d):
    """Risk-adjusted ratios of daily returns, without a risk-free rate."""
    years = f"(count(*) / {ANN}e0)"
    cagr = f"(exp(sum(ln(1 + r)) / {years}) - 1)"
    ulcer = f"(sqrt(avg(power((w - top) / top, 2))) * sqrt({ANN}e0))"
    sharpe = f"(avg(r) / stddev_samp(r) * sqrt({ANN}e0))"
    n = "CAST(count(*) AS DOUBLE)"
    # Student's t with many degrees of freedom by the normal law.
    t = f"({sharpe} / sqrt((1 + {sharpe} * {sharpe} / 2) / ({n} - 1)))"
    z = f"({t} * (1 - 1 / (4 * ({n} - 1))) / sqrt(1 + {t} * {t} / (2 * ({n} - 1))))"
    own, bench = "CASE WHEN m IS NOT NULL THEN r END", "m"
    beta = f"(covar_samp({own}, {bench}) / nullif(var_samp({bench}), 0))"
    both = f"(count(m) / {ANN}e0)"
    cagr_own, cagr_bench = f"(exp(sum(CASE WHEN m IS NOT NULL THEN ln(1 + r) END) / {both}) - 1)", f"(exp(sum(ln(1 + m)) / {both}) - 1)"
    up, down = "avg(CASE WHEN m > 0 THEN r END) / nullif(avg(CASE WHEN m > 0 THEN m END), 0)", "avg(CASE WHEN m < 0 THEN r END) / nullif(avg(CASE WHEN m < 0 THEN m END), 0)"
    columns = {
        "sharpe": sharpe, "sortino": f"avg(r) * {ANN} / nullif(sqrt(avg(CASE WHEN r <= 0 THEN r * r ELSE 0e0 END)) * sqrt({ANN}e0), 0)", "calmar": f"{cagr} / abs(nullif(min((w - top) / top), 0))",
        "omega": "sum(CASE WHEN r > 0 THEN r ELSE 0 END) / nullif(sum(CASE WHEN r <= 0 THEN -r ELSE 0 END), 0)", "cagr": cagr, "expected_return": "exp(avg(ln(1 + r))) - 1",
        "adjusted_sortino": f"avg(r) * {ANN} / (sqrt(avg(CASE WHEN r < 0 THEN r * r END)) * sqrt({ANN}e0))", "serenity": f"{cagr} / nullif({ulcer}, 0)", "kelly": "greatest(-1e0, least(1e0, avg(r) / nullif(var_samp(r), 0)))",
        "beta": beta, "alpha": f"{cagr_own} - {beta} * {cagr_bench}", "treynor": f"{cagr_own} / nullif({beta}, 0)", "information": f"avg({own} - m) / nullif(stddev_samp({own} - m), 0)", "up_capture": up, "down_capture": down, "capture": f"({up}) / nullif(abs({down}), 0)",
    }
    inner = ", ".join(f"round({v}, 5) AS {k}" for k, v in columns.items())
    return f"SELECT {', '.join(columns)}, round({normal_cdf('z')}, 4) AS probabilistic_sharpe FROM (SELECT {inner}, {z} AS z FROM {_days(d)} q) a"


@series
def portfolio_risk(d):
    """Volatility, value at risk, tails, bias-corrected moments, ulcer index, risk of ruin, rolling volatility."""
    vol = f"CASE WHEN k >= 30 THEN stddev_samp(r) OVER (ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) * sqrt({ANN}e0) END"
    base = f"SELECT *, {vol} AS vol30 FROM {_days(d)} q"
    cut = f"SELECT avg(r) + ({Z05}) * stddev_samp(r) AS cut, avg(r) AS mean, stddev_samp(r) AS sd FROM {_days(d)} q"
    rows = f"SELECT b.*, c.cut, c.mean, c.sd FROM ({base}) b CROSS JOIN ({cut}) c"
    n, m2 = "CAST(count(*) AS DOUBLE)", "avg(power(r - mean, 2))"
    skew = f"(avg(power(r - mean, 3)) / power({m2}, 1.5) * sqrt({n} * ({n} - 1)) / ({n} - 2))"
    kurt = f"((({n} + 1) * (avg(power(r - mean, 4)) / ({m2} * {m2}) - 3) + 6) * ({n} - 1) / (({n} - 2) * ({n} - 3)))"
    tail = f"(abs({d.quantile('r', 0.95)}) / nullif(abs({d.quantile('r', 0.05)}), 0))"
    pf = "(sum(CASE WHEN r > 0 THEN r ELSE 0 END) / nullif(sum(CASE WHEN r < 0 THEN -r ELSE 0 END), 0))"
    ruin = normal_cdf("((-1e0 - mean) / sd)")
    return (
        f"SELECT tail_ratio, common_sense, skewness, kurtosis, sharpe_error, volatility, var_95, cvar_95, ulcer_index, mean_nonzero, geometric_mean, rolling_vol_mean, rolling_vol_sd, round({ruin}, 6) AS risk_of_ruin FROM (SELECT {r6(tail)} AS tail_ratio, {r6(f'{tail} * {pf}')} AS common_sense, round({skew}, 4) AS skewness, round({kurt}, 4) AS kurtosis, "
        f"{r6(f'sqrt((1 + power(avg(r) / stddev_samp(r), 2) / 2) / {n})')} AS sharpe_error, {r6(f'stddev_samp(r) * sqrt({ANN}e0)')} AS volatility, {r6('max(cut)')} AS var_95, {r6('avg(CASE WHEN r <= cut THEN r END)')} AS cvar_95, "
        f"{r6(f'sqrt(avg(power((w - top) / top, 2))) * sqrt({ANN}e0)')} AS ulcer_index, round(avg(CASE WHEN r <> 0 THEN r END), 8) AS mean_nonzero, round(exp(avg(ln(1 + r))) - 1, 8) AS geometric_mean, "
        f"{r6('avg(vol30)')} AS rolling_vol_mean, {r6('stddev_samp(vol30)')} AS rolling_vol_sd, max(mean) AS mean, max(sd) AS sd FROM ({rows}) z) a"
    )


@series
def portfolio_values(d):
    """Statistics of the portfolio's value (10,000 at the beginning) and of its daily returns."""
    v = f"SELECT *, 10000 * w AS v, 10000 * greatest(1e0, top) AS peak FROM {_days(d)} q"
    last = f"{d.last_by('v', 'day')}"
    market = f"(exp(sum(ln(1 + m))) - 1)"
    return (
        f"SELECT count(*) AS periods, round({last}, 4) AS final_value, round(min(v), 4) AS min_value, round(max(v), 4) AS max_value, round(avg(v), 4) AS mean_value, round({d.quantile('v', 0.5)}, 4) AS median_value, round(stddev_samp(v), 4) AS sd_value, "
        f"round({d.quantile('v', 0.25)}, 4) AS p25, round({d.quantile('v', 0.75)}, 4) AS p75, {r6('stddev_pop(v) / avg(v)')} AS variation, round(max(peak - v), 4) AS max_drawdown_money, {r6(f'{last} / 10000 - 1')} AS total_return, round(avg(r), 8) AS mean_return, round(stddev_samp(r), 8) AS sd_return, "
        f"round(max(r), 8) AS best, round(min(r), 8) AS worst, sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS positive, sum(CASE WHEN r < 0 THEN 1 ELSE 0 END) AS negative, sum(CASE WHEN r = 0 THEN 1 ELSE 0 END) AS flat, {r6(f'({last} / 10000) / (1 + {market})')} AS outperformance_ratio FROM ({v}) z"
    )


@series
def portfolio_time_series(d, window: int = 30):
    """Rolling return, volatility, Sharpe ratio and drawdown over windows of days, their consistency; lag-1 correlation; trend of the value."""
    frame = f"OVER (ORDER BY day ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    values = f"{'collect_list' if d.name == 'spark' else 'list'}(w) {frame}"
    rows = f"SELECT day, k, r, w, lag(r) OVER (ORDER BY day) AS before, avg(r) {frame} AS mean, stddev_samp(r) {frame} AS sd, {values} AS ws FROM {_days(d)} q"
    if d.name == "spark":
        # NaN is the largest: a window of infinite values alone has no fall, which isn't a fall of 0.
        fall = "aggregate(ws, named_struct('top', 0D, 'low', double('NaN')), (a_, x_) -> named_struct('top', greatest(a_.top, x_), 'low', least(a_.low, x_ / greatest(a_.top, x_) - 1))).low"
    else:
        fall = "list_min(list_transform(range(1, len(ws) + 1), lambda i: ws[i] / list_max(ws[1:i]) - 1))"
    full = f"SELECT *, CASE WHEN k >= {window} THEN mean * {ANN} END AS rr, CASE WHEN k >= {window} THEN sd * sqrt({ANN}e0) END AS rv, CASE WHEN k >= {window} THEN mean / nullif(sd, 0) * sqrt({ANN}e0) END AS rs, CASE WHEN k >= {window} THEN {fall} END AS rd FROM ({rows}) z"
    both = "CASE WHEN before IS NOT NULL THEN r END"
    return (
        f"SELECT {r6('avg(rr)')} AS return_mean, {r6('stddev_samp(rr)')} AS return_sd, {r6('avg(rv)')} AS vol_mean, {r6('stddev_samp(rv)')} AS vol_sd, round(avg(rs), 4) AS sharpe_mean, round(stddev_samp(rs), 4) AS sharpe_sd, {r6('avg(rd)')} AS drawdown_mean, {r6('stddev_samp(rd)')} AS drawdown_sd, "
        f"{r6('stddev_samp(rv) / avg(rv)')} AS vol_of_vol, round(1 - stddev_samp(rs) / abs(avg(rs)), 4) AS sharpe_consistency, round(1 - stddev_samp(rr) / abs(avg(rr)), 4) AS return_consistency, {r6(f'covar_pop({both}, before) / (stddev_pop({both}) * stddev_pop(before))')} AS lag1, "
        f"{r6(f'covar_pop(k, w) / var_pop(k) / {d.first_by('w', 'day')} * count(*)')} AS trend, sum(CASE WHEN rr IS NOT NULL THEN 1 ELSE 0 END) AS windows FROM ({full}) y"
    )


@series
def portfolio_ann_factor(d):
    """Trading days a year: rows by the share of calendar years that the series covers."""
    ends = f"SELECT count(*) AS n, min(day) AS a, max(day) AS b, max(year(day)) + 1 AS last FROM {_days(d)} q"
    first, final = ("make_date(year(a) + 1, 1, 1)", "make_date(last, 1, 1)")
    gap = lambda x, y: f"datediff({y}, {x})" if d.name == "spark" else f"date_diff('day', CAST({x} AS DATE), CAST({y} AS DATE))"
    shift = gap("a", first)
    last_moved = f"date_add(CAST(b AS DATE), CAST({shift} AS INT))" if d.name == "spark" else f"CAST(CAST(b AS DATE) + CAST({shift} AS INTEGER) AS DATE)"
    moved = f"SELECT n, {first} AS f, {last_moved} AS l FROM ({ends}) e"
    ratio = f"SELECT n, CAST({gap('f', 'l')} AS DOUBLE) / {gap('f', 'make_date(year(l) + 1, 1, 1)')} AS ratio, year(l) + 1 - year(f) AS years FROM ({moved}) m"
    return f"SELECT n, round(CASE WHEN ratio = 0 OR n <= 1 THEN {ANN}e0 ELSE n / ratio / years END, 4) AS ann_factor FROM ({ratio}) r"


# ---- series for charts -------------------------------------------------------------------------------------------------------


@series
def chart_cumulative_returns(d):
    return f"SELECT day, {r6('w - 1')} AS cumulative, {r6('(w - top) / top')} AS underwater FROM {_days(d)} q"


@series
def chart_benchmark_returns(d):
    return f"SELECT day, {r6('exp(sum(ln(1 + m)) OVER (ORDER BY day)) - 1')} AS cumulative FROM {_market(d)} q WHERE m IS NOT NULL"


@series
def chart_mfe_mae(d):
    return f"SELECT id, exit_datetime, greatest(trade_return_pct, 0e0) AS mfe, least(trade_return_pct, 0e0) AS mae FROM {ledger()} t"


@series
def chart_directional_pnl(d):
    """Running sum of the trades of each direction."""
    sides = f"(SELECT id, exit_datetime, direction, CASE WHEN direction = 'Long' THEN trade_return_pct ELSE 0e0 END AS lg, CASE WHEN direction = 'Short' THEN trade_return_pct ELSE 0e0 END AS sh FROM {ledger()} t)"
    both = running(d, running(d, sides, "lg", "run_long"), "sh", "run_short")
    return f"SELECT id, exit_datetime, direction, {r6("CASE WHEN direction = 'Long' THEN run_long ELSE run_short END")} AS cumulative FROM {both} q"


@series
def chart_rolling_sharpe(d, window: int = 30):
    """Sharpe and Sortino ratio over the last 30 days, over all days before there are as many."""
    frame = f"OVER (ORDER BY day ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    sd, down = f"stddev_samp(r) {frame}", f"sqrt(avg(CASE WHEN r < 0 THEN r * r ELSE 0e0 END) {frame})"
    ratio = lambda x: f"CASE WHEN {x} > 1e-12 THEN avg(r) {frame} / {x} * sqrt({ANN}e0) ELSE 0e0 END"
    return f"SELECT day, round({ratio(sd)}, 4) AS sharpe, round({ratio(down)}, 4) AS sortino FROM {_days(d)} q"


@series
def chart_rolling_correlation(d, window: int = 3):
    """Correlation of the last three days' returns with the market's; days on which both are known."""
    frame = f" OVER (ORDER BY day ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    return f"SELECT day, round(coalesce({corr('r', 'm', over=frame)}, 0e0), 4) AS correlation FROM (SELECT * FROM {_days(d)} q WHERE m IS NOT NULL) z"


@series
def chart_pnl_density(d, points: int = 100):
    """Gaussian kernel density of trade returns (Scott's bandwidth) at evenly spaced points; equal returns are counted once."""
    x = f"SELECT trade_return_pct AS x, count(*) AS k FROM {ledger()} t GROUP BY trade_return_pct"
    stats = f"SELECT min(trade_return_pct) AS lo, max(trade_return_pct) AS hi, count(*) AS n, stddev_samp(trade_return_pct) * power(count(*), -0.2) AS h FROM {ledger()} t"
    grid = f"SELECT i, lo + (hi - lo) * i / {points - 1}e0 AS place, n, h FROM ({stats}) s CROSS JOIN (SELECT {'explode(sequence(0, ' + str(points - 1) + '))' if d.name == 'spark' else f'unnest(range({points}))'} AS i) g"
    return f"SELECT CAST(i AS INT) AS point, {r6('place')} AS ret, {r6('sum(k * exp(-power((place - x) / h, 2) / 2)) / max(n * h * sqrt(2 * pi()))')} AS density FROM ({grid}) g CROSS JOIN ({x}) x GROUP BY i, place"


# ---- regimes of trades -------------------------------------------------------------------------------------------------------


def _enriched(d: Dialect) -> str:
    """Trades with what was known of the market at entry and at exit: up and down volatility, persistence, pressure of change, trend."""
    r = f"SELECT symbol, ts, c, ln(c) - ln({d.lag('c')}) AS r, row_number() OVER ({d.over}) AS rn FROM {daily()} b"
    up, down = d.w("stddev_pop", "CASE WHEN r > 0 THEN r END", -19, 0), d.w("stddev_pop", "CASE WHEN r < 0 THEN r END", -19, 0)
    state = (
        f"SELECT symbol, CAST(ts AS TIMESTAMP) AS ts, {up} AS up_vol, {down} AS down_vol, abs({d.w('sum', 'r', -19, 0)}) / nullif({d.w('sum', 'abs(r)', -19, 0)}, 0) AS persistence, "
        f"{d.w('stddev_pop', 'r', -4, 0)} / nullif({d.w('stddev_pop', 'r', -19, 0)}, 0) AS pressure, CASE WHEN {d.w('avg', 'c', -4, 0)} > {d.w('avg', 'c', -19, 0)} THEN 1e0 ELSE 0e0 END AS trend FROM ({r}) q WHERE rn > 1"
    )
    out = f"SELECT id, entry_datetime, exit_datetime, trade_return_pct AS ret, direction, CASE WHEN trade_return_pct < -5 THEN 'SL - Static' WHEN trade_return_pct > 5 THEN 'TP - Static' ELSE 'Signal' END AS action FROM {ledger()} t"
    marks = lambda x: f"(SELECT 'orders' AS symbol, CAST({x} AS TIMESTAMP) AS ts, id FROM {ledger()} t)"
    # One as-of join an end: the state's place in time leads to its columns.
    times = f"(SELECT symbol, ts, 0e0 AS v FROM ({state}) z)"
    ends = {a: f"SELECT j.id, z.* FROM {asof(d, marks(c), times)} j JOIN ({state}) z ON z.ts = j.bar_ts" for a, c in (("e", "entry_datetime"), ("x", "exit_datetime"))}
    return f"(SELECT o.*, e.up_vol, e.down_vol, e.persistence, e.pressure AS entry_pressure, x.pressure AS exit_pressure, e.trend AS entry_trend, x.trend AS exit_trend FROM ({out}) o JOIN ({ends['e']}) e ON e.id = o.id JOIN ({ends['x']}) x ON x.id = o.id)"


_GAIN, _LOSS = "sum(CASE WHEN ret > 0 THEN ret ELSE 0 END)", "sum(CASE WHEN ret < 0 THEN -ret ELSE 0 END)"
_STATS = f"count(*) AS n, round(avg(ret), 4) AS mean, round(avg(CASE WHEN ret > 0 THEN 100e0 ELSE 0e0 END), 4) AS win_rate, round(CASE WHEN {_LOSS} > 0 THEN {_GAIN} / {_LOSS} ELSE 0e0 END, 4) AS profit_factor"


def _quartiled(d: Dialect, x: str) -> str:
    """Enriched trades with the quartile of ``x`` (a value on an edge belongs to the lower one)."""
    edges = f"SELECT {', '.join(f'{d.quantile(x, p)} AS q{k}' for k, p in ((1, 0.25), (2, 0.5), (3, 0.75)))} FROM {_enriched(d)} t"
    return f"(SELECT t.*, CASE WHEN {x} <= q1 THEN 1 WHEN {x} <= q2 THEN 2 WHEN {x} <= q3 THEN 3 ELSE 4 END AS quartile FROM {_enriched(d)} t CROSS JOIN ({edges}) e WHERE {x} IS NOT NULL)"


@series
def regime_transition_pressure(d):
    rates = "round(avg(CASE WHEN action LIKE 'SL%' THEN 100e0 ELSE 0e0 END), 4) AS stop_rate, round(avg(CASE WHEN action LIKE 'TP%' THEN 100e0 ELSE 0e0 END), 4) AS target_rate"
    return f"SELECT quartile, {_STATS}, {rates} FROM {_quartiled(d, 'entry_pressure')} q GROUP BY quartile"


@series
def regime_exit_pressure(d):
    return f"SELECT action, count(*) AS n, round(avg(exit_pressure), 4) AS exit_pressure FROM {_enriched(d)} t WHERE exit_pressure IS NOT NULL GROUP BY action"


@series
def regime_change_pressure(d):
    return f"SELECT count(*) AS n, round(avg(entry_pressure), 4) AS entry_pressure, round(avg(exit_pressure), 4) AS exit_pressure, round(avg(ret), 4) AS mean, round(avg(CASE WHEN ret > 0 THEN 100e0 ELSE 0e0 END), 4) AS win_rate FROM {_enriched(d)} t WHERE entry_trend <> exit_trend"


@series
def regime_volatility_skew(d):
    skew = f"SELECT *, up_vol / nullif(down_vol, 0) AS skew FROM {_enriched(d)} t"
    kind = "CASE WHEN skew <= 0.999 THEN 'downside_dominant' WHEN skew <= 1.001 THEN 'symmetric' ELSE 'upside_dominant' END"
    return f"SELECT direction, kind, {_STATS} FROM (SELECT *, {kind} AS kind FROM ({skew}) s WHERE skew IS NOT NULL) q GROUP BY direction, kind"


@series
def regime_volatility_quartiles(d):
    parts = " UNION ALL ".join(f"SELECT '{x}' AS side, quartile, ret FROM {_quartiled(d, x)} q" for x in ("up_vol", "down_vol"))
    return f"SELECT side, quartile, {_STATS} FROM ({parts}) u GROUP BY side, quartile"


@series
def regime_adverse_volatility(d):
    """Short trades by upward, long ones by downward volatility, split at its 75 % point."""
    own = f"SELECT *, CASE WHEN direction = 'Short' THEN up_vol ELSE down_vol END AS adverse FROM {_enriched(d)} t"
    edge = f"SELECT direction AS side, {d.quantile('adverse', 0.75)} AS edge FROM ({own}) o GROUP BY direction"
    return f"SELECT direction, CASE WHEN adverse >= edge THEN 'high' ELSE 'low' END AS level, {_STATS} FROM ({own}) o JOIN ({edge}) e ON e.side = o.direction WHERE adverse IS NOT NULL GROUP BY direction, CASE WHEN adverse >= edge THEN 'high' ELSE 'low' END"


@series
def regime_directional_persistence(d):
    return f"SELECT coalesce(direction, 'all') AS direction, quartile, {_STATS} FROM {_quartiled(d, 'persistence')} q GROUP BY GROUPING SETS ((direction, quartile), (quartile))"


@series
def regime_latest_rolling(d, window: int = 20, least: int = 10):
    """Per regime, mean and win rate of its last 20 trades, and what they say."""
    order = "PARTITION BY regime ORDER BY entry_datetime DESC, id DESC"
    rows = f"SELECT regime, entry_datetime, trade_return_pct AS ret FROM (SELECT *, row_number() OVER ({order}) AS k FROM {ledger()} t) q WHERE k <= {window}"
    stats = f"SELECT regime, max(entry_datetime) AS last_datetime, avg(ret) AS mean, avg(CASE WHEN ret > 0 THEN 100e0 ELSE 0e0 END) AS win, count(*) AS n FROM ({rows}) r GROUP BY regime HAVING count(*) >= {least}"
    return f"SELECT regime, last_datetime, round(mean, 4) AS mean, round(win, 4) AS win_rate, n, CASE WHEN mean < 0 AND win < 40 THEN 'critical' WHEN mean < 0 THEN 'deteriorating' WHEN win < 40 THEN 'poor_win_rate' ELSE 'healthy' END AS status FROM ({stats}) s"
