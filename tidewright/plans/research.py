"""Queries of the modelling workflow: events and labels, sample weights, cross-validation, feature quality.

Where the two engines' texts differ, the twin is written the plain way (range joins, global ranks) and checks the
scalable one (bounded frames, ranks in two levels).
"""

from __future__ import annotations

import math

from tidewright.plans.dialect import Dialect, corr
from tidewright.plans.series import _closed, _concurrency, _signals, asof, bars, daily, ledger, r6, series, step, ticks

# ---- events, barriers, labels ------------------------------------------------------------------------------------------------

#: Profit and stop multiples of the target, bars of volatility, hours to the vertical barrier.
PT, SL, VOL, HOURS = 1.0, 1.0, 20, 24


def _targets(d: Dialect) -> str:
    """Bars with their target: deviation of the last log returns; null until there are enough."""
    r = f"SELECT symbol, ts, c, ln(c) - ln({d.lag('c')}) AS lr, row_number() OVER ({d.over}) AS rn FROM {bars(d)} b"
    return f"(SELECT symbol, CAST(ts AS TIMESTAMP) AS ts, c, CASE WHEN rn > {VOL} THEN {d.w('stddev_pop', 'lr', -VOL + 1, 0)} END AS trgt FROM ({r}) q)"


def _events(d: Dialect, side: str = "1") -> str:
    """Every bar with a target as an event: vertical barrier (first bar a day ahead or later), first touch of a barrier.

    Hourly bars: the vertical barrier is at most ``HOURS`` bars ahead, so a bounded frame holds all that an event can touch.
    """
    pt, sl = f"({{p}} / c - 1) * ({side}) >= {PT} * trgt", f"({{p}} / c - 1) * ({side}) <= -{SL} * trgt"
    if d.name == "duckdb":
        base = f"SELECT *, {side} AS side FROM {_targets(d)} t WHERE trgt IS NOT NULL" if side == "1" else f"SELECT t.*, s.side FROM {_targets(d)} t JOIN ({_sides(d)}) s ON s.symbol = t.symbol AND CAST(s.ts AS TIMESTAMP) = t.ts WHERE trgt IS NOT NULL AND s.side <> 0"
        upright = f"SELECT e.*, (SELECT min(CAST(b.ts AS TIMESTAMP)) FROM {bars(d)} b WHERE b.symbol = e.symbol AND CAST(b.ts AS TIMESTAMP) >= e.ts + INTERVAL {HOURS} HOUR) AS t1 FROM ({base}) e"
        hits = f"SELECT e.symbol, e.ts, e.c, e.trgt, e.side, e.t1, min(CASE WHEN {pt.format(p='b.c').replace(f'({side})', 'e.side').replace('/ c', '/ e.c').replace('trgt', 'e.trgt')} OR {sl.format(p='b.c').replace(f'({side})', 'e.side').replace('/ c', '/ e.c').replace('trgt', 'e.trgt')} THEN CAST(b.ts AS TIMESTAMP) END) AS hit FROM ({upright}) e JOIN {bars(d)} b ON b.symbol = e.symbol AND CAST(b.ts AS TIMESTAMP) >= e.ts AND (e.t1 IS NULL OR CAST(b.ts AS TIMESTAMP) <= e.t1) GROUP BY ALL"
        return f"(SELECT symbol, ts, c, trgt, side, t1, least(coalesce(hit, t1), coalesce(t1, hit)) AS touch FROM ({hits}) h)"
    rows = f"SELECT t.symbol, t.ts, t.c, t.trgt, {'1' if side == '1' else 's.side'} AS side FROM {_targets(d)} t" + ("" if side == "1" else f" JOIN ({_sides(d)}) s ON s.symbol = t.symbol AND CAST(s.ts AS TIMESTAMP) = t.ts")
    # Later bars lie in a bounded frame unless the series has no bar a day ahead: then the frame is its whole rest, shorter than a day.
    ahead = f"SELECT *, collect_list(struct(ts AS at, c AS p)) OVER ({d.over} ROWS BETWEEN CURRENT ROW AND {HOURS + 1} FOLLOWING) AS ahead FROM ({rows}) r"
    upright = f"SELECT *, array_min(transform(filter(ahead, x -> x.at >= ts + INTERVAL {HOURS} HOUR), x -> x.at)) AS t1 FROM ({ahead}) a"
    part = "filter(ahead, x -> t1 IS NULL OR x.at <= t1)"
    touched = f"filter({part}, x -> {pt.format(p='x.p').replace(side, 'side')} OR {sl.format(p='x.p').replace(side, 'side')})" if side != "1" else f"filter({part}, x -> {pt.format(p='x.p')} OR {sl.format(p='x.p')})"
    hits = f"SELECT *, array_min(transform({touched}, x -> x.at)) AS hit FROM ({upright}) u WHERE trgt IS NOT NULL" + ("" if side == "1" else " AND side <> 0")
    return f"(SELECT symbol, ts, c, trgt, side, t1, least(hit, t1) AS touch FROM ({hits}) h)"


def _sides(d: Dialect) -> str:
    """A first model's side: that of the majority of the signals."""
    return f"SELECT symbol, ts, CAST(sign(coalesce(momentum_signals, 0) + trend_signals + body_signals) AS INT) AS side FROM {_signals(d)} s"


def _bins(d: Dialect, side: str = "1") -> str:
    """Label of each event whose end is known: sign of the log return until the touch (with a side: whether it paid)."""
    label = "CAST(sign(ret) AS INT)" if side == "1" else "CASE WHEN ret > 0 THEN 1 ELSE 0 END"
    ends = f"SELECT e.symbol, e.ts, e.trgt, e.side, e.touch, ln(b.c / e.c) * e.side AS ret FROM {_events(d, side)} e JOIN (SELECT symbol, CAST(ts AS TIMESTAMP) AS ts, c FROM {bars(d)} x) b ON b.symbol = e.symbol AND b.ts = e.touch"
    return f"(SELECT *, {label} AS bin FROM ({ends}) z)"


@series
def events_first_touch(d):
    return f"SELECT symbol, ts, {r6('trgt')} AS trgt, t1, touch FROM {_events(d)} e"


@series
def events_bins(d):
    return f"SELECT symbol, ts, {r6('ret')} AS ret, bin, {r6('trgt')} AS trgt FROM {_bins(d)} b"


@series
def events_meta_labels(d):
    return f"SELECT symbol, ts, side, {r6('ret')} AS ret, bin FROM {_bins(d, 'side')} b"


@series
def events_drop_rare(d, share: float = 0.05):
    """Events without the rarest of three labels, if its share is not above the limit; with two labels left nothing more goes."""
    counts = f"SELECT bin, count(*) AS n FROM {_bins(d)} b GROUP BY bin"
    ranked = f"SELECT bin, n, sum(n) OVER (PARTITION BY 1) AS total, count(*) OVER (PARTITION BY 1) AS kinds, row_number() OVER (ORDER BY n, bin) AS k FROM ({counts}) c"
    rare = f"SELECT bin AS gone FROM ({ranked}) r WHERE k = 1 AND kinds >= 3 AND n <= {share} * total"
    return f"SELECT b.symbol, b.ts, b.bin FROM {_bins(d)} b LEFT JOIN ({rare}) r ON b.bin = r.gone WHERE r.gone IS NULL"


@series
def signals_fractional_kelly(d, threshold: float = 0.55, fraction: float = 0.25, most: float = 0.20):
    """Predictions to signals: the predicted class if its probability reaches the threshold; bet a fraction of Kelly, capped."""
    p = f"SELECT symbol, ts, 0.9 * (c - l) / nullif(h - l, 0) AS p1, 0.9 * (h - c) / nullif(h - l, 0) AS m1 FROM {bars(d)} b"
    y = f"SELECT *, greatest(1 - p1 - m1, 0e0) AS p0, CASE WHEN p1 >= m1 AND p1 >= 1 - p1 - m1 THEN 1 WHEN m1 >= 1 - p1 - m1 THEN -1 ELSE 0 END AS y_pred FROM ({p}) p WHERE p1 IS NOT NULL"
    conf = f"SELECT *, CASE y_pred WHEN 1 THEN p1 WHEN -1 THEN m1 ELSE p0 END AS confidence FROM ({y}) y"
    bet = f"least({fraction} * greatest(confidence - {threshold}, 0e0) / {1 - threshold + 1e-9!r}, {most})"
    return f"SELECT symbol, ts, CASE WHEN confidence >= {threshold} THEN y_pred ELSE 0 END AS signal, {r6(f'CASE WHEN confidence >= {threshold} AND y_pred <> 0 THEN {bet} ELSE 0 END')} AS bet_size, {r6('confidence')} AS confidence FROM ({conf}) q"


# ---- sample weights ----------------------------------------------------------------------------------------------------------


@step
def _ranked(d: Dialect) -> str:
    """Trades with their place ``k`` (from 0) in order of entry, and the number of all. Places are counted per day, then within it."""
    if d.name == "duckdb":
        return f"(SELECT id, entry_datetime, exit_datetime, trade_return_pct, row_number() OVER (ORDER BY entry_datetime, id) - 1 AS k, count(*) OVER () AS n FROM {ledger()} t)"
    days = f"SELECT entry_datetime AS day, count(*) AS m FROM {_closed(d)} t GROUP BY entry_datetime"
    before = f"SELECT day, sum(m) OVER (ORDER BY day) - m AS before, sum(m) OVER () AS n FROM ({days}) x"
    return f"(SELECT /*+ BROADCAST(b) */ t.id, t.entry_datetime, t.exit_datetime, t.trade_return_pct, t.direction, t.regime, b.before + row_number() OVER (PARTITION BY t.entry_datetime ORDER BY t.id) - 1 AS k, b.n FROM {_closed(d)} t JOIN ({before}) b ON b.day = t.entry_datetime)"


@step
def _raw_weights(d: Dialect) -> str:
    """Average uniqueness times the size of the market's log return from entry to exit (last price known on the day).

    What depends on the day alone, Spark works out once per day.
    """
    price = f"(SELECT symbol, CAST(ts AS TIMESTAMP) AS ts, c AS v FROM {daily()} b)"
    ends = f"(SELECT 'orders' AS symbol, CAST(exit_datetime AS TIMESTAMP) AS ts, id FROM {ledger()} t)"
    starts = f"(SELECT 'orders' AS symbol, CAST(entry_datetime AS TIMESTAMP) AS ts, id FROM {ledger()} t)"
    c = f"SELECT day, CASE WHEN open_trades > 0 THEN 1e0 / open_trades ELSE 0e0 END AS u FROM {_concurrency(_closed(d))} q"
    p = f"SELECT day, sum(u) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - u AS before, row_number() OVER (ORDER BY day) AS k FROM ({c}) z"
    if d.name == "spark":
        known = f"SELECT ts, v FROM {asof(d, f"(SELECT 'orders' AS symbol, CAST(day AS TIMESTAMP) AS ts, k AS id FROM ({p}) z)", price)} j"
        days = f"SELECT p.day, p.before, p.k, j.v FROM ({p}) p JOIN ({known}) j ON j.ts = CAST(p.day AS TIMESTAMP)"
        return f"(SELECT /*+ BROADCAST(e, x) */ t.id, t.k, t.n, (x.before - e.before) / (x.k - e.k) * abs(ln(x.v / e.v)) AS w FROM {_ranked(d)} t JOIN ({days}) e ON e.day = t.entry_datetime JOIN ({days}) x ON x.day = t.exit_datetime)"
    unique = f"SELECT t.id, t.k, t.n, (x.before - e.before) / (x.k - e.k) AS u FROM {_ranked(d)} t JOIN ({p}) e ON e.day = t.entry_datetime JOIN ({p}) x ON x.day = t.exit_datetime"
    return f"(SELECT q.id, q.k, q.n, q.u * abs(ln(b.v / a.v)) AS w FROM ({unique}) q JOIN {asof(d, starts, price)} a ON a.id = q.id JOIN {asof(d, ends, price)} b ON b.id = q.id)"


@series
def weights_return(d):
    if d.name == "spark":
        return f"SELECT /*+ BROADCAST(a) */ id, {r6('w / m')} AS weight FROM {_raw_weights(d)} r CROSS JOIN (SELECT avg(w) AS m FROM {_raw_weights(d)} r) a"
    return f"SELECT id, {r6('w / m')} AS weight FROM {_raw_weights(d)} r CROSS JOIN (SELECT avg(w) AS m FROM {_raw_weights(d)} r) a"


@series
def weights_time_decay(d, decay: float = 0.5):
    """Return weights times 1 - decay (1 - rank / n), not below 0, with mean 1."""
    factor = f"greatest(0e0, least(1e0, 1 - {decay} * (1 - (k + 1e0) / n)))"
    if d.name == "spark":
        return f"SELECT /*+ BROADCAST(a) */ id, {r6(f'w * {factor} / m')} AS weight FROM {_raw_weights(d)} r CROSS JOIN (SELECT avg(w * {factor}) AS m FROM {_raw_weights(d)} r) a"
    return f"SELECT id, {r6(f'w * {factor} / m')} AS weight FROM {_raw_weights(d)} r CROSS JOIN (SELECT avg(w * {factor}) AS m FROM {_raw_weights(d)} r) a"


# ---- cross-validation --------------------------------------------------------------------------------------------------------


def _walk_forward(d: Dialect, splits: int = 5, first: float = 0.4, embargo: float = 0.01) -> str:
    """Rows ``fold, id, role``: expanding training sets; open trades are purged, the last rows before the test embargoed."""
    folds = splits - 1
    start, size = f"CAST(floor(n * {first}) AS BIGINT)", f"greatest(1, CAST(floor((n - floor(n * {first})) / {folds}) AS BIGINT))"
    numbers = ", ".join(f"({f})" for f in range(folds))
    edges = f"SELECT fold, {start} + fold * {size} AS a, least({start} + (fold + 1) * {size}, n) AS b, n, greatest(1, CAST(floor(n * {embargo}) AS BIGINT)) AS e FROM (SELECT count(*) AS n FROM {ledger()} t) c CROSS JOIN (VALUES {numbers}) AS f(fold)"
    if d.name == "spark":
        # Of the folds' edges there is a handful; they go to every task.
        edges = edges.replace(ledger(), _ranked(d)).replace("SELECT fold", "SELECT /*+ BROADCAST(c) */ fold", 1)
        begins = f"SELECT /*+ BROADCAST(w) */ w.fold, w.a, w.b, w.e, r.entry_datetime AS begins FROM ({edges}) w JOIN {_ranked(d)} r ON r.k = w.a"
        role = "CASE WHEN r.k >= w.a AND r.k < w.b THEN 'test' WHEN r.k < greatest(0, w.a - w.e) AND r.exit_datetime < w.begins THEN 'train' END"
        return f"(SELECT * FROM (SELECT /*+ BROADCAST(w) */ w.fold, r.id, r.trade_return_pct, r.direction, r.regime, {role} AS role FROM {_ranked(d)} r CROSS JOIN ({begins}) w) q WHERE role IS NOT NULL)"
    begins = f"SELECT w.fold, w.a, w.b, w.e, r.entry_datetime AS begins FROM ({edges}) w JOIN {_ranked(d)} r ON r.k = w.a"
    role = "CASE WHEN r.k >= w.a AND r.k < w.b THEN 'test' WHEN r.k < greatest(0, w.a - w.e) AND r.exit_datetime < w.begins THEN 'train' END"
    return f"(SELECT fold, id, role FROM (SELECT w.fold, r.id, {role} AS role FROM {_ranked(d)} r CROSS JOIN ({begins}) w) q WHERE role IS NOT NULL)"


@series
def cv_walk_forward(d):
    return f"SELECT fold, id, role FROM {_walk_forward(d)} f"


def _combinatorial(d: Dialect, splits: int = 6, embargo: float = 0.01, least: int = 30) -> str:
    """Rows ``g1, g2, id, role`` of every pair of test groups with enough training trades.

    Before each contiguous block of test groups, trades that are still open when it begins and were entered before its last entry
    are purged, those of the last rows before it embargoed.
    """
    n = f"(SELECT count(*) AS n, greatest(1, CAST(floor(count(*) * {embargo}) AS BIGINT)) AS e FROM {ledger()} t)"
    if d.name == "duckdb":
        pairs = ", ".join(f"({a}, {b}, {a}, {b if b == a + 1 else a}, {b}, {b})" for a in range(splits) for b in range(a + 1, splits))
        ranked = f"ranked AS MATERIALIZED (SELECT r.*, CAST(floor(((r.k + 1) * {splits} - 1) / r.n) AS INT) AS g FROM {_ranked(d)} r)"
        entry = lambda k: f"(SELECT entry_datetime FROM ranked WHERE k = {k})"
        lo, hi = lambda g: f"CAST(floor({g} * n / {splits}.0) AS BIGINT)", lambda g: f"CAST(floor(({g} + 1) * n / {splits}.0) AS BIGINT)"
        blocks = f"blocks AS MATERIALIZED (SELECT p.*, n.e, {lo('a1')} AS lo1, {hi('b1')} AS hi1, {lo('a2')} AS lo2, {hi('b2')} AS hi2, {entry(lo('a1'))} AS f1, {entry(hi('b1') + ' - 1')} AS t1, {entry(lo('a2'))} AS f2, {entry(hi('b2') + ' - 1')} AS t2 FROM (VALUES {pairs}) AS p(g1, g2, a1, b1, a2, b2) CROSS JOIN {n} n)"
        inside = f"(r.k >= {lo('g1').replace('n /', 'r.n /')} AND r.k < {hi('g1').replace('n /', 'r.n /')}) OR (r.k >= {lo('g2').replace('n /', 'r.n /')} AND r.k < {hi('g2').replace('n /', 'r.n /')})"
        near = " OR ".join(f"(r.exit_datetime >= f{x} AND r.entry_datetime < t{x}) OR (r.k >= greatest(0, lo{x} - e) AND r.k < lo{x})" for x in (1, 2))
        rows = f"SELECT g1, g2, id, CASE WHEN {inside} THEN 'test' WHEN {near} THEN 'out' ELSE 'train' END AS role FROM ranked r CROSS JOIN blocks"
        # A pair that is one block has it named twice, which changes nothing.
        return f"(WITH {ranked}, {blocks}, rows AS MATERIALIZED ({rows}) SELECT g1, g2, id, role FROM rows q WHERE role <> 'out' AND (SELECT count(*) FROM rows z WHERE z.g1 = q.g1 AND z.g2 = q.g2 AND z.role = 'train') >= {least})"
    # Groups and pairs are a handful; they go to every task.
    n = n.replace(ledger(), _ranked(d))
    numbers = ", ".join(f"({g})" for g in range(splits))
    groups = f"SELECT /*+ BROADCAST(n) */ g, n.n, n.e, CAST(floor(g * n.n / {splits}D) AS BIGINT) AS lo, CAST(floor((g + 1) * n.n / {splits}D) AS BIGINT) AS hi FROM (VALUES {numbers}) AS f(g) CROSS JOIN {n} n"
    opened = f"SELECT /*+ BROADCAST(g) */ g.*, a.entry_datetime AS opens FROM ({groups}) g JOIN {_ranked(d)} a ON a.k = g.lo"
    known = f"SELECT /*+ BROADCAST(g) */ g.*, b.entry_datetime AS closes FROM ({opened}) g JOIN {_ranked(d)} b ON b.k = g.hi - 1"
    pairs = f"SELECT /*+ BROADCAST(b) */ a.g AS g1, b.g AS g2, a.e, a.lo AS lo1, a.hi AS hi1, b.lo AS lo2, b.hi AS hi2, a.opens AS opens1, CASE WHEN b.g = a.g + 1 THEN b.closes ELSE a.closes END AS closes1, CASE WHEN b.g > a.g + 1 THEN b.opens END AS opens2, b.closes AS closes2, CASE WHEN b.g > a.g + 1 THEN b.lo END AS cut2 FROM ({known}) a JOIN ({known}) b ON a.g < b.g"
    inside = "(r.k >= p.lo1 AND r.k < p.hi1) OR (r.k >= p.lo2 AND r.k < p.hi2)"
    near = "(r.exit_datetime >= p.opens1 AND r.entry_datetime < p.closes1) OR (r.k >= p.lo1 - p.e AND r.k < p.lo1) OR coalesce((r.exit_datetime >= p.opens2 AND r.entry_datetime < p.closes2) OR (r.k >= p.cut2 - p.e AND r.k < p.cut2), false)"
    rows = f"SELECT /*+ BROADCAST(p) */ p.g1, p.g2, r.id, r.trade_return_pct, r.direction, r.regime, CASE WHEN {inside} THEN 'test' WHEN {near} THEN 'out' ELSE 'train' END AS role FROM {_ranked(d)} r CROSS JOIN ({pairs}) p"
    enough = f"SELECT g1 AS k1, g2 AS k2 FROM ({rows}) x WHERE role = 'train' GROUP BY g1, g2 HAVING count(*) >= {least}"
    return f"(SELECT /*+ BROADCAST(k) */ q.* FROM ({rows}) q JOIN ({enough}) k ON k.k1 = q.g1 AND k.k2 = q.g2 WHERE q.role <> 'out')"


@series
def cv_combinatorial(d):
    return f"SELECT g1, g2, id, role FROM {_combinatorial(d)} c"


@series
def cv_combined_scores(d):
    """Mean and deviation over the folds of each method: win rate and mean return of a fold's test trades."""
    if d.name == "spark":
        wf = f"SELECT 'walk_forward' AS method, fold AS f1, 0 AS f2, trade_return_pct AS ret FROM {_walk_forward(d)} a WHERE role = 'test'"
        cp = f"SELECT 'combinatorial' AS method, g1 AS f1, g2 AS f2, trade_return_pct AS ret FROM {_combinatorial(d)} b WHERE role = 'test'"
        scores = f"SELECT method, f1, f2, avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END) AS accuracy, avg(ret) AS ret FROM ({wf} UNION ALL {cp}) s GROUP BY method, f1, f2"
        return f"SELECT method, count(*) AS n_folds, {r6('avg(accuracy)')} AS accuracy_mean, {r6('stddev_samp(accuracy)')} AS accuracy_std, {r6('avg(ret)')} AS ret_mean, {r6('stddev_samp(ret)')} AS ret_std FROM ({scores}) z GROUP BY method"
    wf = f"SELECT 'walk_forward' AS method, fold AS f1, 0 AS f2, id FROM {_walk_forward(d)} a WHERE role = 'test'"
    cp = f"SELECT 'combinatorial' AS method, g1 AS f1, g2 AS f2, id FROM {_combinatorial(d)} b WHERE role = 'test'"
    scores = f"SELECT method, f1, f2, avg(CASE WHEN t.trade_return_pct > 0 THEN 1e0 ELSE 0e0 END) AS accuracy, avg(t.trade_return_pct) AS ret FROM ({wf} UNION ALL {cp}) s JOIN {ledger()} t ON t.id = s.id GROUP BY method, f1, f2"
    return f"SELECT method, count(*) AS n_folds, {r6('avg(accuracy)')} AS accuracy_mean, {r6('stddev_samp(accuracy)')} AS accuracy_std, {r6('avg(ret)')} AS ret_mean, {r6('stddev_samp(ret)')} AS ret_std FROM ({scores}) z GROUP BY method"


def normal_cdf(x: str) -> str:
    """Distribution function of the normal law by the error function's rational approximation (error below 1.5e-7)."""
    # Fixed values of the approximation.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = f"(1e0 / (1e0 + {p} * abs({x}) / sqrt(2e0)))"
    poly = " + ".join(f"{c} * power({t}, {k})" for k, c in enumerate(a, 1))
    tail = f"(({poly}) * exp(-({x}) * ({x}) / 2e0))"
    return f"(CASE WHEN {x} >= 0 THEN 1e0 - {tail} / 2e0 ELSE {tail} / 2e0 END)"


def normal_ppf(p: str) -> str:
    """Inverse of the normal distribution function for 0 < p < 1 (absolute error below 4.5e-4)."""
    # Fixed values of the approximation.
    c, e = (2.515517, 0.802853, 0.010328), (1.432788, 0.189269, 0.001308)
    t = f"sqrt(-2e0 * ln(least({p}, 1e0 - ({p}))))"
    z = f"({t} - ({c[0]} + {c[1]} * {t} + {c[2]} * {t} * {t}) / (1e0 + {e[0]} * {t} + {e[1]} * {t} * {t} + {e[2]} * {t} * {t} * {t}))"
    return f"(CASE WHEN {p} < 5e-1 THEN -{z} ELSE {z} END)"


@series
def deflated_sharpe(d):
    """Of the combinatorial paths' Sharpe ratios: the probability that the best is more than the best of as many trials by luck."""
    cp = f"SELECT g1, g2, id FROM {_combinatorial(d)} b WHERE role = 'test'"
    paths = f"SELECT g1, g2, avg(t.trade_return_pct) / stddev_samp(t.trade_return_pct) AS sr FROM ({cp}) s JOIN {ledger()} t ON t.id = s.id GROUP BY g1, g2"
    if d.name == "spark":
        paths = f"SELECT g1, g2, avg(trade_return_pct) / stddev_samp(trade_return_pct) AS sr FROM {_combinatorial(d)} b WHERE role = 'test' GROUP BY g1, g2"
    gamma = 0.5772156649
    stats = f"SELECT max(sr) AS best, stddev_samp(sr) AS sd, CAST(count(*) AS DOUBLE) AS n FROM ({paths}) p"
    luck = f"SELECT *, {1 - gamma!r} * {normal_ppf('(1e0 - 1e0 / n)')} + {gamma} * {normal_ppf(f'(1e0 - 1e0 / (n * {math.e!r}))')} AS expected FROM ({stats}) q"
    return f"SELECT {r6('best')} AS best_sharpe, {r6('expected')} AS expected_best, round({normal_cdf('((best - expected) / sd)')}, 5) AS deflated FROM ({luck}) z"


# ---- feature quality ---------------------------------------------------------------------------------------------------------

#: Quality is measured of these features: momentum, range, volume against its mean.
MEASURED = ("momentum", "span", "activity")


def _measured(d: Dialect) -> str:
    """One row per bar and feature: ``symbol, feature, ts, rn, f, y1, y5, move, dollars, spread, regime``."""
    base = (
        f"SELECT symbol, ts, row_number() OVER ({d.over}) AS rn, c / {d.lag('c', 5)} - 1 AS momentum, (h - l) / c AS span, v / {d.w('avg', 'v', -20, -1)} AS activity, {d.lead('c')} / c - 1 AS y1, {d.lead('c', 5)} / c - 1 AS y5, "
        f"c / {d.lag('c')} - 1 AS move, c * v AS dollars, (h - l) / (h + l) AS spread, CASE WHEN c > {d.w('avg', 'c', -20, -1)} THEN 1 ELSE 0 END AS regime FROM {bars(d)} b"
    )
    rest = "symbol, ts, rn, y1, y5, move, dollars, spread, regime"
    if d.name == "spark":
        return f"(SELECT {rest}, feature, f FROM ({base}) b LATERAL VIEW stack({len(MEASURED)}, {', '.join(f"'{x}', {x}" for x in MEASURED)}) u AS feature, f)"
    return "(" + " UNION ALL ".join(f"SELECT {rest}, '{x}' AS feature, {x} AS f FROM ({base}) b" for x in MEASURED) + ")"


_OF = "PARTITION BY symbol, feature ORDER BY ts"


def _rolling_ic(d: Dialect, window: int) -> str:
    """Correlation of feature and five-bar return over the last ``window`` bars, from the first full window on; undefined counts as 0."""
    frame = f" OVER ({_OF} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    rows = f"SELECT symbol, feature, ts, rn, dollars, move, coalesce({corr('f', 'y5', over=frame)}, 0e0) AS ic FROM {_measured(d)} m"
    return f"(SELECT *, row_number() OVER ({_OF}) AS t, count(*) OVER (PARTITION BY symbol, feature) AS n FROM ({rows}) r WHERE rn >= {window})"


@series
def feature_ic_stability(d, window: int = 60, halflife: int = 252):
    """Of the rolling correlation: decayed mean, t statistic, persistence of its sign, sensitivity to dollar volume."""
    weight = f"exp(-(n - t) / CAST(least({halflife}, n) AS DOUBLE))"
    third = "CAST(floor(n / 3) AS BIGINT)"
    first, last = f"avg(CASE WHEN t <= {third} THEN ic END)", f"avg(CASE WHEN t > n - {third} THEN ic END)"
    return (
        f"SELECT symbol, feature, {r6(f'sum(ic * {weight}) / sum({weight})')} AS weighted_ic, round(avg(ic) / (nullif(stddev_samp(ic), 0) / sqrt(count(*))), 4) AS t_statistic, "
        f"CASE WHEN {first} * {last} >= 0 THEN 1 ELSE 0 END AS persistence, {r6(f"abs({_pair('ic', 'ln(dollars + 1)', 'true')}) / 2")} AS dollar_volume_sensitivity FROM {_rolling_ic(d, window)} q GROUP BY symbol, feature"
    )


@series
def feature_ic_drawdown(d, window: int = 100):
    """Of the rolling correlation: stability, deepest fall from its peak, bars from the trough after the peak to 90 % of the peak."""
    rows = f"SELECT *, max(ic) OVER ({_OF} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM {_rolling_ic(d, window)} q"
    peaks = f"SELECT symbol, feature, max(ic) AS peak, {'min_by' if d.name == 'spark' else 'arg_min'}(t, {'struct' if d.name == 'spark' else 'row'}(-ic, t)) AS at FROM ({rows}) a GROUP BY symbol, feature"
    lows = f"SELECT r.symbol, r.feature, {'min_by' if d.name == 'spark' else 'arg_min'}(r.t, {'struct' if d.name == 'spark' else 'row'}(r.ic, r.t)) AS low FROM ({rows}) r JOIN ({peaks}) p ON p.symbol = r.symbol AND p.feature = r.feature WHERE r.t >= p.at GROUP BY r.symbol, r.feature"
    back = f"SELECT r.symbol, r.feature, min(CASE WHEN r.t >= l.low AND r.ic >= 0.9 * p.peak THEN r.t END) - max(l.low) AS found, max(r.n) - max(l.low) + 1 AS rest, max(r.n) - max(p.at) AS after FROM ({rows}) r JOIN ({peaks}) p ON p.symbol = r.symbol AND p.feature = r.feature JOIN ({lows}) l ON l.symbol = r.symbol AND l.feature = r.feature GROUP BY r.symbol, r.feature"
    falls = f"SELECT symbol, feature, least(abs(avg(ic)) / (stddev_samp(ic) + 1e-10), 100e0) AS stability, CASE WHEN abs(max(top)) < 0.01 THEN 0e0 ELSE max(greatest(0e0, least(1e0, (top - ic) / nullif(top, 0)))) END AS fall FROM ({rows}) r GROUP BY symbol, feature"
    return f"SELECT f.symbol, f.feature, {r6('f.stability')} AS stability, {r6('f.fall')} AS max_drawdown, CASE WHEN b.after < 5 THEN 0 ELSE coalesce(b.found, b.rest) END AS recovery FROM ({falls}) f JOIN ({back}) b ON b.symbol = f.symbol AND b.feature = f.feature"


def _pair(x: str, y: str, cond: str) -> str:
    return f"coalesce({corr(x, y, '' if cond == 'true' else cond)}, 0e0)"


def _conditional(d: Dialect) -> str:
    middle = f"SELECT symbol AS s, {d.quantile('spread', 0.5)} AS median FROM {_measured(d)} m GROUP BY symbol"
    rows = f"SELECT m.*, q.median, CASE WHEN f > avg(f) OVER (PARTITION BY symbol, feature) THEN 1 WHEN f < avg(f) OVER (PARTITION BY symbol, feature) THEN -1 ELSE 0 END AS sg, lag(f) OVER ({_OF}) AS before, power(move, 3) AS cube FROM {_measured(d)} m JOIN ({middle}) q ON q.s = m.symbol"
    rows = f"SELECT *, abs(sg - lag(sg) OVER ({_OF})) AS turn FROM ({rows}) r"
    at_least = lambda cond, n, x: f"CASE WHEN sum(CASE WHEN {cond} THEN 1 ELSE 0 END) > {n} THEN {x} ELSE 0e0 END"
    ic0, ic1 = _pair("f", "y1", "true"), _pair("before", "y1", "f IS NOT NULL")
    columns = {
        "ic_calm": at_least("abs(move) < 0.01", 20, _pair("f", "y5", "abs(move) < 0.01")), "ic_tail": at_least("abs(move) > 0.03", 5, _pair("f", "y5", "abs(move) > 0.03")), "ic_crash": at_least("move < -0.05", 3, _pair("f", "y5", "move < -0.05")),
        "spread_sensitivity": f"abs({_pair('f', 'y5', 'spread < median')} - {_pair('f', 'y5', 'spread > median')})", "skew_exposure": "greatest(-1e1, least(1e1, coalesce(covar_pop(CASE WHEN cube IS NOT NULL THEN f END, CASE WHEN f IS NOT NULL THEN cube END) / nullif(var_pop(CASE WHEN f IS NOT NULL THEN cube END), 0), 0e0)))",
        "volume_correlation": _pair("f", "ln(dollars + 1)", "dollars > 0"), "availability": "avg(CASE WHEN f IS NULL THEN 0e0 ELSE 1e0 END)", "turnover": "avg(turn) / 2",
        "delay_sensitivity": f"CASE WHEN abs({ic0}) > 0.01 THEN least(1e0, abs({ic0} - {ic1}) / (abs({ic0}) + 1e-10)) ELSE 0e0 END",
    }
    return f"(SELECT symbol, feature, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM ({rows}) z GROUP BY symbol, feature)"


@series
def feature_conditional_metrics(d):
    names = "ic_calm ic_tail ic_crash spread_sensitivity skew_exposure volume_correlation availability turnover delay_sensitivity".split()
    return f"SELECT symbol, feature, {', '.join(f'{r6(x)} AS {x}' for x in names)} FROM {_conditional(d)} q"


def _regime_consistency(d: Dialect) -> str:
    per = f"SELECT symbol, feature, regime, {_pair('f', 'y5', 'true')} AS ic FROM {_measured(d)} m GROUP BY symbol, feature, regime HAVING count(*) > 10"
    return f"(SELECT symbol, feature, CASE WHEN count(*) < 2 THEN 0e0 ELSE greatest(0e0, least(1e0, 1 - stddev_samp(ic) / (abs(avg(ic)) + 1e-10))) END AS consistency FROM ({per}) p GROUP BY symbol, feature)"


@series
def feature_regime_consistency(d):
    return f"SELECT symbol, feature, {r6('consistency')} AS consistency FROM {_regime_consistency(d)} c"


@series
def feature_regime_transitions(d, window: int = 10):
    """Median relative change of a short rolling correlation around changes of regime (mean of the window after against that before)."""
    frame = f"{_OF} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW"
    rows = f"SELECT symbol, feature, ts, regime, lag(regime) OVER ({_OF}) AS was, rn, CASE WHEN count(CASE WHEN f IS NOT NULL AND y5 IS NOT NULL THEN 1 END) OVER ({frame}) >= 5 THEN {corr('f', 'y5', over=f' OVER ({frame})')} END AS ic FROM {_measured(d)} m"
    # The correlation of the window that begins at a bar stands window - 1 rows later.
    around = f"SELECT symbol, feature, regime, was, rn, avg(ic) OVER ({_OF} ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING) AS lead_in, avg(ic) OVER ({_OF} ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS follow FROM ({rows}) t"
    change = f"SELECT symbol, feature, abs(follow - lead_in) / (abs(lead_in) + 1e-10) AS change FROM ({around}) a WHERE was IS NOT NULL AND regime <> was AND abs(lead_in) > 0.01 AND follow IS NOT NULL"
    return f"SELECT symbol, feature, count(*) AS changes, {r6(d.quantile('change', 0.5))} AS sensitivity FROM ({change}) c GROUP BY symbol, feature HAVING count(*) >= 5"


def smoothing_weights(half: int = 10) -> list[float]:
    """Weights of the least-squares cubic over 2 half + 1 points at its middle."""
    m = half
    return [(3 * (3 * m * m + 3 * m - 1) - 15 * j * j) / ((2 * m - 1) * (2 * m + 1) * (2 * m + 3)) for j in range(-m, m + 1)]


def _noise(d: Dialect, half: int = 10) -> str:
    terms = " + ".join(f"({w!r}) * {f'lag(f, {-j})' if j < 0 else f'lead(f, {j})' if j else 'f'}{f' OVER ({_OF})' if j else ''}" for j, w in zip(range(-half, half + 1), smoothing_weights(half), strict=True))
    rows = f"SELECT symbol, feature, f, {terms} AS smooth FROM {_measured(d)} m WHERE f IS NOT NULL"
    return f"(SELECT symbol, feature, greatest(0e0, least(1e1, stddev_samp(smooth) / nullif(stddev_samp(f - smooth), 0))) AS snr FROM ({rows}) r WHERE smooth IS NOT NULL GROUP BY symbol, feature)"


@series
def feature_signal_to_noise(d):
    """Deviation of the smoothed feature (cubic over 21 bars) against that of the rest; bars with a full window."""
    return f"SELECT symbol, feature, round(snr, 4) AS snr FROM {_noise(d)} n"


@series
def feature_orthogonality(d):
    """1 less the mean absolute correlation with all measured features, a feature's own counting as 0."""
    m = _measured(d)
    pairs = f"SELECT a.symbol, a.feature, abs({_pair('a.f', 'b.f', 'true')}) AS r FROM {m} a JOIN {m} b ON a.symbol = b.symbol AND a.ts = b.ts AND a.feature <> b.feature GROUP BY a.symbol, a.feature, b.feature"
    return f"SELECT symbol, feature, {r6(f'greatest(0e0, 1 - sum(r) / {len(MEASURED)})')} AS orthogonality FROM ({pairs}) p GROUP BY symbol, feature"


@series
def feature_mutual_information(d, bins: int = 10):
    """Mutual information, in nats, of feature and five-bar return over bins of equal counts."""
    rows = f"SELECT symbol, feature, ntile({bins}) OVER (PARTITION BY symbol, feature ORDER BY f, ts) AS a, ntile({bins}) OVER (PARTITION BY symbol, feature ORDER BY y5, ts) AS b, count(*) OVER (PARTITION BY symbol, feature) AS n FROM {_measured(d)} m WHERE f IS NOT NULL AND y5 IS NOT NULL"
    cells = f"SELECT symbol, feature, a, b, max(n) AS n, CAST(count(*) AS DOUBLE) AS k FROM ({rows}) r GROUP BY symbol, feature, a, b"
    sums = f"SELECT *, sum(k) OVER (PARTITION BY symbol, feature, a) AS ka, sum(k) OVER (PARTITION BY symbol, feature, b) AS kb FROM ({cells}) c"
    return f"SELECT symbol, feature, {r6('sum(k / n * ln(k * n / (ka * kb)))')} AS mutual_information FROM ({sums}) s GROUP BY symbol, feature"


@series
def feature_correlation_groups(d, limit: float = 0.3):
    """Pairs of measured features, and whether their distance 1 - |corr| puts them into one group."""
    m = _measured(d)
    pairs = f"SELECT a.symbol, a.feature AS f1, b.feature AS f2, {_pair('a.f', 'b.f', 'true')} AS r FROM {m} a JOIN {m} b ON a.symbol = b.symbol AND a.ts = b.ts AND a.feature < b.feature GROUP BY a.symbol, a.feature, b.feature"
    return f"SELECT symbol, f1, f2, {r6('r')} AS r, CASE WHEN 1 - abs(r) <= {limit} THEN 1 ELSE 0 END AS together FROM ({pairs}) p"


def _spearman(d: Dialect) -> str:
    rank = lambda z: f"(rank() OVER (PARTITION BY symbol, feature ORDER BY {z}) + (count(*) OVER (PARTITION BY symbol, feature, {z}) - 1) / 2e0)"
    return f"(SELECT symbol, feature, {_pair("a", "b", "true")} AS ic FROM (SELECT symbol, feature, {rank('f')} AS a, {rank('y5')} AS b FROM {_measured(d)} m WHERE f IS NOT NULL AND y5 IS NOT NULL) r GROUP BY symbol, feature)"


@series
def feature_max_relevance(d):
    """First choices of relevance without redundancy: features by |rank correlation| with the return, the best one's twins behind."""
    first = f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(ic) DESC, feature) AS k FROM {_spearman(d)} s"
    m = _measured(d)
    twin = f"SELECT a.symbol, a.feature, abs({_pair('a.f', 'b.f', 'true')}) AS r FROM {m} a JOIN ({first}) t ON t.symbol = a.symbol AND t.k = 1 JOIN {m} b ON b.symbol = a.symbol AND b.ts = a.ts AND b.feature = t.feature GROUP BY a.symbol, a.feature"
    scored = f"SELECT f.symbol, f.feature, f.ic, CASE WHEN f.k = 1 THEN 1e9 ELSE abs(f.ic) / greatest(t.r, 0.001) END AS score FROM ({first}) f JOIN ({twin}) t ON t.symbol = f.symbol AND t.feature = f.feature"
    return f"SELECT symbol, feature, {r6('ic')} AS ic, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, feature) AS place FROM ({scored}) s"


@series
def feature_final_score(d, cost: float = 0.001):
    """Share, in percent, of the weights of the metrics that pass their thresholds."""
    ic = f"SELECT symbol, feature, avg(ic) / (nullif(stddev_samp(ic), 0) / sqrt(count(*))) AS t FROM {_rolling_ic(d, 60)} q GROUP BY symbol, feature"
    stable = f"SELECT symbol, feature, least(abs(avg(ic)) / (stddev_samp(ic) + 1e-10), 100e0) AS stability FROM {_rolling_ic(d, 100)} q GROUP BY symbol, feature"
    on = lambda x: f"ON {x}.symbol = s.symbol AND {x}.feature = s.feature"
    # Weights and thresholds are fixed values; metrics without a test pass.
    tests = [
        (0.15, "s.ic > 0.02"), (0.10, "true"), (0.15, "coalesce(i.t, 0) > 2.0"), (0.15, f"s.ic - 0.5 * c.turnover * {cost} > 0.015"), (0.10, "c.turnover < 0.3"), (0.10, "x.stability > 2.0"),
        (0.10, "r.consistency > 0.5"), (0.05, "true"), (0.05, "c.skew_exposure < 0.1"), (0.05, "abs(c.volume_correlation) < 0.0"), (0.03, "c.availability > 0.95"), (0.02, "n.snr > 0.5"),
    ]
    total = sum(w for w, _ in tests)
    score = " + ".join(f"CASE WHEN {cond} THEN {w} ELSE 0 END" for w, cond in tests)
    return f"SELECT s.symbol, s.feature, round(CAST(({score}) / {total!r} * 100 AS DOUBLE), 4) AS score FROM {_spearman(d)} s JOIN {_conditional(d)} c {on('c')} JOIN ({ic}) i {on('i')} JOIN ({stable}) x {on('x')} JOIN {_regime_consistency(d)} r {on('r')} JOIN {_noise(d)} n {on('n')}"


# ---- ticks and distributions -------------------------------------------------------------------------------------------------


def _tick_moves(d: Dialect) -> str:
    """Log returns of consecutive ticks other than zero, numbered from the last (``back``) and the first (``k``)."""
    raw = f"SELECT symbol, trade_id, ln(price) - ln(lag(price) OVER (PARTITION BY symbol ORDER BY trade_id)) AS lr FROM {ticks()} t"
    return f"(SELECT symbol, trade_id, lr, row_number() OVER (PARTITION BY symbol ORDER BY trade_id) AS k, row_number() OVER (PARTITION BY symbol ORDER BY trade_id DESC) AS back FROM ({raw}) r WHERE lr <> 0)"


@series
def tick_daily_metric(d):
    """Dollar volume, volume and path of each series' ticks by day."""
    moves = f"SELECT symbol, {d.bucket('ts', 24)} AS day, price * quantity AS dollars, quantity, abs(price / lag(price) OVER (PARTITION BY symbol ORDER BY trade_id) - 1) AS move FROM {ticks()} t"
    return f"SELECT symbol, day, {r6('sum(dollars)')} AS dollars, {r6('sum(quantity)')} AS volume, {r6('coalesce(sum(move), 0)')} AS path FROM ({moves}) m GROUP BY symbol, day"


@series
def tick_quality(d, window: int = 500, recent: int = 300, lag: int = 50):
    """Of tick returns: entropy in bits over 50 bins, stability (correlation of sizes fifty ticks apart), noise, efficiency."""
    m = _tick_moves(d)
    edges = f"SELECT symbol AS s, min(lr) AS lo, max(lr) AS hi, count(*) AS n FROM {m} m GROUP BY symbol"
    cells = f"SELECT symbol, least(floor((lr - lo) / (hi - lo) * 50), 49) AS bin, max(n) AS n, count(*) AS c FROM {m} m JOIN ({edges}) e ON e.s = m.symbol GROUP BY symbol, least(floor((lr - lo) / (hi - lo) * 50), 49)"
    entropy = f"SELECT symbol, -sum(1e0 * c / n * log2(1e0 * c / n)) AS entropy FROM ({cells}) c GROUP BY symbol"
    after = f"SELECT *, lag(lr) OVER (PARTITION BY symbol ORDER BY k) AS before, lag(lr, {lag}) OVER (PARTITION BY symbol ORDER BY k) AS far FROM {m} m"
    steady = corr("abs(lr)", "abs(far)", f"back <= {window}")
    noise = f"stddev_pop(CASE WHEN back <= {recent} THEN lr END) / nullif(avg(CASE WHEN back <= {recent} THEN abs(lr) END), 0)"
    clip = lambda x: f"greatest(0e0, least(1e0, {x}))"
    ratio = "var_pop(CASE WHEN k % 2 = 1 THEN lr END) / (2 * nullif(var_pop(lr), 0))"
    stats = f"SELECT symbol, count(*) AS n, CASE WHEN count(*) >= {2 * window} THEN coalesce({clip(f'({steady} + 1) / 2')}, 5e-1) ELSE 5e-1 END AS stability, CASE WHEN count(*) >= 50 THEN coalesce({clip(f'({noise} - 2) / 18')}, 5e-1) ELSE 5e-1 END AS noise, greatest(0e0, 1 - abs(coalesce({corr('lr', 'before')}, 0e0)) * 10) AS calm, coalesce(greatest(0e0, 1 - abs({ratio} - 1) * 2), 5e-1) AS even FROM ({after}) a GROUP BY symbol"
    return f"SELECT s.symbol, s.n, {r6('e.entropy')} AS entropy, {r6('s.stability')} AS stability, {r6('s.noise')} AS noise, {r6('greatest(1e-1, least(9e-1, (s.calm + s.even) / 2))')} AS efficiency FROM ({stats}) s JOIN ({entropy}) e ON e.symbol = s.symbol"


@series
def distribution_comparison(d):
    """Every pair of series: Mann-Whitney U, Kolmogorov-Smirnov distance and Cohen's d of their log returns.

    Ranks and distribution functions are windows over the pair's values; equal values share the mean rank.
    """
    r = f"(SELECT symbol, r FROM (SELECT symbol, ln(c) - ln({d.lag('c')}) AS r FROM {bars(d, 24)} b) q WHERE r IS NOT NULL)"
    names = f"(SELECT DISTINCT symbol FROM {r} q)"
    pairs = f"SELECT a.symbol AS a, b.symbol AS b FROM {names} a JOIN {names} b ON a.symbol < b.symbol"
    values = f"SELECT p.a, p.b, CASE WHEN q.symbol = p.a THEN 1 ELSE 0 END AS first, q.r FROM ({pairs}) p JOIN {r} q ON q.symbol = p.a OR q.symbol = p.b"
    w = "PARTITION BY a, b ORDER BY r RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    placed = f"SELECT *, rank() OVER (PARTITION BY a, b ORDER BY r) + (count(*) OVER (PARTITION BY a, b, r) - 1) / 2e0 AS place, sum(first) OVER ({w}) AS below_a, sum(1 - first) OVER ({w}) AS below_b, sum(first) OVER (PARTITION BY a, b) AS n, sum(1 - first) OVER (PARTITION BY a, b) AS m FROM ({values}) v"
    mean = lambda x: f"avg(CASE WHEN first = {x} THEN r END)"
    var = lambda x: f"var_samp(CASE WHEN first = {x} THEN r END)"
    return f"SELECT a, b, round(sum(CASE WHEN first = 1 THEN place END) - max(n) * (max(n) + 1) / 2e0, 2) AS mann_whitney, round(max(abs(1e0 * below_a / n - 1e0 * below_b / m)), 6) AS kolmogorov_smirnov, round(({mean(1)} - {mean(0)}) / nullif(sqrt(({var(1)} + {var(0)}) / 2), 0), 4) AS cohen_d FROM ({placed}) z GROUP BY a, b"


@series
def pattern_signals(d):
    """Pattern codes as strengths: the place of a code's size among the sizes that occur, with the code's sign."""
    from tidewright.plans.series import SERIES

    names = ("engulfing", "harami", "doji_star", "hikkake", "marubozu")
    codes = SERIES["candle_patterns"](d)
    if d.name == "spark":
        sizes = ", ".join(f"array_sort(collect_set(abs({n}))) AS s_{n}" for n in names)
        strength = ", ".join(f"CAST(sign({n}) * (array_position(s_{n}, abs({n})) - 1) AS INT) AS signal_{n}" for n in names)
        return f"SELECT symbol, ts, {strength} FROM ({codes}) c CROSS JOIN (SELECT {sizes} FROM ({codes}) x) s"
    strength = ", ".join(f"CAST(sign({n}) * (dense_rank() OVER (ORDER BY abs({n})) - 1) AS INT) AS signal_{n}" for n in names)
    return f"SELECT symbol, ts, {strength} FROM ({codes}) c"
