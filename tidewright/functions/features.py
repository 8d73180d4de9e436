"""Registry of rolling features: name -> family, first row with a value, expression.

An expression is a function of a dialect and reads the columns of :data:`COLUMNS` and :data:`DERIVED`.
Features of the exclusive frame see the rows before the current one only. Where a value needs n rows, it is null
on the first n rows of a series. Denominators up to 1e-8 give null.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from tidewright.plans.dialect import EPS, Dialect

#: Columns made of the bars themselves (o, h, l, c, v) before any feature.
COLUMNS: dict[str, Callable[[Dialect], str]] = {
    "rn": lambda d: f"row_number() OVER ({d.over})",
    "pc": lambda d: d.lag("c"),
    "pv": lambda d: d.lag("v"),
    "po": lambda d: d.lag("o"),
    "r": lambda d: f"ln(c + {EPS}) - ln({d.lag('c')} + {EPS})",
    "lr": lambda d: f"ln(c) - ln({d.lag('c')})",
    "ra": lambda d: f"c / {d.lag('c')} - 1",
    "tr": lambda d: f"greatest(h - l, coalesce(abs(h - {d.lag('c')}), 0.0), coalesce(abs(l - {d.lag('c')}), 0.0))",
    "hl": lambda d: "ln(h / l)",
    "co": lambda d: "ln(c / o)",
    "hc": lambda d: "ln(h / c)",
    "lc": lambda d: "ln(c / l)",
    "oc": lambda d: f"ln(o / {d.lag('c')})",
    "tp": lambda d: "(h + l + c) / 3",
    "hl2": lambda d: "(h + l) / 2",
    "dp": lambda d: f"c - {d.lag('c')}",
    "lv": lambda d: "ln(1 + v)",
    "clv": lambda d: f"((c - l) - (h - c)) / (h - l + {EPS})",
}
#: Columns made of those.
DERIVED: dict[str, Callable[[Dialect], str]] = {
    "r1": lambda d: d.lag("r"),
    "dp1": lambda d: d.lag("dp"),
    "c5": lambda d: d.lag("c", 5),
    "rr1": lambda d: f"abs(r) * {d.lag('abs(r)')}",
    "tpt": lambda d: f"CASE WHEN (c > pc AND c > {d.lead('c')}) OR (c < pc AND c < {d.lead('c')}) THEN 1e0 ELSE 0e0 END",
    "obv_": lambda d: d.run("sum", "CASE WHEN c > pc THEN v WHEN c < pc THEN -v WHEN pc IS NULL THEN v ELSE 0 END"),
    "ad_": lambda d: d.run("sum", "CASE WHEN h > l THEN ((c - l) - (h - c)) / (h - l) * v ELSE 0 END"),
    "rmf": lambda d: "tp * v",
    "ptp": lambda d: d.lag("tp"),
    "rv5": lambda d: f"CASE WHEN rn > 5 THEN sqrt(252.0) * {d.w('stddev_pop', 'r', -5, -1)} END",
    "hi20": lambda d: d.w("max", "h", -20, -1),
    "rng20": lambda d: f"CASE WHEN rn > 20 THEN {d.w('max', 'h', -20, -1)} - {d.w('min', 'l', -20, -1)} END",
    "bp": lambda d: "c - least(l, coalesce(pc, l))",
    "cum_r": lambda d: d.run("sum", "coalesce(r, 0.0)"),
    "k14": lambda d: f"CASE WHEN rn >= 14 THEN 100 * (c - {d.w('min', 'l', -13, 0)}) / nullif({d.w('max', 'h', -13, 0)} - {d.w('min', 'l', -13, 0)}, 0) END",
    "atr_proxy": lambda d: d.w("avg", "tr", -13, 0),
    "flip": lambda d: f"CASE WHEN sign(r) <> sign({d.lag('r')}) THEN 1e0 ELSE 0e0 END",
    "day_hi": lambda d: d.w("max", "c", -99, 0),
    "bucket_r": lambda d: f"CASE WHEN rn > 50 THEN (CASE WHEN {d.w('avg', 'r', -50, -1)} > 0.02 THEN 1 WHEN {d.w('avg', 'r', -50, -1)} < -0.02 THEN -1 ELSE 0 END) END",
    "fell": lambda d: f"CASE WHEN rn > 100 AND c / ({d.w('max', 'c', -100, -1)} + {EPS}) - 1 < -0.05 THEN rn END",
    "closes20": lambda d: d.list("c", -20, -1),
    "low20": lambda d: d.w("min", "c", -20, -1),
    "high20": lambda d: d.w("max", "c", -20, -1),
}
#: Columns made of those of the second step.
DERIVED2: dict[str, Callable[[Dialect], str]] = {
    "vov": lambda d: f"CASE WHEN rn > 15 THEN {d.w('stddev_pop', 'rv5', -10, -1)} END",
    "slowk": lambda d: f"CASE WHEN rn >= 16 THEN {d.w('avg', 'k14', -2, 0)} END",
    "brk": lambda d: "CASE WHEN rn > 20 AND c > hi20 THEN rn END",
    "turned": lambda d: f"CASE WHEN bucket_r <> {d.lag('bucket_r')} THEN rn END",
    "spread_": lambda d: f"c - ({d.w2('regr_intercept', 'c', 'c5', -100, -1)} + {d.w2('regr_slope', 'c', 'c5', -100, -1)} * c5)",
    "entropy20": lambda d: f"CASE WHEN rn > 20 THEN {_bin_entropy(d)} END",
}
#: Columns made of those of the third step.
DERIVED3: dict[str, Callable[[Dialect], str]] = {
    "spread_lag": lambda d: f"CASE WHEN rn > 106 THEN {d.lag('spread_')} END",
    "spread_move": lambda d: f"CASE WHEN rn > 106 THEN spread_ - {d.lag('spread_')} END",
}


def _bin_entropy(d: Dialect, bins: int = 10) -> str:
    """Entropy, in nats, of the last twenty closes before the current one in ten bins of their range."""
    place = "least(floor((q - low20) / (high20 - low20) * 10), 9)"
    share = lambda b: f"({d.size(d.keep('closes20', 'q', f'{place} = {b}'))} / 20e0)"
    terms = " + ".join(f"{share(b)} * ln({share(b)} + {EPS})" for b in range(bins))
    return f"CASE WHEN high20 - low20 > {EPS} THEN -({terms}) ELSE 0e0 END"


@dataclass(frozen=True)
class Feature:
    family: str
    after: int
    sql: Callable[[Dialect], str]


FEATURES: dict[str, Feature] = {}


def _add(family: str, name: str, after: int, sql: Callable[[Dialect], str]) -> None:
    FEATURES[name] = Feature(family, after, sql)


def _returns() -> None:
    f = "returns"
    _add(f, "returns_arith", 2, lambda d: d.lag("ra"))
    _add(f, "returns_log", 2, lambda d: d.lag("lr"))
    _add(f, "returns_signed", 2, lambda d: d.lag("sign(lr) * abs(lr)"))
    _add(f, "returns_abs", 2, lambda d: d.lag("abs(lr)"))
    _add(f, "returns_squared", 2, lambda d: d.lag("lr * lr"))
    _add(f, "returns_cubed", 2, lambda d: d.lag("power(lr, 3)"))
    _add(f, "returns_quartic", 2, lambda d: d.lag("power(lr, 4)"))
    for name, n in (("5min", 5), ("15min", 15), ("1hr", 60), ("4hr", 240), ("1d", 1440)):
        _add(f, f"returns_{name}", n, lambda d, n=n: f"ln(c) - ln({d.lag('c', n)})")
    _add(f, "returns_forward_1", 1, lambda d: "lr")
    _add(f, "returns_forward_5", 5, lambda d: f"ln(c) - {d.w('avg', 'ln(c)', -5, -1)}")
    n = 20
    _add(f, "gain_loss_ratio", n, lambda d: d.div(d.w("sum", "CASE WHEN r > 0 THEN r ELSE 0 END", -n, -1), d.w("sum", "CASE WHEN r < 0 THEN -r ELSE 0 END", -n, -1)))
    _add(f, "upside_downside_var", n, lambda d: f"(CASE WHEN {d.w('count', 'CASE WHEN r > 0 THEN 1 END', -n, -1)} > 1 AND {d.w('count', 'CASE WHEN r < 0 THEN 1 END', -n, -1)} > 1 THEN {d.div(d.w('var_pop', 'CASE WHEN r > 0 THEN r END', -n, -1), d.w('var_pop', 'CASE WHEN r < 0 THEN r END', -n, -1))} END)")
    displacement = lambda d: d.div(d.w("sum", "r", -n, -1), d.w("sum", "abs(r)", -n, -1))
    _add(f, "net_displacement_ratio", n, displacement)
    _add(f, "directional_persistence", n, displacement)
    _add(f, "fractal_dimension", n, lambda d: f"1 + ln(({d.w('sum', 'abs(r)', -n, -1)}) / (abs({d.w('sum', 'r', -n, -1)}) + {EPS})) / ln({n})")
    _add(f, "turning_point_density", n, lambda d: f"{d.w('sum', 'tpt', -n + 1, -2)} / {n}")
    _add(f, "path_curvature", n, lambda d: f"(2 * {d.lag('c', 4)} + {d.lag('c', 3)} - pc - 2 * c) / {n / 2}")


def _volatility() -> None:
    f, n = "volatility", 20
    _add(f, "vol_parkinson", n, lambda d: f"sqrt({d.w('avg', 'hl * hl', -n, -1)} / {4 * math.log(2)})")
    _add(f, "vol_garman_klass", n, lambda d: f"sqrt(abs(0.5 * {d.w('avg', 'hl * hl', -n, -1)} - {2 * math.log(2) - 1} * {d.w('avg', 'co * co', -n, -1)}))")
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    rs = "(hc * (hc - co) + lc * (lc - co))"
    _add(f, "vol_rogers_satchell", n, lambda d: f"sqrt(abs({d.w('avg', rs, -n, -1)}))")
    _add(f, "vol_yang_zhang", n, lambda d: f"sqrt(greatest({d.w('var_pop', 'oc', -n + 1, 0)} + {k} * {d.w('var_pop', 'co', -n, -1)} + {1 - k} * {d.w('avg', rs, -n, -1)}, 0.0))")
    _add(f, "realized_vol", n, lambda d: f"sqrt(252.0) * {d.w('stddev_pop', 'r', -n, -1)}")
    _add(f, "vol_skew", n, lambda d: d.skew("r", -n, -1))
    _add(f, "vol_of_vol_of_vol", 35, lambda d: d.w("stddev_pop", "vov", -20, -1))
    _add(f, "realized_semivariance_down", n, lambda d: f"{d.w('sum', 'CASE WHEN r < 0 THEN r * r ELSE 0 END', -n, -1)} / {n}")
    _add(f, "realized_semivariance_up", n, lambda d: f"{d.w('sum', 'CASE WHEN r > 0 THEN r * r ELSE 0 END', -n, -1)} / {n}")
    _add(f, "asymmetry_index", n, lambda d: d.div(f"{d.w('stddev_pop', 'CASE WHEN r > 0 THEN r END', -n, -1)} - {d.w('stddev_pop', 'CASE WHEN r < 0 THEN r END', -n, -1)}", d.w("stddev_pop", "r", -n, -1)))
    _add(f, "intrabar_vol_skew", 1, lambda d: d.lag(f"(CASE WHEN lc > {EPS} THEN hc / lc ELSE 1 END)"))
    _add(f, "bipower_variation", n + 1, lambda d: f"{math.pi / 2} * {d.w('avg', 'rr1', -n + 1, -1)}")
    _add(f, "jump_component", n + 1, lambda d: f"greatest({d.w('avg', 'r * r', -n, -1)} - {math.pi / 2} * {d.w('avg', 'rr1', -n + 1, -1)}, 0.0)")
    _add(f, "z_score_jump", n, lambda d: d.div("abs(r)", d.w("stddev_pop", "r", -n, -1)))
    _add(f, "var_95", 100, lambda d: d.pct("r", 0.05, -100, -1))
    tail = lambda d: d.list("r", -100, -1)
    _add(f, "cvar_95", 101, lambda d: d.mean(d.keep(tail(d), "q", f"q <= {d.pct('r', 0.05, -100, -1)}")))
    p90 = lambda d: d.pct("abs(r)", 0.9, -100, -1)
    over = lambda d: d.keep(d.list("abs(r)", -100, -1), "q", f"q > {p90(d)}")
    _add(f, "tail_index_hill", 101, lambda d: f"(CASE WHEN {d.size(over(d))} > 2 THEN 1 / nullif({d.mean(d.map(over(d), 'z', f'ln(z / {p90(d)})'))}, 0) END)")


def _volume() -> None:
    f, n = "volume", 20
    _add(f, "volume_roc", 5, lambda d: d.ratio("v", d.lag("v", 5)) + " - 1")
    _add(f, "volume_surprise", n, lambda d: d.div(f"v - {d.w('avg', 'v', -n, -1)}", d.w("stddev_pop", "v", -n, -1)))
    _add(f, "volume_momentum", n, lambda d: f"v - {d.lag('v', n)}")
    _add(f, "volume_skew", n, lambda d: d.skew("v", -n, -1))
    _add(f, "volume_kurtosis", n, lambda d: d.kurt("v", -n, -1))
    _add(f, "volume_price_corr", n + 1, lambda d: d.w2("corr", "v", "abs(r)", -n, -1))
    _add(f, "volume_weighted_return", n + 1, lambda d: d.div(d.w("sum", "v * r", -n, -1), d.w("sum", "v", -n, -1)))
    _add(f, "obv", 1, lambda d: d.lag("obv_"))
    _add(f, "obv_slope", 14, lambda d: d.w2("regr_slope", "obv_", "rn", -14, -1))
    _add(f, "money_flow_mult", 1, lambda d: d.lag("(CASE WHEN h > l THEN ((c - l) - (h - c)) / (h - l) END)"))
    _add(f, "adl", 0, lambda d: "ad_")
    _add(f, "amihud_illiquidity", n + 1, lambda d: d.w("avg", "abs(r) / nullif(v, 0)", -n, -1))
    _add(f, "roll_spread", 7, lambda d: f"(CASE WHEN {d.w2('covar_samp', 'dp', 'dp1', -4, 0)} < 0 THEN 2 * sqrt(abs({d.w2('covar_samp', 'dp', 'dp1', -4, 0)})) ELSE 0 END)")
    g = lambda d: f"(0.04 * {d.w('avg', 'hl * hl', -n, -1)})"
    _add(f, "corwin_schultz", n, lambda d: f"2 * (exp({g(d)}) - 1) / (1 + exp({g(d)}))")
    _add(f, "effective_tick_proxy", n, lambda d: d.w("avg", "abs(2 * c - h - l)", -n, -1))
    _add(f, "overnight_gap", 1, lambda d: d.div("abs(o - pc)", "h - l"))
    _add(f, "volume_ratio", n, lambda d: d.div("v", d.w("avg", "v", -n, -1)))
    _add(f, "volume_sma", n, lambda d: d.w("avg", "v", -n, -1))
    _add(f, "vwap", 0, lambda d: d.div(d.run("sum", "round(tp * v, 4)"), d.run("sum", "v")))


def _trend() -> None:
    f = "trend"
    for n in (7, 20, 50, 100, 200):
        _add(f, f"sma_{n}", n, lambda d, n=n: d.w("avg", "c", -n, -1))
    _add(f, "price_sma_distance", 20, lambda d: d.div(f"c - {d.w('avg', 'c', -20, -1)}", d.w("avg", "c", -20, -1)))
    _add(f, "stochastic_k", 16, lambda d: "slowk")
    _add(f, "stochastic_d", 18, lambda d: d.w("avg", "slowk", -2, 0))
    _add(f, "cci", 20, lambda d: d.div(f"tp - {d.w('avg', 'tp', -19, 0)}", f"(0.015 * {d.mean(d.map(d.list('tp', -19, 0), 'q', 'abs(q - ' + d.w('avg', 'tp', -19, 0) + ')'))})"))
    _add(f, "williams_r", 14, lambda d: d.div(f"-100 * ({d.w('max', 'h', -13, 0)} - c)", f"({d.w('max', 'h', -13, 0)} - {d.w('min', 'l', -13, 0)})"))
    _add(f, "roc", 10, lambda d: f"100 * (c / {d.lag('c', 10)} - 1)")
    up, down = "CASE WHEN tp > ptp THEN rmf ELSE 0 END", "CASE WHEN tp < ptp THEN rmf ELSE 0 END"
    _add(f, "mfi", 14, lambda d: d.div(f"100 * {d.w('sum', up, -13, 0)}", f"({d.w('sum', up, -13, 0)} + {d.w('sum', down, -13, 0)})"))
    _add(f, "awesome_osc", 34, lambda d: f"{d.w('avg', 'hl2', -4, 0)} - {d.w('avg', 'hl2', -33, 0)}")
    part = lambda d, n: d.div(d.w("sum", "bp", -n + 1, 0), d.w("sum", "tr", -n + 1, 0))
    _add(f, "ultimate_osc", 28, lambda d: f"100 * (4 * {part(d, 7)} + 2 * {part(d, 14)} + {part(d, 28)}) / 7")
    band = lambda d, s: f"({d.w('avg', 'c', -20, -1)} {s} 2 * {d.w('stddev_pop', 'c', -20, -1)})"
    _add(f, "bb_percent_b", 20, lambda d: d.div(f"c - {band(d, '-')}", f"({band(d, '+')} - {band(d, '-')})"))
    _add(f, "bb_bandwidth", 20, lambda d: d.div(f"{band(d, '+')} - {band(d, '-')}", d.w("avg", "c", -20, -1)))
    _add(f, "donchian_upper", 20, lambda d: d.w("max", "h", -20, -1))
    _add(f, "choppiness_index", 14, lambda d: f"100 * {d.ln(d.div(d.w('sum', 'tr', -13, 0), f'({d.w("max", "h", -13, 0)} - {d.w("min", "l", -13, 0)})'))} / {math.log(14)}")


def _acf(d: Dialect, x: str, n: int, lag: int) -> str:
    """Lag-``lag`` autocorrelation of the frame's values with the frame's mean, by windowed sums: no arrays.

    Sum of (x_i - m)(x_{i+lag} - m) = sum of products - m (sum of the later ones + sum of the earlier ones) + (n - lag) m^2.
    """
    product = f"p{lag}_{'abs' if x != 'r' else 'r'}"
    DERIVED.setdefault(product, lambda d: f"{x} * {d.lag(x, lag)}")
    m = d.w("avg", x, -n, -1)
    top = f"({d.w('sum', product, -n + lag, -1)} - {m} * ({d.w('sum', x, -n + lag, -1)} + {d.w('sum', x, -n, -1 - lag)}) + {n - lag} * {m} * {m})"
    return d.div(top, f"({n} * {d.w('var_pop', x, -n, -1)})")


def _statistics() -> None:
    f = "statistics"
    for n in (30, 60, 90):
        _add(f, f"skewness_{n}", n + 1, lambda d, n=n: d.skew("r", -n, -1))
        _add(f, f"kurtosis_{n}", n + 1, lambda d, n=n: d.kurt("r", -n, -1))
    _add(f, "jarque_bera", 61, lambda d: f"10 * (power({d.skew('r', -60, -1)}, 2) + power({d.kurt('r', -60, -1)}, 2) / 4)")
    _add(f, "quantile_10", 61, lambda d: d.pct("r", 0.1, -60, -1))
    _add(f, "quantile_90", 61, lambda d: d.pct("r", 0.9, -60, -1))
    _add(f, "tail_ratio", 61, lambda d: d.div(d.pct("r", 0.95, -60, -1), f"abs({d.pct('r', 0.05, -60, -1)})"))
    for k in (2, 5, 10, 20):
        sums = lambda d, k=k: d.w("sum", "r", -k + 1, 0)
        DERIVED[f"sum_{k}"] = sums
        _add(f, f"variance_ratio_{k}", 101, lambda d, k=k: d.div(d.w("var_pop", f"sum_{k}", -100 + k - 1, -1), f"({k} * {d.w('var_pop', 'r', -100, -1)})"))
    for k in (1, 5, 10, 20, 50):
        _add(f, f"return_autocorr_{k}", 61, lambda d, k=k: _acf(d, "r", 60, k))
    _add(f, "abs_autocorr_1", 61, lambda d: _acf(d, "abs(r)", 60, 1))
    _add(f, "autocorr_decay_rate", 41, lambda d: f"-{d.ln(f'(abs({_acf(d, "r", 40, 2)}) / (abs({_acf(d, "r", 40, 1)}) + {EPS}) + {EPS})')}")
    fit = lambda d, a, y, x: d.w2(a, y, x, -100, -1)
    _add(f, "coint_residual", 105, lambda d: f"c - ({fit(d, 'regr_intercept', 'c', 'c5')} + {fit(d, 'regr_slope', 'c', 'c5')} * c5)")
    # t value of the spread's moves on its level over twenty values, a bar late.
    drift = lambda d, a: d.w2(a, "spread_move", "spread_lag", -20, -2)
    error = lambda d: f"(sqrt(greatest({drift(d, 'regr_syy')} - power({drift(d, 'regr_sxy')}, 2) / nullif({drift(d, 'regr_sxx')}, 0), 0.0) / 17) / (sqrt({drift(d, 'regr_sxx')}) + {EPS}))"
    _add(f, "coint_t_stat", 126, lambda d: f"{drift(d, 'regr_slope')} / ({error(d)} + {EPS})")
    _add(f, "beta_to_btc", 62, lambda d: d.div(d.w2("covar_samp", "r", "r1", -60, -1), d.w("var_pop", "r1", -60, -1)))
    _add(f, "corr_matrix_eigenval", 62, lambda d: f"1 + abs({d.w2('corr', 'r', 'abs(r)', -60, -1)})")
    se = lambda d: f"sqrt(greatest(({d.w2('regr_syy', 'c', 'pc', -60, -1)} - power({d.w2('regr_sxy', 'c', 'pc', -60, -1)}, 2) / nullif({d.w2('regr_sxx', 'c', 'pc', -60, -1)}, 0)) / 58 / nullif({d.w2('regr_sxx', 'c', 'pc', -60, -1)}, 0), 0.0))"
    _add(f, "adf_statistic", 61, lambda d: d.div(f"{d.w2('regr_slope', 'c', 'pc', -60, -1)} - 1", se(d)))


def _shape() -> None:
    f, n = "shape", 20
    _add(f, "triangle_convergence", n, lambda d: f"{d.w2('regr_slope', 'h', 'rn', -n, -1)} - {d.w2('regr_slope', 'l', 'rn', -n, -1)}")
    _add(f, "channel_parallelism", n, lambda d: f"coalesce({d.w2('corr', 'h', 'l', -n, -1)}, 0.0)")
    _add(f, "pattern_completion", n, lambda d: d.div(f"c - {d.w('min', 'l', -n, 0)}", f"({d.w('max', 'h', -n, 0)} - {d.w('min', 'l', -n, 0)})"))
    _add(f, "engulfing_ratio", 2, lambda d: d.lag("(CASE WHEN abs(pc - po) > 1e-8 THEN abs(c - o) / abs(pc - po) END)"))
    _add(f, "doji_strength", 1, lambda d: d.lag("(CASE WHEN abs(c - o) > 1e-8 THEN (h - l - abs(c - o)) / abs(c - o) END)"))
    _add(f, "head_shoulders_symmetry", 30, lambda d: d.div(d.w("max", "h", -30, -21), d.w("max", "h", -10, -1)))
    p = lambda d: f"({d.w('sum', 'abs(r)', -50, -1)})"
    _add(f, "persistence_entropy", 51, lambda d: f"-{d.total(d.map(d.list('abs(r)', -50, -1), 'q', f'CASE WHEN q > 0 THEN q / {p(d)} * ln(q / {p(d)}) ELSE 0.0 END'))}")
    _add(f, "signature_level1", n + 1, lambda d: d.w("sum", "r", -n + 1, -1))
    weights = lambda d, body: d.total(d.over_index(n - 1, "i", body.replace("XS", d.list("r", -n + 1, -1)).replace("AT", d.at(d.list("r", -n + 1, -1), "i"))))
    _add(f, "signature_level2", n + 1, lambda d: weights(d, f"({n} - i) * AT"))
    _add(f, "signature_level3", n + 1, lambda d: weights(d, f"({n} - i) * ({n + 1} - i) / 2.0 * AT"))
    _add(f, "log_signature_coords", n + 1, lambda d: f"ln(abs({d.w('sum', 'r', -n + 1, -1)}) + {EPS})")
    _add(f, "bollinger_area", n + 1, lambda d: f"{4 * n} * {d.w('stddev_pop', 'c', -n, -1)}")
    _add(f, "consolidation_slope", 81, lambda d: d.w2("regr_slope", "rng20", "rn", -60, -1))
    _add(f, "entropy_collapse_rate", 80, lambda d: d.w2("regr_slope", "entropy20", "rn", -60, -1))
    _add(f, "universal_multifractal_C1", 101, lambda d: f"0.5 * ({d.ln(d.w('avg', 'abs(r)', -100, -1))} - {d.ln(d.w('avg', '1 / (abs(r) + 1e-8)', -100, -1))})")
    _add(f, "convergent_cross_map", 101, lambda d: _acf(d, "r", 100, 10))


def _events() -> None:
    f = "events"
    _add(f, "time_since_high_break", 20, lambda d: f"rn - coalesce({d.last('brk')}, 20)")
    _add(f, "time_since_regime_change", 51, lambda d: f"rn - 1 - coalesce({d.ignoring('last_value', 'turned')} OVER ({d.over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 50)")
    _add(f, "time_since_drawdown_5pct", 100, lambda d: f"rn - coalesce({d.last('fell')}, 1)")
    _add(f, "hazard_rate_weibull", 101, lambda d: f"{d.size(d.keep(d.list('abs(r)', -100, -1), 'q', f'q > 2 * {d.w("stddev_pop", "r", -100, -1)}'))} / 100.0")
    _add(f, "hawkes_branching_ratio", 102, lambda d: f"(1 - {d.w('sum', 'flip', -99, -1)} / 99e0) / (1 / (1 + {d.w('sum', 'flip', -99, -1)}) + {EPS})")
    _add(f, "expected_time_to_breakout", 20, lambda d: f"(CASE WHEN {d.div(d.w('max', 'h', -20, -1) + ' - ' + d.w('min', 'l', -20, -1), d.w('avg', 'c', -20, -1))} > 0.01 THEN 1 / ({d.div(d.w('max', 'h', -20, -1) + ' - ' + d.w('min', 'l', -20, -1), d.w('avg', 'c', -20, -1))} + {EPS}) END)")
    _add(f, "hour_of_day", 0, lambda d: d.hour("ts"))
    _add(f, "day_of_week", 0, lambda d: d.weekday("ts"))
    _add(f, "time_sine", 0, lambda d: f"sin({2 * math.pi / 24} * {d.hour('ts')})")
    _add(f, "time_cosine", 0, lambda d: f"cos({2 * math.pi / 24} * {d.hour('ts')})")
    _add(f, "is_weekend", 0, lambda d: f"(CASE WHEN {d.weekday('ts')} >= 5 THEN 1 ELSE 0 END)")
    for hours, bin_ in ((24, 100 // 24), (12, 100 // 12)):
        turn = 2 * math.pi * bin_ / 100
        part = lambda d, g, t=turn: d.total(d.over_index(100, "i", f"{g}({t} * (i - 1)) * {d.at(d.list('c', -100, -1), 'i')}"))
        _add(f, f"fourier_component_{hours}h", 100, lambda d, p=part: f"sqrt(power({p(d, 'cos')}, 2) + power({p(d, 'sin')}, 2)) / 100")


def _falls(d: Dialect) -> str:
    """Of the closes of a frame against the largest so far: deepest drawdown, sum of squares, sum and number of negative ones.

    Spark carries them through the frame once; the twin makes the list of drawdowns.
    """
    if d.name == "spark":
        fall = "x_ / greatest(a_.top, x_) - 1"
        zero = "named_struct('top', 0D, 'low', 0D, 'squares', 0D, 'total', 0D, 'below', 0)"
        return f"aggregate(closes, {zero}, (a_, x_) -> named_struct('top', greatest(a_.top, x_), 'low', least(a_.low, {fall}), 'squares', a_.squares + ({fall}) * ({fall}), 'total', a_.total + ({fall}), 'below', a_.below + CASE WHEN x_ < a_.top THEN 1 ELSE 0 END))"
    z = "list_transform(range(1, len(closes) + 1), lambda i: closes[i] / list_max(closes[1:i]) - 1)"
    return f"{{'low': list_min({z}), 'squares': list_sum(list_transform({z}, lambda q: q * q)), 'total': list_sum({z}), 'below': len(list_filter({z}, lambda q: q < 0))}}"


def _risk() -> None:
    f = "risk"
    DERIVED["closes"] = lambda d: d.list("c", -100, -1)
    DERIVED2["falls"] = lambda d: f"CASE WHEN rn > 100 THEN {_falls(d)} END"
    _add(f, "max_drawdown", 100, lambda d: "falls.low")
    _add(f, "current_drawdown", 100, lambda d: f"c / {d.w('max', 'c', -100, -1)} - 1")
    _add(f, "ulcer_index", 100, lambda d: "sqrt(falls.squares / 100)")
    _add(f, "pain_index", 100, lambda d: "coalesce(falls.total / nullif(falls.below, 0), 0.0)")
    _add(f, "calmar_ratio", 101, lambda d: d.div(f"{d.w('avg', 'r', -100, -1)} * 252", "abs(falls.low)"))
    _add(f, "sharpe_ratio", 61, lambda d: d.div(f"{d.w('avg', 'r', -60, -1)} * sqrt(252.0)", d.w("stddev_pop", "r", -60, -1)))
    _add(f, "sortino_ratio", 61, lambda d: d.div(f"{d.w('avg', 'r', -60, -1)} * sqrt(252.0)", d.w("stddev_pop", "CASE WHEN r < 0 THEN r END", -60, -1)))
    _add(f, "omega_ratio", 101, lambda d: d.div(d.w("sum", "greatest(r, 0.0)", -100, -1), d.w("sum", "greatest(-r, 0.0)", -100, -1)))
    _add(f, "tail_ratio_95_5", 101, lambda d: d.div(d.pct("r", 0.95, -100, -1), f"abs({d.pct('r', 0.05, -100, -1)})"))


def _smart() -> None:
    f = "smart"
    for n in (5, 10, 20, 50):
        ret = lambda d, n=n: f"(c / {d.lag('c', n)} - 1)"
        vol = lambda d, n=n: f"(CASE WHEN rn > {n} THEN {d.w('stddev_pop', 'r', -n + 1, 0)} END)"
        _add(f, f"return_{n}", n, ret)
        _add(f, f"log_return_{n}", n, lambda d, n=n: f"ln(c / {d.lag('c', n)})")
        _add(f, f"volatility_{n}", n, vol)
        _add(f, f"risk_adj_momentum_{n}", n, lambda d, r=ret, v=vol: f"{r(d)} / ({v(d)} + {EPS})")
        _add(f, f"sharpe_{n}", n, lambda d, n=n: d.div(f"{d.w('avg', 'r', -n + 1, 0)} * sqrt(365.0)", d.w("stddev_pop", "r", -n + 1, 0)))
    for n in (10, 20, 50):
        _add(f, f"volume_ratio_{n}", n, lambda d, n=n: d.div("v", d.pct("v", 0.5, -n + 1, 0)))
        _add(f, f"volume_zscore_{n}", n, lambda d, n=n: d.div(f"lv - {d.w('avg', 'lv', -n + 1, 0)}", d.w("stddev_pop", "lv", -n + 1, 0)))
    ahead = lambda d: f"(c / {d.lag('c', 5)} - 1)"
    _add(f, "pv_divergence", 10, lambda d: f"(CASE WHEN {ahead(d)} >= 0 THEN 1 ELSE -1 END) * (abs({ahead(d)}) - abs({d.div('v', d.pct('v', 0.5, -9, 0))}))")
    position = f"((c - l) / (h - l + {EPS}))"
    _add(f, "price_position", 0, lambda d: position)
    _add(f, "close_position", 0, lambda d: position)
    _add(f, "typical_price", 0, lambda d: "tp")
    _add(f, "median_price", 0, lambda d: "hl2")
    _add(f, "log_volume", 0, lambda d: "lv")
    _add(f, "volatility_ratio_short_long", 101, lambda d: d.div(d.w("stddev_pop", "r", -19, 0), d.w("stddev_pop", "r", -99, 0)))
    _add(f, "bb_width_percent", 20, lambda d: d.div(f"400 * {d.w('stddev_pop', 'c', -19, 0)}", d.w("avg", "c", -19, 0)))
    _add(f, "efficiency_ratio", 10, lambda d: d.div(f"abs(c - {d.lag('c', 10)})", d.w("sum", "abs(r)", -9, 0)))
    _add(f, "intraday_strength", 0, lambda d: f"(CASE WHEN {position} > 0.7 THEN 1 WHEN {position} < 0.3 THEN -1 ELSE 0 END)")
    _add(f, "accumulation_score", 0, lambda d: "clv * v")


def _indicators() -> None:
    """Trailing indicators of the usual technical-analysis sets, on the current row's window."""
    f, n = "indicators", 14
    fit = lambda d, a: d.w2(a, "c", "rn", -n + 1, 0)
    _add(f, "mom_10", 10, lambda d: f"c - {d.lag('c', 10)}")
    _add(f, "rocp_10", 10, lambda d: f"c / {d.lag('c', 10)} - 1")
    _add(f, "rocr_10", 10, lambda d: f"c / {d.lag('c', 10)}")
    _add(f, "rocr100_10", 10, lambda d: f"100 * c / {d.lag('c', 10)}")
    _add(f, "bop", 0, lambda d: d.div("c - o", "h - l"))
    _add(f, "trange", 1, lambda d: "tr")
    _add(f, "linearreg_slope", n - 1, lambda d: fit(d, "regr_slope"))
    _add(f, "linearreg_intercept", n - 1, lambda d: f"{fit(d, 'regr_intercept')} + {fit(d, 'regr_slope')} * (rn - {n - 1})")
    _add(f, "linearreg", n - 1, lambda d: f"{fit(d, 'regr_intercept')} + {fit(d, 'regr_slope')} * rn")
    _add(f, "tsf", n - 1, lambda d: f"{fit(d, 'regr_intercept')} + {fit(d, 'regr_slope')} * (rn + 1)")
    _add(f, "linearreg_angle", n - 1, lambda d: f"degrees(atan({fit(d, 'regr_slope')}))")
    _add(f, "stddev_5", 4, lambda d: d.w("stddev_pop", "c", -4, 0))
    _add(f, "var_5", 4, lambda d: d.w("var_pop", "c", -4, 0))
    _add(f, "ma_30", 29, lambda d: d.w("avg", "c", -29, 0))
    _add(f, "wma_10", 9, lambda d: f"({d.total(d.over_index(10, 'i', 'i * ' + d.at(d.list('c', -9, 0), 'i')))}) / 55")
    _add(f, "trima_10", 9, lambda d: f"({d.total(d.over_index(10, 'i', 'least(i, 11 - i) * ' + d.at(d.list('c', -9, 0), 'i')))}) / 30")
    _add(f, "apo_sma", 25, lambda d: f"{d.w('avg', 'c', -11, 0)} - {d.w('avg', 'c', -25, 0)}")
    _add(f, "ppo_sma", 25, lambda d: d.div(f"100 * ({d.w('avg', 'c', -11, 0)} - {d.w('avg', 'c', -25, 0)})", d.w("avg", "c", -25, 0)))
    _add(f, "stochf_k", 4, lambda d: d.div(f"100 * (c - {d.w('min', 'l', -4, 0)})", f"({d.w('max', 'h', -4, 0)} - {d.w('min', 'l', -4, 0)})"))
    since = lambda d, x, agg: f"({d.size(d.keep(d.over_index(n + 1, 'i', f'CASE WHEN {d.at(d.list(x, -n, 0), "i")} = {d.w(agg, x, -n, 0)} THEN i END'), 'z', 'z IS NOT NULL'))})"
    last = lambda d, x, agg: d.at(d.keep(d.over_index(n + 1, "i", f"CASE WHEN {d.at(d.list(x, -n, 0), 'i')} = {d.w(agg, x, -n, 0)} THEN i END"), "z", "z IS NOT NULL"), since(d, x, agg))
    _add(f, "aroon_up", n, lambda d: f"100.0 * ({last(d, 'h', 'max')} - 1) / {n}")
    _add(f, "aroon_down", n, lambda d: f"100.0 * ({last(d, 'l', 'min')} - 1) / {n}")
    _add(f, "aroonosc", n, lambda d: f"100.0 * ({last(d, 'h', 'max')} - {last(d, 'l', 'min')}) / {n}")
    _add(f, "bb_upper", 19, lambda d: f"{d.w('avg', 'c', -19, 0)} + 2 * {d.w('stddev_pop', 'c', -19, 0)}")
    _add(f, "bb_lower", 19, lambda d: f"{d.w('avg', 'c', -19, 0)} - 2 * {d.w('stddev_pop', 'c', -19, 0)}")
    _add(f, "midpoint_14", 13, lambda d: f"({d.w('max', 'c', -13, 0)} + {d.w('min', 'c', -13, 0)}) / 2")
    gap = lambda d: f"({d.w('avg', 'c', -11, 0)} - {d.w('avg', 'c', -25, 0)})"
    DERIVED["sma_gap"] = lambda d: f"CASE WHEN rn >= 26 THEN {gap(d)} END"
    _add(f, "macdext", 33, lambda d: "sma_gap")
    _add(f, "macdext_signal", 33, lambda d: d.w("avg", "sma_gap", -8, 0))
    _add(f, "macdext_hist", 33, lambda d: f"sma_gap - {d.w('avg', 'sma_gap', -8, 0)}")
    # A moving average whose length follows the bar's hour: 2 to 30 bars.
    DERIVED["closes30"] = lambda d: d.list("c", -29, 0)
    period = lambda d: f"(2 + {d.hour('ts')} % 29)"
    tail = lambda d: f"slice(closes30, 31 - {period(d)}, {period(d)})" if d.name == "spark" else f"list_slice(closes30, 31 - {period(d)}, 30)"
    _add(f, "mavp", 29, lambda d: d.mean(tail(d)))
    _add(f, "minus_dm_raw", 1, lambda d: f"CASE WHEN {d.lag('l')} - l > h - {d.lag('h')} AND {d.lag('l')} - l > 0 THEN {d.lag('l')} - l ELSE 0 END")


for _build in (_returns, _volatility, _volume, _trend, _statistics, _shape, _events, _risk, _smart, _indicators):
    _build()

FAMILIES = tuple(dict.fromkeys(x.family for x in FEATURES.values()))


def features_sql(d: Dialect, names: list[str], source: str, digits: int | None = None) -> str:
    """SELECT of ``symbol, ts`` and the named features over ``source`` (symbol, ts, o, h, l, c, v)."""
    if unknown := [n for n in names if n not in FEATURES]:
        raise KeyError(f"unknown features: {unknown}")
    texts = {n: FEATURES[n].sql(d) for n in names}
    need3 = _needed(DERIVED3, " ".join(texts.values()), d)
    need2 = _needed(DERIVED2, " ".join([*texts.values(), *need3.values()]), d)
    need1 = _needed(DERIVED, " ".join([*texts.values(), *need2.values(), *need3.values()]), d)
    step = lambda cols: "".join(f", {sql} AS {name}" for name, sql in cols.items())
    base = {n: sql(d) for n, sql in COLUMNS.items()}
    rounded = lambda x: f"(round(CAST({x} AS DOUBLE), {digits}) + 0e0)" if digits is not None else x
    out = "".join(f", {rounded(f'CASE WHEN rn > {FEATURES[n].after} THEN {sql} END')} AS {n}" for n, sql in texts.items())
    return (
        f"WITH bars_ AS (SELECT * FROM {source}), base_ AS (SELECT *{step(base)} FROM bars_), more_ AS (SELECT *{step(need1)} FROM base_), "
        f"most_ AS (SELECT *{step(need2)} FROM more_), all_ AS (SELECT *{step(need3)} FROM most_) SELECT symbol, ts{out} FROM all_"
    )


def _needed(columns: dict[str, Callable[[Dialect], str]], text: str, d: Dialect) -> dict[str, str]:
    import re

    words = set(re.findall(r"\w+", text))
    return {n: sql(d) for n, sql in columns.items() if n in words}
