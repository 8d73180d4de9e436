"""One source for the SQL of two engines: Spark runs it, DuckDB checks it.

Expressions are written with the methods of a :class:`Dialect`; the few constructs that the engines spell
differently (percentiles and lists over frames, lambdas, bucketing) live here, everything else is plain SQL.
"""

from __future__ import annotations

EPS = "1e-8"


def _bound(k: int) -> str:
    return "CURRENT ROW" if k == 0 else f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING"


def corr(x: str, y: str, cond: str = "", over: str = "") -> str:
    """Correlation of the rows that have both (and meet ``cond``); null where either doesn't vary, which is an error of division in one engine."""
    cond = f" AND {cond}" if cond else ""
    a, b = f"CASE WHEN {y} IS NOT NULL{cond} THEN {x} END", f"CASE WHEN {x} IS NOT NULL{cond} THEN {y} END"
    spread = f"(stddev_pop({a}){over} * stddev_pop({b}){over})"
    return f"(CASE WHEN {spread} > 1e-14 THEN covar_pop({a}, {b}){over} / {spread} END)"


class Dialect:
    """SQL of one engine for series partitioned by ``by`` and totally ordered by ``order``."""

    name = ""

    def __init__(self, by: str = "symbol", order: str = "ts") -> None:
        self.over = f"PARTITION BY {by} ORDER BY {order}"

    # frames
    def w(self, agg: str, x: str, lo: int, hi: int) -> str:
        """An aggregate of ``x`` over rows lo..hi relative to the current one."""
        return f"{agg}({x}) OVER ({self.over} ROWS BETWEEN {_bound(lo)} AND {_bound(hi)})"

    def w2(self, agg: str, y: str, x: str, lo: int, hi: int) -> str:
        if agg == "corr":
            return corr(y, x, over=f" OVER ({self.over} ROWS BETWEEN {_bound(lo)} AND {_bound(hi)})")
        return f"{agg}({y}, {x}) OVER ({self.over} ROWS BETWEEN {_bound(lo)} AND {_bound(hi)})"

    def lag(self, x: str, n: int = 1) -> str:
        return f"lag({x}, {n}) OVER ({self.over})"

    def lead(self, x: str, n: int = 1) -> str:
        return f"lead({x}, {n}) OVER ({self.over})"

    def run(self, agg: str, x: str) -> str:
        return f"{agg}({x}) OVER ({self.over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def last(self, x: str) -> str:
        """The last non-null value up to the current row."""
        return f"{self.ignoring('last_value', x)} OVER ({self.over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def next(self, x: str) -> str:
        """The first non-null value from the current row on."""
        return f"{self.ignoring('first_value', x)} OVER ({self.over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"

    # moments, population; the engines' own differ
    def skew(self, x: str, lo: int, hi: int) -> str:
        m1, m2, m3 = (self.w("avg", f"power({x}, {k})" if k > 1 else x, lo, hi) for k in (1, 2, 3))
        sd = self.w("stddev_pop", x, lo, hi)
        return f"(CASE WHEN {sd} > {EPS} THEN ({m3} - 3 * {m1} * {m2} + 2 * power({m1}, 3)) / power({sd}, 3) END)"

    def kurt(self, x: str, lo: int, hi: int) -> str:
        m1, m2, m3, m4 = (self.w("avg", f"power({x}, {k})" if k > 1 else x, lo, hi) for k in (1, 2, 3, 4))
        sd = self.w("stddev_pop", x, lo, hi)
        return f"(CASE WHEN {sd} > {EPS} THEN ({m4} - 4 * {m1} * {m3} + 6 * power({m1}, 2) * {m2} - 3 * power({m1}, 4)) / power({sd}, 4) - 3 END)"

    def div(self, a: str, b: str, least: str = EPS) -> str:
        """a / b where b exceeds ``least``, else null."""
        return f"(CASE WHEN {b} > {least} THEN ({a}) / ({b}) END)"

    def ratio(self, a: str, b: str) -> str:
        return f"(({a}) / nullif({b}, 0))"

    def ln(self, x: str) -> str:
        return f"(CASE WHEN {x} > 0 THEN ln({x}) END)"

    def sqrt(self, x: str) -> str:
        return f"(CASE WHEN {x} >= 0 THEN sqrt({x}) END)"

    # engine specific
    def ignoring(self, fn: str, x: str) -> str:
        """A value function that skips nulls."""
        raise NotImplementedError

    def pct(self, x: str, q: float, lo: int, hi: int) -> str:
        raise NotImplementedError

    def quantile(self, x: str, q: float) -> str:
        raise NotImplementedError

    def list(self, x: str, lo: int, hi: int) -> str:
        raise NotImplementedError

    def map(self, xs: str, var: str, body: str) -> str:
        raise NotImplementedError

    def keep(self, xs: str, var: str, cond: str) -> str:
        raise NotImplementedError

    def total(self, xs: str) -> str:
        raise NotImplementedError

    def at(self, xs: str, i: str) -> str:
        raise NotImplementedError

    def size(self, xs: str) -> str:
        raise NotImplementedError

    def over_index(self, n: str | int, var: str, body: str, start: str | int = 1) -> str:
        raise NotImplementedError

    def mean(self, xs: str) -> str:
        return f"({self.total(xs)} / nullif({self.size(xs)}, 0))"


class Spark(Dialect):
    name = "spark"

    def ignoring(self, fn, x):
        return f"{fn}({x}, true)"

    def pct(self, x, q, lo, hi):
        return f"percentile({x}, {q}) OVER ({self.over} ROWS BETWEEN {_bound(lo)} AND {_bound(hi)})"

    def quantile(self, x, q):
        return f"percentile({x}, {q})"

    def list(self, x, lo, hi):
        return self.w("collect_list", x, lo, hi)

    def map(self, xs, var, body):
        return f"transform({xs}, {var} -> {body})"

    def keep(self, xs, var, cond):
        return f"filter({xs}, {var} -> {cond})"

    def total(self, xs):
        return f"aggregate({xs}, CAST(0 AS DOUBLE), (acc_, x_) -> acc_ + x_)"

    def at(self, xs, i):
        return f"try_element_at({xs}, CAST({i} AS INT))"

    def size(self, xs):
        return f"size({xs})"

    def sorted(self, xs):
        return f"array_sort({xs})"

    def over_index(self, n, var, body, start=1):
        return f"(CASE WHEN {n} >= {start} THEN transform(sequence({start}, CAST({n} AS INT)), {var} -> {body}) END)"

    def bucket(self, ts: str, hours: int) -> str:
        return f"date_trunc('HOUR', {ts})" if hours == 1 else f"date_trunc('DAY', {ts})"

    def first_by(self, x: str, key: str) -> str:
        return f"min_by({x}, {key})"

    def last_by(self, x: str, key: str) -> str:
        return f"max_by({x}, {key})"

    def hours_between(self, a: str, b: str) -> str:
        return f"(timestampdiff(SECOND, {a}, {b}) / 3600.0D)"

    def weekday(self, ts: str) -> str:
        return f"weekday({ts})"

    def hour(self, ts: str) -> str:
        return f"hour({ts})"


class Duck(Dialect):
    name = "duckdb"

    def ignoring(self, fn, x):
        return f"{fn}({x} IGNORE NULLS)"

    def pct(self, x, q, lo, hi):
        return f"quantile_cont({x}, {q}) OVER ({self.over} ROWS BETWEEN {_bound(lo)} AND {_bound(hi)})"

    def quantile(self, x, q):
        return f"quantile_cont({x}, {q})"

    def list(self, x, lo, hi):
        return self.w("list", x, lo, hi)

    def map(self, xs, var, body):
        return f"list_transform({xs}, lambda {var}: {body})"

    def keep(self, xs, var, cond):
        return f"list_filter({xs}, lambda {var}: {cond})"

    def total(self, xs):
        return f"coalesce(list_sum({xs}), 0.0::DOUBLE)"

    def at(self, xs, i):
        return f"({xs})[CAST({i} AS INT)]"

    def size(self, xs):
        return f"len({xs})"

    def sorted(self, xs):
        return f"list_sort({xs})"

    def over_index(self, n, var, body, start=1):
        return f"(CASE WHEN {n} >= {start} THEN list_transform(range({start}, CAST({n} AS INT) + 1), lambda {var}: {body}) END)"

    def bucket(self, ts: str, hours: int) -> str:
        return f"date_trunc('{'hour' if hours == 1 else 'day'}', {ts})"

    def first_by(self, x: str, key: str) -> str:
        return f"arg_min({x}, {key})"

    def last_by(self, x: str, key: str) -> str:
        return f"arg_max({x}, {key})"

    def hours_between(self, a: str, b: str) -> str:
        return f"(date_diff('second', {a}, {b}) / 3600.0::DOUBLE)"

    def weekday(self, ts: str) -> str:
        return f"(isodow({ts}) - 1)"

    def hour(self, ts: str) -> str:
        return f"hour({ts})"
