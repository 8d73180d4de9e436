"""Queries of price structure with ranges: balanced price ranges, order blocks with mitigation, blocks that lead to breaks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import order_blocks
from tidewright.plans.dialect import Dialect, Duck, Spark
from tidewright.plans.series import _swings, bars, r6, series

Run = Callable[[str], DataFrame]
FRAMES: dict[str, tuple[Callable[[Run], DataFrame], str]] = {}

#: Bars looked back, bins of their prices, bins in a row at least.
BACK, BINS, LEAST = 20, 100, 5


@series
def smc_balanced_ranges(d: Dialect) -> str:
    """The longest run of bins that the last twenty bars' highs and lows fall into more often than half as often again as the average bin."""
    dense = 1.5 * 2 * BACK / BINS
    value = lambda n, start: (
        f"{r6(f'lo + ({start} + {n} - 1) / {BINS}e0 * (hi - lo)')} AS top, {r6(f'lo + {start} / {BINS}e0 * (hi - lo)')} AS bottom, "
        + r6(f"CASE WHEN hi > lo THEN least(100e0, (1 - ({n} - 1) / {BINS}e0) * 50 + {n} / {BACK}e0 * 50) END")
        + " AS strength"
    )
    if d.name == "duckdb":
        rows = f"SELECT symbol, ts, h, l, row_number() OVER ({d.over}) AS k, {d.w('min', 'l', -BACK, -1)} AS lo, {d.w('max', 'h', -BACK, -1)} AS hi FROM {bars(d)} b"
        near = f"SELECT a.symbol, a.ts, a.lo, a.hi, unnest([b.h, b.l]) AS p FROM r a JOIN r b ON b.symbol = a.symbol AND b.k < a.k AND b.k >= a.k - {BACK} WHERE a.k > {BACK}"
        bins = f"SELECT symbol, ts, lo, hi, least({BINS - 1}, floor((p - lo) / (hi - lo + 0.0001) * {BINS})::INT) AS b FROM ({near}) n"
        full = f"SELECT symbol, ts, lo, hi, b, b - row_number() OVER (PARTITION BY symbol, ts ORDER BY b) AS island FROM ({bins}) x GROUP BY symbol, ts, lo, hi, b HAVING count(*) > {dense}"
        runs = f"SELECT symbol, ts, lo, hi, island, count(*) AS n, min(b) AS start FROM ({full}) f GROUP BY symbol, ts, lo, hi, island"
        best = f"SELECT * FROM ({runs}) z QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY n DESC, start) = 1"
        return f"WITH r AS MATERIALIZED ({rows}) SELECT symbol, ts, {value('n', 'start')} FROM ({best}) y WHERE n >= {LEAST}"
    # A row per price and then per bin: one expression over arrays of arrays would be worked out anew wherever it is used.
    rows = f"SELECT symbol, ts, row_number() OVER ({d.over}) AS k, {d.list('h', -BACK, -1)} AS hs, {d.list('l', -BACK, -1)} AS ls FROM {bars(d)} b"
    prices = f"SELECT symbol, ts, array_min(ls) AS lo, array_max(hs) AS hi, explode(concat(hs, ls)) AS p FROM ({rows}) r WHERE k > {BACK}"
    full = f"SELECT symbol, ts, lo, hi, b FROM (SELECT *, least({BINS - 1}, CAST(floor((p - lo) / (hi - lo + 0.0001) * {BINS}) AS INT)) AS b FROM ({prices}) e) n GROUP BY symbol, ts, lo, hi, b HAVING count(*) > {dense}"
    runs = f"SELECT symbol, ts, lo, hi, island, count(*) AS n, min(b) AS start FROM (SELECT *, b - row_number() OVER (PARTITION BY symbol, ts ORDER BY b) AS island FROM ({full}) f) g GROUP BY symbol, ts, lo, hi, island"
    best = f"SELECT symbol, ts, lo, hi, max(struct(n, -start AS start)) AS best FROM ({runs}) z GROUP BY symbol, ts, lo, hi"
    return f"SELECT symbol, ts, {value('best.n', '(-best.start)')} FROM ({best}) y WHERE best.n >= {LEAST}"


@series
def smc_break_blocks(d: Dialect) -> str:
    """Between a swing and the next that goes beyond the one before it: the most extreme bar, with its strength by volume and range against twenty bars."""
    w = "PARTITION BY symbol ORDER BY ts"
    legs = f"SELECT symbol, k AS k2, side, level AS level2, lag(k) OVER ({w}) AS k1, lag(level, 2) OVER ({w}) AS level0 FROM {_swings(d)} s"
    good = f"SELECT symbol, k1, k2, side FROM ({legs}) g WHERE side * level2 > side * level0"
    mean = lambda x: f"avg({x}) OVER ({d.over} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    numbered = f"(SELECT symbol, ts, h, l, v, row_number() OVER ({d.over}) AS k, {mean('v')} AS mv, {mean('h')} AS mh, {mean('l')} AS ml FROM {bars(d)} b)"
    if d.name == "duckdb":
        rows = f"SELECT b.*, g.k2, g.side FROM {numbered} b JOIN ({good}) g ON g.symbol = b.symbol AND b.k >= g.k1 AND b.k <= g.k2"
    else:  # a bar lies in the leg that ends next, and a leg's last bar in that leg too
        marked = f"SELECT b.*, s.k AS mark FROM {numbered} b LEFT JOIN {_swings(d)} s ON s.symbol = b.symbol AND s.k = b.k"
        next_ = f"SELECT *, last_value(mark, true) OVER (PARTITION BY symbol ORDER BY ts DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after FROM ({marked}) m"
        both = f"SELECT *, explode(filter(array(after, mark), x -> x IS NOT NULL)) AS ends FROM ({next_}) n"
        rows = f"SELECT q.symbol, q.ts, q.h, q.l, q.v, q.k, q.mv, q.mh, q.ml, g.k2, g.side FROM ({both}) q JOIN ({good}) g ON g.symbol = q.symbol AND g.k2 = q.ends WHERE q.k >= g.k1"
    first = f"SELECT *, row_number() OVER (PARTITION BY symbol, k2 ORDER BY CASE WHEN side = 1 THEN l ELSE -h END, k) AS place FROM ({rows}) r"
    strength = "CASE WHEN k >= 20 AND mv > 0 AND mh > ml THEN least(1e2, (v / mv + (h - l) / (mh - ml)) * 50) END"
    return f"SELECT symbol, ts, side AS kind, h AS top, l AS bottom, {r6(strength)} AS strength FROM ({first}) f WHERE place = 1"


def _with_swings(d: Dialect) -> str:
    """Bars with the swing that they are. A bar of the ends, where none is sought, has none."""
    return f"(SELECT b.symbol, b.ts, b.o, b.h, b.l, b.c, b.v, coalesce(s.side, 0) AS swing FROM {bars(d)} b LEFT JOIN {_swings(d)} s ON s.symbol = b.symbol AND s.ts = b.ts)"


def smc_order_blocks(run: Run) -> DataFrame:
    found = order_blocks.order_blocks(run(f"SELECT * FROM {_with_swings(Spark())} b"))
    return found.select("symbol", "ts", "kind", "top", "bottom", "volume", (F.round("balance", 6) + 0.0).alias("balance"), "made_at", "mitigated_at", "removed_at")


def _order_blocks_sql() -> str:
    """Each step a range join: the close beyond the swing, the extreme bar between, the bar that mitigates, the bar that removes."""
    rows = f"b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM {_with_swings(Duck())} x)"
    flip = "m AS MATERIALIZED (SELECT symbol, ts, k, 1 AS kind, h, l, c, v, swing = 1 AS turn FROM b UNION ALL SELECT symbol, ts, k, -1, -l, -h, -c, v, swing = -1 FROM b)"
    swings = "s AS (SELECT symbol, kind, k, h, lead(k, 1, 1000000000) OVER (PARTITION BY symbol, kind ORDER BY k) AS upto FROM m WHERE turn)"
    made = "made AS MATERIALIZED (SELECT s.symbol, s.kind, s.k AS k0, min(m.k) AS k1 FROM s JOIN m ON m.symbol = s.symbol AND m.kind = s.kind AND m.k > s.k AND m.k <= s.upto AND m.c > s.h GROUP BY s.symbol, s.kind, s.k)"
    between = "SELECT d.symbol, d.kind, d.k0, d.k1, m.k, m.h, m.l, m.ts FROM made d JOIN m ON m.symbol = d.symbol AND m.kind = d.kind AND ((m.k > d.k0 AND m.k < d.k1) OR (d.k1 = d.k0 + 1 AND m.k = d.k0))"
    block = f"block AS MATERIALIZED (SELECT * FROM ({between}) QUALIFY row_number() OVER (PARTITION BY symbol, kind, k0 ORDER BY l, k DESC) = 1)"
    hit = "hit AS MATERIALIZED (SELECT o.*, (SELECT min(k) FROM m WHERE m.symbol = o.symbol AND m.kind = o.kind AND m.k > o.k1 AND m.l < o.l) AS k2 FROM block o)"
    gone = "gone AS (SELECT i.*, (SELECT min(k) FROM m WHERE m.symbol = i.symbol AND m.kind = i.kind AND m.k > i.k2 AND m.h > i.h) AS k3 FROM hit i)"
    at = lambda k: f"(SELECT ts FROM b WHERE b.symbol = g.symbol AND b.k = g.{k})"
    v = lambda n: f"coalesce((SELECT v FROM b WHERE b.symbol = g.symbol AND b.k = g.k1 - {n}), 0)"
    vols = f"SELECT g.*, {v(0)} + {v(1)} AS late, {v(2)} AS early, {at('k1')} AS made_at, {at('k2')} AS mitigated_at, {at('k3')} AS removed_at FROM gone g"
    balance = "CASE WHEN greatest(late, early) > 0 THEN round(least(late, early) / greatest(late, early) * 100, 6) + 0e0 ELSE 1e2 END"
    return f"WITH {rows}, {flip}, {swings}, {made}, {block}, {hit}, {gone} SELECT symbol, ts, kind, CASE WHEN kind = 1 THEN h ELSE -l END AS top, CASE WHEN kind = 1 THEN l ELSE -h END AS bottom, late + early AS volume, {balance} AS balance, made_at, mitigated_at, removed_at FROM ({vols})"


FRAMES["smc_order_blocks"] = (smc_order_blocks, _order_blocks_sql())
