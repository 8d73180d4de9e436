"""Queries of modelling steps that are operators over frames: bootstrap, unit roots, clusters of features.

``FRAMES`` holds, per name, a function from a runner of SQL to a frame, and the twin's text. Inputs are written once for both
engines; what the operator does is written apart in the twin, as recursive queries and dot products of lists.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import bootstrap, clusters, granger, learning, minute_bars, neighbours, transforms, unit_root
from tidewright.plans.dialect import Dialect, Duck, Spark
from tidewright.plans.research import _combinatorial, _events, _walk_forward, normal_cdf, normal_ppf
from tidewright.plans.series import bars, ledger, r6, series, ticks
from tidewright.sources.staging import staged

Run = Callable[[str], DataFrame]
FRAMES: dict[str, tuple[Callable[[Run], DataFrame], str]] = {}

# ---- spans of labels, their indicator matrix and uniqueness ------------------------------------------------------------------


def _bar_places(d: Dialect) -> str:
    return f"SELECT symbol, CAST(ts AS TIMESTAMP) AS ts, row_number() OVER ({d.over}) - 1 AS k FROM {bars(d)} b"


def _spans(d: Dialect) -> str:
    """Events whose end is known, with the places of their first and last bar."""
    at = f"({_bar_places(d)})"
    return f"(SELECT e.symbol, e.ts, a.k AS start, z.k AS stop FROM {_events(d)} e JOIN {at} a ON a.symbol = e.symbol AND a.ts = e.ts JOIN {at} z ON z.symbol = e.symbol AND z.ts = e.touch)"


@series
def indicator_matrix(d):
    """The ones of the matrix of bars and events, a row each: a sparse matrix that no task holds."""
    if d.name == "duckdb":
        return f"SELECT s.symbol, s.ts AS event, b.ts AS bar FROM {_spans(d)} s JOIN ({_bar_places(d)}) b ON b.symbol = s.symbol AND b.k >= s.start AND b.k <= s.stop"
    cells = f"SELECT symbol, ts AS event, explode(sequence(start, stop)) AS k FROM {_spans(d)} s"
    return f"SELECT c.symbol, c.event, b.ts AS bar FROM ({cells}) c JOIN ({_bar_places(d)}) b ON b.symbol = c.symbol AND b.k = c.k"


@series
def average_uniqueness(d):
    """Mean over an event's bars of one over the events that share the bar: running sums over bars, not over the matrix."""
    if d.name == "duckdb":
        shared = f"SELECT b.symbol, b.k, count(*) AS c FROM ({_bar_places(d)}) b JOIN {_spans(d)} s ON b.symbol = s.symbol AND b.k >= s.start AND b.k <= s.stop GROUP BY b.symbol, b.k"
        return f"SELECT s.symbol, s.ts, {r6('avg(1e0 / c)')} AS uniqueness FROM {_spans(d)} s JOIN ({shared}) c ON c.symbol = s.symbol AND c.k >= s.start AND c.k <= s.stop GROUP BY s.symbol, s.ts"
    ends = f"SELECT symbol, k, sum(x) AS x FROM (SELECT symbol, start AS k, 1 AS x FROM {_spans(d)} a UNION ALL SELECT symbol, stop + 1 AS k, -1 AS x FROM {_spans(d)} z UNION ALL SELECT symbol, k, 0 AS x FROM ({_bar_places(d)}) b) e GROUP BY symbol, k"
    along = "PARTITION BY symbol ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    shared = f"SELECT symbol, k, sum(x) OVER ({along}) AS c FROM ({ends}) e"
    sums = f"SELECT symbol, k, CASE WHEN c > 0 THEN 1e0 / c ELSE 0e0 END AS u, sum(CASE WHEN c > 0 THEN 1e0 / c ELSE 0e0 END) OVER ({along}) AS run FROM ({shared}) s"
    return f"SELECT s.symbol, s.ts, {r6('(z.run - a.run + a.u) / (s.stop - s.start + 1)')} AS uniqueness FROM {_spans(d)} s JOIN ({sums}) a ON a.symbol = s.symbol AND a.k = s.start JOIN ({sums}) z ON z.symbol = s.symbol AND z.k = s.stop"


def sequential_bootstrap(run: Run) -> DataFrame:
    """As many draws from each symbol's events as there are events."""
    drawn = bootstrap.sequential_bootstrap(run(f"SELECT * FROM {_spans(Spark())} s"), ["symbol"], "ts")
    return drawn.select("symbol", "draw", "ts", F.round("uniqueness", 6).alias("uniqueness"))


def _bootstrap_sql(seed: int = 42) -> str:
    """Every bar with the draws that cover it, from draw to draw; a bar, then one of its events, by running sums."""
    p = bootstrap.PRIME
    a, spans = f"((k + 1) * 48271 + 11) % {p}", f"s AS MATERIALIZED (SELECT *, 1e0 / (stop - start + 1) AS share FROM {_spans(Duck())} q)"
    cover = "cover AS MATERIALIZED (SELECT symbol, bar, ts, start, stop, share, sum(share) OVER (PARTITION BY symbol, bar ORDER BY start, ts) AS cum FROM (SELECT *, unnest(range(start, stop + 1)) AS bar FROM s) x)"
    base = "w AS MATERIALIZED (SELECT symbol, bar, sum(share) AS weight FROM cover GROUP BY symbol, bar), sizes AS MATERIALIZED (SELECT symbol, count(*) AS n FROM s GROUP BY symbol)"
    first = "SELECT symbol, bar, weight, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS c, CAST(NULL AS TIMESTAMP) AS ts, 0e0 AS uniqueness, n FROM w JOIN sizes USING (symbol)"
    r = f"SELECT *, {a} AS a FROM acc WHERE k < n"
    r = f"SELECT *, (a * a + {seed}) % {p} AS b FROM ({r})"
    r = f"SELECT *, (b * b + a) % {p} AS r1, ((b * b + a) % {p} * ((b * b + a) % {p}) + b) % {p} AS r2 FROM ({r})"
    r = f"SELECT *, sum(weight / (1 + c)) OVER (PARTITION BY symbol ORDER BY bar) AS cum, sum(weight / (1 + c)) OVER (PARTITION BY symbol) AS total FROM ({r})"
    r = f"SELECT *, min(CASE WHEN cum > r1 / {p}.0::DOUBLE * total THEN bar END) OVER (PARTITION BY symbol) AS hit FROM ({r})"
    r = f"SELECT *, max(CASE WHEN bar = hit THEN weight END) OVER (PARTITION BY symbol) * (r2 / {p}.0::DOUBLE) AS goal FROM ({r})"
    r = f"SELECT r.*, v.ts AS chosen, v.start, v.stop FROM ({r}) r JOIN cover v ON v.symbol = r.symbol AND v.bar = r.hit AND v.cum > r.goal AND v.cum - v.share <= r.goal"
    step = f"SELECT symbol, bar, weight, k + 1, c + CASE WHEN bar BETWEEN start AND stop THEN 1 ELSE 0 END, chosen, avg(CASE WHEN bar BETWEEN start AND stop THEN 1e0 / (1 + c) END) OVER (PARTITION BY symbol), n FROM ({r})"
    return f"WITH RECURSIVE {spans}, {cover}, {base}, acc AS ({first} UNION ALL {step}) SELECT DISTINCT symbol, k AS draw, ts, round(uniqueness, 6) AS uniqueness FROM acc WHERE k > 0"


FRAMES["sequential_bootstrap"] = (sequential_bootstrap, _bootstrap_sql())

# ---- unit roots --------------------------------------------------------------------------------------------------------------

ORDERS = [round(0.05 * k, 2) for k in range(21)]
#: Smallest weight of a filter. The operator's own default, 1e-5, makes filters longer than a month of hourly bars.
THRESHOLD = 1e-4


def _levels(d: Dialect) -> str:
    """Series to test, a row per bar: log price, log volume, running balance of volume on rising and falling bars."""
    b = f"SELECT symbol, ts, ln(c) AS price, ln(1 + v) AS volume, sum(CASE WHEN c > o THEN v ELSE -v END) OVER ({d.over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 1e2 AS balance FROM {bars(d)} b"
    names = ("price", "volume", "balance")
    if d.name == "spark":
        return f"(SELECT symbol, ts, feature, x FROM ({b}) b LATERAL VIEW stack({len(names)}, {', '.join(f"'{n}', {n}" for n in names)}) u AS feature, x)"
    return "(" + " UNION ALL ".join(f"SELECT symbol, ts, '{n}' AS feature, {n} AS x FROM ({b}) b" for n in names) + ")"


def _by_order(run: Run) -> DataFrame:
    found = unit_root.unit_root_by_order(run(f"SELECT * FROM {_levels(Spark())} l"), ["symbol", "feature"], "ts", "x", ORDERS, threshold=THRESHOLD)
    return found.withColumn("p", F.expr(unit_root.tau_p_sql("adf_stat", normal_cdf)))


def unit_root_by_order(run: Run) -> DataFrame:
    """The statistic of each series differenced 0, 0.05, ... 1 times, and what is left of the series itself."""
    return _by_order(run).selectExpr("symbol", "feature", "d", "n_obs", "round(corr_with_original, 6) + 0D AS corr_with_original", "round(adf_stat, 5) + 0D AS adf_stat", "round(p, 5) + 0D AS p_value")


def minimum_difference_order(run: Run, significance: float = 0.05) -> DataFrame:
    """The smallest order, from 0.05 on, whose differenced series passes; 1 where none does."""
    return _by_order(run).groupBy("symbol", "feature").agg(F.coalesce(F.min(F.when((F.col("p") <= significance) & (F.col("d") > 0), F.col("d"))), F.lit(1.0)).alias("min_d"))


def unit_root_tests(run: Run) -> DataFrame:
    """Each series as it is, with lags chosen by the information criterion."""
    found = unit_root.unit_root_tests(run(f"SELECT * FROM {_levels(Spark())} l"), ["symbol", "feature"], "ts", "x")
    return found.selectExpr("symbol", "feature", "n_obs", "lags", "round(statistic, 5) + 0D AS statistic", "round(p_value, 5) + 0D AS p_value", "stationary")


def _by_order_sql() -> str:
    """Filters as dot products of lists; the regression by taking the last difference out of both sides first."""
    series_ = f"xs AS MATERIALIZED (SELECT symbol, feature, list(x ORDER BY ts) AS xs, count(*) AS n FROM {_levels(Duck())} l WHERE x IS NOT NULL GROUP BY symbol, feature)"
    taps = f"SELECT d, k + 1, -w * (d - k) / (k + 1) FROM taps WHERE abs(w * (d - k) / (k + 1)) >= {THRESHOLD} AND k + 1 < 10000"
    weights = f"taps(d, k, w) AS (SELECT unnest({ORDERS!r})::DOUBLE, 0, 1e0 UNION ALL {taps}), ws AS MATERIALIZED (SELECT d, list(w ORDER BY k) AS ws FROM taps GROUP BY d)"
    fits = "pairs AS (SELECT symbol, feature, n, xs, d, least(len(ws), n) AS width, list_reverse(ws[:least(len(ws), n)]) AS rs FROM xs, ws)"
    y = "ys AS MATERIALIZED (SELECT symbol, feature, d, t, xs[t] AS x, list_dot_product(xs[t - width + 1:t], rs) AS y FROM (SELECT *, unnest(range(width, n + 1)) AS t FROM pairs) p)"
    over = "OVER (PARTITION BY symbol, feature, d ORDER BY t)"
    steps = f"steps AS (SELECT *, lag(y) {over} AS a, y - lag(y) {over} AS q, lag(y) {over} - lag(y, 2) {over} AS p FROM ys)"
    use = "SELECT * FROM steps WHERE p IS NOT NULL"
    lines = f"lines AS MATERIALIZED (SELECT symbol, feature, d, count(*) AS m, regr_slope(q, p) AS q1, regr_intercept(q, p) AS q0, regr_slope(a, p) AS a1, regr_intercept(a, p) AS a0 FROM ({use}) GROUP BY ALL)"
    rest = f"rest AS MATERIALIZED (SELECT u.symbol, u.feature, u.d, m, q - q0 - q1 * p AS q, a - a0 - a1 * p AS a FROM ({use}) u JOIN lines l USING (symbol, feature, d))"
    betas = "betas AS MATERIALIZED (SELECT symbol, feature, d, max(m) AS m, sum(a * q) / sum(a * a) AS b, sum(a * a) AS aa FROM rest GROUP BY symbol, feature, d)"
    stats = "stats AS (SELECT symbol, feature, d, max(b) / sqrt(sum(power(q - b * a, 2)) / (max(betas.m) - 3) / max(aa)) AS adf_stat FROM rest JOIN betas USING (symbol, feature, d) GROUP BY symbol, feature, d)"
    all_ = "sums AS (SELECT symbol, feature, d, count(*) AS n_obs, corr(x, y) AS corr_with_original FROM ys GROUP BY symbol, feature, d HAVING count(*) >= 20)"
    tested = f"tested AS (SELECT symbol, feature, d, n_obs, corr_with_original, adf_stat, {unit_root.tau_p_sql('adf_stat', normal_cdf)} AS p FROM sums JOIN stats USING (symbol, feature, d))"
    return f"WITH RECURSIVE {series_}, {weights}, {fits}, {y}, {steps}, {lines}, {rest}, {betas}, {stats}, {all_}, {tested}"


FRAMES["unit_root_by_order"] = (unit_root_by_order, f"{_by_order_sql()} SELECT symbol, feature, d, n_obs, round(corr_with_original, 6) + 0e0 AS corr_with_original, round(adf_stat, 5) + 0e0 AS adf_stat, round(p, 5) + 0e0 AS p_value FROM tested")
FRAMES["minimum_difference_order"] = (minimum_difference_order, f"{_by_order_sql()} SELECT symbol, feature, coalesce(min(CASE WHEN p <= 0.05 AND d > 0 THEN d END), 1e0) AS min_d FROM tested GROUP BY symbol, feature")


FRAMES["unit_root_tests"] = (unit_root_tests, "")

# ---- clusters of features ------------------------------------------------------------------------------------------------------

WIDE = "momentum_1 momentum_3 momentum_5 momentum_10 span span_5 body position volume activity trend reversal".split()


def _wide(d: Dialect) -> str:
    """Bars with a dozen features, several of them near each other; the last value known, 0 before the first."""
    values = {
        **{f"momentum_{n}": f"c / {d.lag('c', n)} - 1" for n in (1, 3, 5, 10)}, "span": "(h - l) / c", "span_5": f"{d.w('avg', '(h - l) / c', -4, 0)}", "body": "(c - o) / o", "position": "CASE WHEN h > l THEN (c - l) / (h - l) END",
        "volume": "ln(1 + v)", "activity": f"v / {d.w('avg', 'v', -20, -1)}", "trend": f"c / {d.w('avg', 'c', -9, 0)} - 1", "reversal": f"{d.lag('c')} / c - 1",
    }
    raw = f"SELECT symbol, ts, {', '.join(f'{v} AS {n}' for n, v in values.items())} FROM {bars(d)} b"
    return f"(SELECT symbol, ts, {', '.join(f'coalesce({d.last(n)}, 0e0) AS {n}' for n in WIDE)} FROM ({raw}) r)"


#: Average distance 1 - |correlation| up to which features are one cluster.
NEAR = 0.7


def _clusters(run: Run) -> DataFrame:
    return clusters.feature_clusters(run(f"SELECT * FROM {_wide(Spark())} w"), ["symbol"], WIDE, NEAR)


def feature_clusters(run: Run) -> DataFrame:
    return _clusters(run).selectExpr("symbol", "feature", "cluster", "members", "representative", "round(loading, 6) + 0D AS loading", "round(explained, 6) + 0D AS explained")


def eigen_features(run: Run) -> DataFrame:
    """First component of each cluster on each bar, named after its representative."""
    found = clusters.eigen_features(run(f"SELECT * FROM {_wide(Spark())} w"), ["symbol"], "ts", WIDE, _clusters(run))
    return found.selectExpr("symbol", "ts", "feature", "round(value, 6) + 0D AS value")


def feature_pruning(run: Run) -> DataFrame:
    """Of each cluster the feature whose correlation with the next return is furthest from 0."""
    wide = run(f"SELECT w.*, y.y FROM {_wide(Spark())} w JOIN ({_ahead(Spark())}) y ON y.symbol = w.symbol AND y.ts = w.ts")
    scores = clusters.pair_moments(wide, ["symbol"], [*WIDE, "y"]).filter(f"j = {len(WIDE)} AND i < j")
    scores = scores.select("symbol", F.get(F.array(*(F.lit(n) for n in WIDE)), "i").alias("feature"), F.coalesce("r", F.lit(0.0)).alias("score"))
    return clusters.best_of_clusters(_clusters(run), ["symbol"], scores).selectExpr("symbol", "cluster", "feature", "round(score, 6) + 0D AS score", "members")


def _ahead(d: Dialect) -> str:
    return f"SELECT symbol, ts, {d.lead('c')} / c - 1 AS y FROM {bars(d)} b"


def _clusters_sql() -> str:
    """Pairs by a join; the nearest two clusters merge in every step; components by squaring the covariance until one direction is left."""
    d = Duck()
    long = f"long AS MATERIALIZED (SELECT symbol, ts, feature, x FROM {_wide(d)} w UNPIVOT (x FOR feature IN ({', '.join(WIDE)})))"
    place = "CASE feature " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(WIDE)) + " END"
    rows = f"rows_ AS MATERIALIZED (SELECT *, {place} AS i FROM long)"
    pairs = "pairs AS MATERIALIZED (SELECT a.symbol, a.i AS i, b.i AS j, covar_pop(a.x, b.x) AS cov, CASE WHEN stddev_pop(a.x) * stddev_pop(b.x) > 1e-14 THEN covar_pop(a.x, b.x) / (stddev_pop(a.x) * stddev_pop(b.x)) ELSE 0e0 END AS r FROM rows_ a JOIN rows_ b ON a.symbol = b.symbol AND a.ts = b.ts GROUP BY a.symbol, a.i, b.i)"
    dist = "dist AS MATERIALIZED (SELECT symbol, i, j, CASE WHEN i = j THEN 0e0 ELSE greatest(0e0, 1 - abs(r)) END AS d FROM pairs)"
    start = "SELECT symbol, list(i ORDER BY i) AS label, true AS more FROM (SELECT DISTINCT symbol, i FROM pairs) p GROUP BY symbol"
    near = "SELECT t.symbol, t.label, t.label[q.i + 1] AS a, t.label[q.j + 1] AS b, avg(q.d) AS d FROM tree t JOIN dist q ON q.symbol = t.symbol WHERE t.more AND t.label[q.i + 1] < t.label[q.j + 1] GROUP BY ALL"
    best = f"SELECT symbol, any_value(label) AS label, arg_min(a, (d, a, b)) AS a, arg_min(b, (d, a, b)) AS b, min(d) AS d FROM ({near}) n GROUP BY symbol"
    tree = f"tree AS ({start} UNION ALL SELECT symbol, CASE WHEN d <= {NEAR} THEN list_transform(label, lambda x: CASE WHEN x = b THEN a ELSE x END) ELSE label END, d <= {NEAR} FROM ({best}) m)"
    last = "last_ AS MATERIALIZED (SELECT symbol, label FROM tree QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY len(list_distinct(label)), more) = 1)"
    flat = "flat AS MATERIALIZED (SELECT symbol, unnest(range(len(label))) AS i, unnest(label) AS cluster FROM last_)"
    near_ = "reps AS MATERIALIZED (SELECT f.symbol, f.cluster, f.i, count(*) AS members, row_number() OVER (PARTITION BY f.symbol, f.cluster ORDER BY round(avg(q.d), 12), f.i) = 1 AS representative FROM flat f JOIN flat g ON g.symbol = f.symbol AND g.cluster = f.cluster JOIN dist q ON q.symbol = f.symbol AND q.i = f.i AND q.j = g.i GROUP BY f.symbol, f.cluster, f.i)"
    inside = "inside AS MATERIALIZED (SELECT q.symbol, f.cluster, q.i, q.j, q.cov, sum(CASE WHEN q.i = q.j THEN q.cov END) OVER (PARTITION BY q.symbol, f.cluster) AS trace FROM pairs q JOIN flat f ON f.symbol = q.symbol AND f.i = q.i JOIN flat g ON g.symbol = q.symbol AND g.i = q.j AND g.cluster = f.cluster)"
    powers = ["p0 AS MATERIALIZED (SELECT symbol, cluster, i, j, CASE WHEN trace > 0 THEN cov / trace ELSE cov END AS v FROM inside)"]
    for k in range(1, 13):
        square = f"SELECT a.symbol, a.cluster, a.i, b.j, sum(a.v * b.v) AS v FROM p{k - 1} a JOIN p{k - 1} b ON b.symbol = a.symbol AND b.cluster = a.cluster AND b.i = a.j GROUP BY a.symbol, a.cluster, a.i, b.j"
        powers.append(f"p{k} AS MATERIALIZED (SELECT symbol, cluster, i, j, v / nullif(sum(CASE WHEN i = j THEN v END) OVER (PARTITION BY symbol, cluster), 0) AS v FROM ({square}) s)")
    # What is left is the product of the loadings; its column through the largest one gives them.
    lead = "lead_ AS (SELECT symbol, cluster, arg_max(i, v) AS at, max(v) AS top FROM p12 WHERE i = j GROUP BY symbol, cluster), loads AS MATERIALIZED (SELECT p.symbol, p.cluster, p.i, p.v / sqrt(top) AS loading FROM p12 p JOIN lead_ l ON l.symbol = p.symbol AND l.cluster = p.cluster AND p.j = l.at)"
    share = "shares AS (SELECT n.symbol, n.cluster, sum(a.loading * n.cov * b.loading) / max(n.trace) AS explained FROM inside n JOIN loads a ON a.symbol = n.symbol AND a.i = n.i JOIN loads b ON b.symbol = n.symbol AND b.i = n.j GROUP BY n.symbol, n.cluster)"
    names = "[" + ", ".join(f"'{n}'" for n in WIDE) + "]"
    found = f"found AS MATERIALIZED (SELECT r.symbol, r.i, {names}[r.i + 1] AS feature, r.cluster, r.members, r.representative, CASE WHEN members > 1 THEN loading ELSE 1e0 END AS loading, CASE WHEN members > 1 THEN explained ELSE 1e0 END AS explained FROM reps r LEFT JOIN loads l ON l.symbol = r.symbol AND l.i = r.i LEFT JOIN shares s ON s.symbol = r.symbol AND s.cluster = r.cluster)"
    return f"WITH RECURSIVE {long}, {rows}, {pairs}, {dist}, {tree}, {last}, {flat}, {near_}, {inside}, {', '.join(powers)}, {lead}, {share}, {found}"


FRAMES["feature_clusters"] = (feature_clusters, f"{_clusters_sql()} SELECT symbol, feature, cluster::INT AS cluster, members::INT AS members, representative, round(loading, 6) + 0e0 AS loading, round(explained, 6) + 0e0 AS explained FROM found")
_SCORES = "SELECT f.symbol, f.cluster, f.feature, f.members, CASE WHEN stddev_pop(CASE WHEN y IS NOT NULL THEN x END) * stddev_pop(y) > 1e-14 THEN covar_pop(x, y) / (stddev_pop(CASE WHEN y IS NOT NULL THEN x END) * stddev_pop(y)) ELSE 0e0 END AS score FROM found f JOIN rows_ r ON r.symbol = f.symbol AND r.i = f.i JOIN ahead a ON a.symbol = r.symbol AND a.ts = r.ts GROUP BY ALL"
FRAMES["feature_pruning"] = (
    feature_pruning,
    f"{_clusters_sql()}, ahead AS ({_ahead(Duck())}), scores AS ({_SCORES}) SELECT symbol, cluster::INT AS cluster, feature, round(score, 6) + 0e0 AS score, members::INT AS members FROM scores QUALIFY row_number() OVER (PARTITION BY symbol, cluster ORDER BY abs(score) DESC, feature) = 1",
)
_MEANS = "means AS (SELECT symbol, i, avg(x) AS mean FROM rows_ GROUP BY symbol, i)"
FRAMES["eigen_features"] = (
    eigen_features,
    f"{_clusters_sql()}, {_MEANS} SELECT r.symbol, r.ts, any_value(CASE WHEN f.representative THEN f.feature END) AS feature, round(sum(f.loading * (r.x - CASE WHEN f.members > 1 THEN m.mean ELSE 0e0 END)), 6) + 0e0 AS value "
    "FROM rows_ r JOIN found f ON f.symbol = r.symbol AND f.i = r.i JOIN means m ON m.symbol = r.symbol AND m.i = r.i GROUP BY r.symbol, r.ts, f.cluster",
)

# ---- bars from minute rows, in two runs ------------------------------------------------------------------------------------------

#: Rows of a series that the first parameters come from, and where the first of two runs ends.
CALIBRATION_ROWS, FIRST_RUN = 100, "2024-01-17 00:00:00"
#: The tables' prices jump and their volumes are small: bounds of targets are wider than those of the kinds.
MINUTE_KINDS = {
    "dollar": replace(minute_bars.KINDS["dollar"], bounds=(10.0, 1e9)), "volume": replace(minute_bars.KINDS["volume"], bounds=(1.0, 5e7)), "volatility": replace(minute_bars.KINDS["volatility"], bounds=(1e-4, 1e4)),
    "range": minute_bars.KINDS["range"], "renko": replace(minute_bars.KINDS["renko"], bounds=(1e-4, 1e4)), "hybrid": replace(minute_bars.KINDS["hybrid"], bounds=(10.0, 1e9), second=(1e-6, 1e4)),
}
_MINUTE_NUMBERS = "open high low close volume bar_size target path duration_minutes bar_return price_range close_position".split()


def _minutes(d: Dialect) -> str:
    """Rows of a quarter of an hour, which is as fine as the ticks are."""
    at = "to_timestamp(floor(epoch(ts) / 900) * 900)::TIMESTAMP" if d.name == "duckdb" else "CAST(timestamp_seconds(floor(unix_timestamp(CAST(ts AS TIMESTAMP)) / 900) * 900) AS TIMESTAMP_NTZ)"
    return f"(SELECT symbol, {at} AS ts, {d.first_by('price', 'trade_id')} AS o, max(price) AS h, min(price) AS l, {d.last_by('price', 'trade_id')} AS c, sum(quantity) AS v FROM {ticks()} t GROUP BY symbol, {at})"


def _minute_bars(kind: str):
    spec = MINUTE_KINDS[kind]

    def query(run: Run) -> DataFrame:
        """Calibration, a run up to the middle of the month, a run from the state that it left."""
        rows = run(f"SELECT * FROM {_minutes(Spark())} m")
        begun = minute_bars.minute_bars(rows.filter(f"ts < timestamp_ntz'{FIRST_RUN}'"), kind, minute_bars.calibrated(rows, kind, CALIBRATION_ROWS, spec), spec)
        rest = minute_bars.minute_bars(rows, kind, begun.filter("state IS NOT NULL").select("symbol", "state"), spec)
        return begun.unionByName(rest).filter("state IS NULL").selectExpr("symbol", "datetime_start", "datetime_end", *[f"round({n}, 5) + 0D AS {n}" for n in _MINUTE_NUMBERS], "tick_count")

    return query


def _minute_bars_sql(kind: str) -> str:
    """One run: the open bar and all parameters carried from row to row."""
    k, m = MINUTE_KINDS[kind], minute_bars
    rows = f"rows_ AS MATERIALIZED (SELECT *, epoch(ts) / 60 AS mt, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, coalesce(abs(c / lag(c) OVER (PARTITION BY symbol ORDER BY ts) - 1), 0e0) AS moved FROM {_minutes(Duck())} q WHERE least(o, h, l, c) > 0)"
    size = {"dollar": "sum(c * v)", "volume": "sum(v)", "volatility": "sum(moved)", "range": "sum((h - l) / c)", "renko": "(max(h) - min(l)) / quantile_cont(c, 0.5)", "hybrid": "sum(c * v)"}[kind]
    days = f"days AS (SELECT symbol, CAST(ts AS DATE) AS day, {size} AS size, sum(moved) AS path, count(*) AS n, max(ts) AS last, arg_max(c, ts) AS close FROM rows_ WHERE k <= {CALIBRATION_ROWS} GROUP BY ALL)"
    clip = lambda x, b: f"greatest({b[0]!r}, least({b[1]!r}, {x}))"
    second = clip(f"quantile_cont(path, 0.5) / {k.per_day}", k.second) if k.second else "0e0"
    zero = "start o h l v size path n from_".split()
    first = (
        f"SELECT symbol, CAST(least({CALIBRATION_ROWS}, sum(n)) AS BIGINT) AS k, false AS done, {', '.join(f'0e0 AS {z}' for z in zero)}, arg_max(close, last) AS lc, {clip(f'quantile_cont(size, 0.5) / {k.per_day}', k.bounds)}::DOUBLE AS target, {second}::DOUBLE AS second, 0.15::DOUBLE AS alpha, "
        f"{k.per_day}::DOUBLE AS per_day, {m.MIN_MINUTES}::DOUBLE AS mn, greatest(60e0, least({k.longest}, floor(avg(n) / {k.per_day} * 3)))::DOUBLE AS mx, 0 AS closed, 0 AS monitored, 0 AS since, CAST([] AS DOUBLE[]) AS history, CAST([] AS DOUBLE[]) AS sizes, CAST([] AS DOUBLE[]) AS mins, "
        "CAST(NULL AS INT) AS event, 0e0 AS c, 0e0 AS minutes, 0e0 AS was, false AS running FROM days GROUP BY symbol"
    )
    keep = "a.alpha, a.per_day, a.mn, a.mx, a.closed, a.monitored, a.since, a.history, a.sizes, a.mins, a.event, a.target, a.second"
    moved = "CASE WHEN a.lc > 0 THEN abs(r.c - a.lc) / a.lc ELSE 0e0 END"
    grown = {"dollar": "r.c * r.v", "hybrid": "r.c * r.v", "volume": "r.v", "range": "(r.h - r.l) / r.c", "volatility": moved}.get(kind)
    was = "CASE WHEN a.running THEN a.{0} ELSE 0e0 END"
    sized = f"{was.format('size')} + {grown}" if grown else "abs(r.c - CASE WHEN a.running THEN a.from_ ELSE r.o END) / CASE WHEN a.running THEN a.from_ ELSE r.o END"
    path = f"{was.format('path')} + {moved}" if kind in ("volatility", "hybrid") else "0e0"
    x = (
        f"SELECT r.symbol, r.k, r.mt, r.c, CASE WHEN a.running THEN a.start ELSE r.mt END AS start, CASE WHEN a.running THEN a.o ELSE r.o END AS o, CASE WHEN a.running THEN greatest(a.h, r.h) ELSE r.h END AS h, CASE WHEN a.running THEN least(a.l, r.l) ELSE r.l END AS l, "
        f"{was.format('v')} + r.v AS v, {sized} AS size, {path} AS path, {was.format('n')} + 1 AS n, CASE WHEN a.running THEN a.from_ ELSE r.o END AS from_, {'r.c' if kind in ('volatility', 'hybrid') else 'a.lc'} AS lc, {keep} FROM acc a JOIN rows_ r ON r.symbol = a.symbol AND r.k = a.k + 1"
    )
    full = "size >= target" + (" OR path >= second" if k.second else "")
    extreme = f" OR size >= {k.extreme} * target AND mt - start >= mn / 2" if k.extreme != float("inf") else ""
    x = f"SELECT *, mt - start AS minutes, target AS was, (({full}) AND mt - start >= mn) OR mt - start >= mx{extreme} AS done FROM ({x})"
    seen = "least(size, 2 * target)" if k.capped else "size"
    if k.second:
        learned = "CASE WHEN done AND size >= 0.99 * target THEN (1 - alpha) * target + alpha * least(size, 2 * target) ELSE target END AS t1, CASE WHEN done AND path >= 0.99 * second THEN (1 - alpha) * second + alpha * least(path, 2 * second) ELSE second END AS s1"
    else:
        learned = f"CASE WHEN done THEN (1 - alpha) * target + alpha * {seen} ELSE target END AS t1, second AS s1"
    x = f"SELECT *, {learned}, closed + done::INT AS closed1, monitored + done::INT AS mon1, since + done::INT AS since1, CASE WHEN done THEN list_append(sizes[-{m.RECENT - 1}:], size) ELSE sizes END AS sizes1, CASE WHEN done THEN list_append(mins[-{m.RECENT - 1}:], floor(minutes)) ELSE mins END AS mins1 FROM ({x})"
    x = f"SELECT *, done AND mon1 >= {m.MONITOR_EVERY} AS look, CASE WHEN done AND mon1 >= {m.MONITOR_EVERY} THEN list_append(history[-{m.HISTORY - 1}:], t1) ELSE history END AS history1, done AND since1 >= {m.OPTIMISE_EVERY} AND (event IS NULL OR closed1 - event >= {m.COOLDOWN}) AND len(sizes1) >= {m.RECENT} AS tune FROM ({x})"
    x = f"SELECT *, CASE WHEN look AND len(history1) >= 5 THEN 0.05 + 0.3 * least(1e0, list_stddev_pop(history1) / list_avg(history1) / 0.8) END AS fresh, list_aggregate(CASE WHEN tune THEN sizes1 END, 'quantile_cont', 0.25) AS q1, list_aggregate(CASE WHEN tune THEN sizes1 END, 'quantile_cont', 0.75) AS q3 FROM ({x})"
    within = lambda reach: f"list_filter(sizes1, lambda z: q3 <= q1 OR (z >= q1 - {reach} * (q3 - q1) AND z <= q3 + {reach} * (q3 - q1)))"
    x = f"SELECT *, CASE WHEN tune THEN CASE WHEN len({within(1.5)}) >= 0.7 * len(sizes1) THEN {within(1.5)} ELSE {within(2.5)} END END AS kept, CASE WHEN tune THEN list_stddev_pop(mins1) / list_avg(mins1) END AS mcv FROM ({x})"
    x = f"SELECT *, CASE WHEN list_avg(kept) > 0 THEN list_stddev_pop(kept) / list_avg(kept) END AS scv FROM ({x})"
    even = f"CASE WHEN scv IS NULL THEN 0.5 WHEN scv <= {m.EVEN_SIZES} THEN 1 WHEN scv <= {m.FAIR_SIZES} THEN 1 - 0.3 * (scv - {m.EVEN_SIZES}) / {m.FAIR_SIZES - m.EVEN_SIZES!r} ELSE greatest(0e0, 0.7 - 0.7 * (scv - {m.FAIR_SIZES}) / 0.6) END"
    pace = f"CASE WHEN mcv IS NULL OR mcv = 0 THEN 0.5 WHEN mcv < {m.EVEN_MINUTES[0]} THEN mcv / {m.EVEN_MINUTES[0]} WHEN mcv <= {m.EVEN_MINUTES[1]} THEN 1 ELSE greatest(0e0, 1 - (mcv - {m.EVEN_MINUTES[1]}) / 0.8) END"
    x = f"SELECT *, {even} AS even, {pace} AS pace FROM ({x})"
    x = f"SELECT *, coalesce(tune AND 0.6 * even + 0.4 * pace < 0.5 AND even < 0.4, false) AS grow, coalesce(tune AND 0.6 * even + 0.4 * pace < 0.5 AND pace < 0.4, false) AS slow, least({m.PER_DAY_BOUNDS[1]}, per_day * 1.1) AS more FROM ({x})"
    bigger = "least(t1 * 1.15, t1 + 10000)" if k.grow == "size" else "t1 * per_day / more"
    new = [
        f"CASE WHEN done THEN {clip(f'CASE WHEN grow THEN {bigger} ELSE t1 END', k.bounds)} ELSE target END AS target", (f"CASE WHEN done THEN {clip('CASE WHEN grow THEN s1 * per_day / more ELSE s1 END', k.second)} ELSE second END" if k.second else "second") + " AS second",
        "CASE WHEN abs(fresh - alpha) > 0.01 THEN fresh ELSE alpha END AS alpha", "per_day" + (" AS per_day" if k.grow == "size" else "" ), f"CASE WHEN slow AND {k.later} > 0 THEN least(mn + {k.later}, {k.latest}) ELSE mn END AS mn", "mx", "closed1 AS closed",
        "CASE WHEN look THEN 0 ELSE mon1 END AS monitored", f"CASE WHEN done AND since1 >= {m.OPTIMISE_EVERY} THEN 0 ELSE since1 END AS since", "history1 AS history", "sizes1 AS sizes", "mins1 AS mins", "CASE WHEN tune THEN closed1 ELSE event END AS event", "c", "minutes", "was", "NOT done AS running",
    ]
    if k.grow != "size":
        new[3] = "CASE WHEN grow THEN more ELSE per_day END AS per_day"
    step = f"SELECT symbol, k, done, {', '.join(zero)}, lc, {', '.join(new)} FROM ({x})"
    values = ("o", "h", "l", "c", "v", "size", "was", "path", "minutes", "c / o - 1", "(h - l) / o", "CASE WHEN h > l THEN (c - l) / (h - l) ELSE 0.5 END")
    at = lambda z: f"make_timestamp(CAST(round(({z}) * 60) AS BIGINT) * 1000000)"
    out = ", ".join(f"round({v}, 5) + 0e0 AS {n}" for v, n in zip(values, _MINUTE_NUMBERS, strict=True))
    return f"WITH RECURSIVE {rows}, {days}, acc AS ({first} UNION ALL {step}) SELECT symbol, {at('start')} AS datetime_start, {at('start + minutes')} AS datetime_end, {out}, n::BIGINT AS tick_count FROM acc WHERE done"


for _kind in MINUTE_KINDS:
    FRAMES[f"minute_bars_{_kind}"] = (_minute_bars(_kind), _minute_bars_sql(_kind))

# ---- Granger causality -----------------------------------------------------------------------------------------------------------

GRANGER_LAGS = 5
CAUSES = tuple(n for n in WIDE if n != "momentum_1")


def _paired(d: Dialect) -> str:
    """A row per bar and feature, with the bar's own return as the target."""
    if d.name == "spark":
        return f"(SELECT symbol, ts, momentum_1 AS y, feature, f FROM {_wide(d)} w LATERAL VIEW stack({len(CAUSES)}, {', '.join(f"'{n}', {n}" for n in CAUSES)}) u AS feature, f)"
    return "(" + " UNION ALL ".join(f"SELECT symbol, ts, momentum_1 AS y, '{n}' AS feature, {n} AS f FROM {_wide(d)} w" for n in CAUSES) + ")"


def granger_causality(run: Run) -> DataFrame:
    found = granger.granger_tests(run(f"SELECT * FROM {_paired(Spark())} p"), ["symbol", "feature"], "ts", "y", "f", GRANGER_LAGS)
    return found.selectExpr("symbol", "feature", "lag", "n_obs", "round(f_stat, 4) + 0D AS f_stat", "round(p_value, 5) + 0D AS p_value")


def granger_scores(run: Run) -> DataFrame:
    found = granger.granger_tests(run(f"SELECT * FROM {_paired(Spark())} p"), ["symbol", "feature"], "ts", "y", "f", GRANGER_LAGS)
    return granger.granger_scores(found, ["symbol", "feature"]).selectExpr("symbol", "feature", "round(score, 3) + 0D AS score")


def _granger_sql() -> str:
    """Residuals column after column, own lags before the feature's; the tail of F by the power series of the incomplete beta function."""
    n, by = GRANGER_LAGS, "symbol, feature"
    over = f"OVER (PARTITION BY {by} ORDER BY ts)"
    lagged = ", ".join([f"lag(y, {j}) {over} AS y{j}" for j in range(1, n + 1)] + [f"lag(f, {j}) {over} AS f{j}" for j in range(1, n + 1)])
    parts = [f"lagged AS MATERIALIZED (SELECT {by}, y, {lagged}, row_number() {over} AS k FROM {_paired(Duck())} p)"]
    for lag in range(1, n + 1):
        cols = [f"y{j}" for j in range(1, lag + 1)] + [f"f{j}" for j in range(1, lag + 1)]
        parts.append(f"g{lag}_0 AS MATERIALIZED (SELECT {by}, {', '.join(f'{c} - avg({c}) OVER (PARTITION BY {by}) AS {c}' for c in ['y', *cols])} FROM lagged WHERE k > {lag})")
        for i, c in enumerate(cols):
            rest = ["y", *cols[i + 1 :]]
            slope = lambda z, c=c: f"{z} - coalesce(sum({z} * {c}) OVER (PARTITION BY {by}) / nullif(sum({c} * {c}) OVER (PARTITION BY {by}), 0), 0) * {c} AS {z}"
            parts.append(f"g{lag}_{i + 1} AS MATERIALIZED (SELECT {by}, {', '.join(map(slope, rest))} FROM g{lag}_{i})")
        own, both = (f"(SELECT {by}, count(*) AS m, sum(y * y) AS rss FROM g{lag}_{k} GROUP BY {by})" for k in (lag, 2 * lag))
        parts.append(f"t{lag} AS (SELECT a.symbol, a.feature, {lag} AS lag, a.m AS n_obs, a.m - {2 * lag + 1} AS free, (a.rss - b.rss) / b.rss / {lag} * (a.m - {2 * lag + 1}) AS f_stat FROM {own} a JOIN {both} b USING (symbol, feature))")
    tests = " UNION ALL ".join(f"SELECT * FROM t{lag}" for lag in range(1, n + 1))
    # I_x(a, b) from its series where x is small against a / (a + b), else from that of the other end.
    ends = "SELECT *, free / 2e0 AS a0, lag / 2e0 AS b0, free / (free + lag * f_stat) AS x0 FROM tests"
    sides = f"SELECT *, x0 > (a0 + 1) / (a0 + b0 + 2) AS flip FROM ({ends})"
    args = f"args AS MATERIALIZED (SELECT *, CASE WHEN flip THEN b0 ELSE a0 END AS a, CASE WHEN flip THEN a0 ELSE b0 END AS b, CASE WHEN flip THEN 1 - x0 ELSE x0 END AS x FROM ({sides}))"
    series_ = "terms(symbol, feature, lag, i, term, total) AS (SELECT symbol, feature, lag, 0, 1e0, 1e0 FROM args UNION ALL SELECT t.symbol, t.feature, t.lag, i + 1, term * x * (a + b + i) / (a + 1 + i), total + term * x * (a + b + i) / (a + 1 + i) FROM terms t JOIN args g USING (symbol, feature, lag) WHERE term > total * 1e-17 AND i < 20000)"
    value = "exp(a * ln(x) + b * ln(1 - x) + lgamma(a + b) - lgamma(a) - lgamma(b)) / a * s"
    done = f"done AS MATERIALIZED (SELECT g.symbol, g.feature, g.lag, n_obs, f_stat, CASE WHEN f_stat <= 0 THEN 1e0 WHEN flip THEN 1 - {value} ELSE {value} END AS p FROM args g JOIN (SELECT symbol, feature, lag, max(total) AS s FROM terms GROUP BY ALL) t USING (symbol, feature, lag))"
    return f"WITH RECURSIVE {', '.join(parts)}, tests AS MATERIALIZED ({tests}), {args}, {series_}, {done}"


FRAMES["granger_causality"] = (granger_causality, f"{_granger_sql()} SELECT symbol, feature, lag, n_obs, round(f_stat, 4) + 0e0 AS f_stat, round(p, 5) + 0e0 AS p_value FROM done")
FRAMES["granger_scores"] = (granger_scores, f"{_granger_sql()} SELECT symbol, feature, round(coalesce(-log10(greatest(min(p), 1e-300)), 0e0), 3) + 0e0 AS score FROM done GROUP BY symbol, feature")

# ---- normal scores of trailing ranks, residuals --------------------------------------------------------------------------------------

TRAIL = 100


def trailing_normal_scores(run: Run) -> DataFrame:
    """Three features among their last hundred values: share and, from it, the normal score."""
    names = ("momentum_3", "volume", "position")
    found = transforms.trailing_normal(run(f"SELECT * FROM {_wide(Spark())} w"), ["symbol"], ["ts"], list(names), TRAIL)
    return found.selectExpr("symbol", "ts", *(x for n in names for x in (f"round({n}_share, 6) + 0D AS {n}_share", f"round({_score(f'{n}_share')}, 5) + 0D AS {n}_score")))


def _score(p: str) -> str:
    return f"(CASE WHEN {p} <= {transforms.EDGE!r} THEN -{transforms.LIMIT!r} WHEN {p} >= {1 - transforms.EDGE!r} THEN {transforms.LIMIT!r} ELSE {normal_ppf(p)} END)"


def _trailing_sql() -> str:
    names = ("momentum_3", "volume", "position")
    lists = f"SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, {', '.join(f'{n}, list({n}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {TRAIL} PRECEDING AND 1 PRECEDING) AS w_{n}' for n in names)} FROM {_wide(Duck())} w"
    below, upto = "len(list_filter(w_{n}, lambda z: z < {n}))", "len(list_filter(w_{n}, lambda z: z <= {n}))"
    share = (
        "CASE WHEN k <= {m} THEN NULL WHEN {n} - {e} < list_min(w_{n}) THEN 0e0 WHEN {n} + {e} > list_max(w_{n}) THEN 1e0 WHEN {u} > {b} THEN ({b} + {u} - 1) / 2e0 / {last} "
        "ELSE ({b} - 1 + ({n} - list_max(list_filter(w_{n}, lambda z: z < {n}))) / (list_min(list_filter(w_{n}, lambda z: z > {n})) - list_max(list_filter(w_{n}, lambda z: z < {n})))) / {last} END AS p_{n}"
    )
    shares = ", ".join(share.format(n=n, m=TRAIL, e=transforms.EDGE, b=below.format(n=n), u=upto.format(n=n), last=f"{TRAIL - 1}e0") for n in names)
    out = ", ".join(f"round(p_{n}, 6) + 0e0 AS {n}_share, round({_score(f'p_{n}')}, 5) + 0e0 AS {n}_score" for n in names)
    return f"SELECT symbol, ts, {out} FROM (SELECT symbol, ts, {shares} FROM ({lists}) l) s"


FRAMES["trailing_normal_scores"] = (trailing_normal_scores, _trailing_sql())


def feature_neutralisation(run: Run) -> DataFrame:
    """Four features without what the bar's return and its trend explain."""
    out = transforms.neutralised(run(f"SELECT * FROM {_wide(Spark())} w"), ["symbol"], ["span", "volume", "position", "reversal"], ["momentum_1", "trend"])
    return out.selectExpr("symbol", "ts", *(f"round({n}, 6) + 0D AS {n}" for n in ("span", "volume", "position", "reversal")))


def _neutral_sql() -> str:
    names, over = ("span", "volume", "position", "reversal"), "OVER (PARTITION BY symbol)"
    # The trend is made orthogonal to the return, then both are taken out one after the other.
    two = f"SELECT *, trend - sum(trend * momentum_1) {over} / sum(momentum_1 * momentum_1) {over} * momentum_1 AS q, count(*) {over} AS n FROM {_wide(Duck())} w"
    value = "CASE WHEN n < 50 THEN {0} ELSE {0} - sum({0} * momentum_1) OVER (PARTITION BY symbol) / sum(momentum_1 * momentum_1) OVER (PARTITION BY symbol) * momentum_1 - sum({0} * q) OVER (PARTITION BY symbol) / sum(q * q) OVER (PARTITION BY symbol) * q END"
    return f"SELECT symbol, ts, {', '.join(f'round({value.format(n)}, 6) + 0e0 AS {n}' for n in names)} FROM ({two}) t"


FRAMES["feature_neutralisation"] = (feature_neutralisation, _neutral_sql())

# ---- training on purged folds ------------------------------------------------------------------------------------------------------

TRADE_FEATURES = ["log_size", "long", "priority", "weekday", "month"]


def _trades(d: Dialect) -> str:
    """Closed trades with what was known when they were entered, and whether they paid."""
    return (
        f"(SELECT id, {d.hours_between("TIMESTAMP '1990-01-01 00:00:00'", 'CAST(entry_datetime AS TIMESTAMP)')} / 24 AS entered, ln(size) AS log_size, CASE WHEN direction = 'Long' THEN 1e0 ELSE 0e0 END AS long, CAST(substr(regime, 1, 1) AS DOUBLE) AS priority, "
        f"CAST({d.weekday('entry_datetime')} AS DOUBLE) AS weekday, CAST(month(entry_datetime) AS DOUBLE) AS month, CASE WHEN trade_return_pct > 0 THEN 1 ELSE -1 END AS label FROM {ledger()} t)"
    )


def _frequency_model(d: Dialect) -> str:
    """Out-of-sample predictions of every fold of both methods by the labels' frequencies among like training trades (one more of each label)."""
    if d.name == "spark":
        # The folds' rows bring the features along; of frequencies there are a few per fold, which go to every task.
        own = "CAST(substr(regime, 1, 1) AS DOUBLE) AS priority, CASE WHEN direction = 'Long' THEN 1e0 ELSE 0e0 END AS long, CASE WHEN trade_return_pct > 0 THEN 1 ELSE -1 END AS label"
        rows = f"(SELECT 'walk_forward' AS method, fold AS f1, 0 AS f2, id, role, {own} FROM {_walk_forward(d)} a UNION ALL SELECT 'combinatorial' AS method, g1 AS f1, g2 AS f2, id, role, {own} FROM {_combinatorial(d)} b)"
        known = f"SELECT method AS m, f1 AS k1, f2 AS k2, priority AS p, long AS l, sum(CASE WHEN role = 'train' AND label = 1 THEN 1 ELSE 0 END) + 1e0 AS up, sum(CASE WHEN role = 'train' THEN 1 ELSE 0 END) + 2e0 AS n FROM {rows} r GROUP BY method, f1, f2, priority, long"
        return (
            f"(SELECT /*+ BROADCAST(k) */ r.method, r.f1, r.f2, r.id, r.label AS y_true, CASE WHEN k.up / k.n > 0.5 THEN 1 ELSE -1 END AS y_pred, 1 - k.up / k.n AS prob_m1, 0e0 AS prob_0, k.up / k.n AS prob_p1 FROM {rows} r "
            f"JOIN ({known}) k ON k.m = r.method AND k.k1 = r.f1 AND k.k2 = r.f2 AND k.p <=> r.priority AND k.l = r.long WHERE r.role = 'test')"
        )
    folds = f"(SELECT 'walk_forward' AS method, fold AS f1, 0 AS f2, id, role FROM {_walk_forward(d)} a UNION ALL SELECT 'combinatorial' AS method, g1 AS f1, g2 AS f2, id, role FROM {_combinatorial(d)} b)"
    rows = f"SELECT f.method, f.f1, f.f2, f.id, f.role, t.priority, t.long, t.label FROM {folds} f JOIN {_trades(d)} t ON t.id = f.id"
    known = f"SELECT method, f1, f2, priority, long, sum(CASE WHEN role = 'train' AND label = 1 THEN 1 ELSE 0 END) + 1e0 AS up, sum(CASE WHEN role = 'train' THEN 1 ELSE 0 END) + 2e0 AS n FROM ({rows}) r GROUP BY method, f1, f2, priority, long"
    return (
        f"(SELECT r.method, r.f1, r.f2, r.id, r.label AS y_true, CASE WHEN k.up / k.n > 0.5 THEN 1 ELSE -1 END AS y_pred, 1 - k.up / k.n AS prob_m1, 0e0 AS prob_0, k.up / k.n AS prob_p1 FROM ({rows}) r "
        "JOIN ({known}) k ON k.method = r.method AND k.f1 = r.f1 AND k.f2 = r.f2 AND k.priority = r.priority AND k.long = r.long WHERE r.role = 'test')".replace("{known}", known)
    )


def cv_fold_metrics(run: Run) -> DataFrame:
    found = learning.fold_metrics(run(f"SELECT * FROM {_frequency_model(Spark())} p"), ["method", "f1", "f2"])
    return found.selectExpr("method", "f1", "f2", "n", *(f"round({x}, 6) + 0D AS {x}" for x in ("accuracy", "f1_weighted", "log_loss", "auc")))


def _metrics_sql() -> str:
    """F1 of each label apart; the area by mean ranks."""
    by = "method, f1, f2"
    p = f"p AS MATERIALIZED (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY prob_p1) + (count(*) OVER (PARTITION BY {by}, prob_p1) - 1) / 2e0 AS r FROM {_frequency_model(Duck())} q)"
    f1 = lambda y: f"coalesce(2e0 * sum((y_true = {y} AND y_pred = {y})::INT) / nullif(sum((y_true = {y})::INT) + sum((y_pred = {y})::INT), 0), 0) * sum((y_true = {y})::INT)"
    pos, neg = "sum((y_true = 1)::INT)", "sum((y_true <> 1)::INT)"
    auc = f"CASE WHEN {pos} > 0 AND {neg} > 0 THEN (sum(CASE WHEN y_true = 1 THEN r END) - {pos} * ({pos} + 1) / 2e0) / ({pos} * {neg}) END"
    out = {"accuracy": "avg((y_true = y_pred)::INT)", "f1_weighted": f"({f1(-1)} + {f1(1)}) / count(*)", "log_loss": "avg(-ln(greatest(1e-15, CASE WHEN y_true = 1 THEN prob_p1 ELSE prob_m1 END)))", "auc": auc}
    return f"WITH {p} SELECT {by}, count(*) AS n, {', '.join(f'round({v}, 6) + 0e0 AS {k}' for k, v in out.items())} FROM p GROUP BY {by}"


FRAMES["cv_fold_metrics"] = (cv_fold_metrics, _metrics_sql())


def _small_forest():
    return learning.forest(TRADE_FEATURES, trees=16, depth=5, leaf=5)


def purged_forest_metrics(run: Run) -> DataFrame:
    """Calibrated forests, one for each walk-forward fold, trained on what purging and embargo leave: metrics of the test trades."""
    rows, folds = run(f"SELECT * FROM {_trades(Spark())} t"), run(f"SELECT fold, id, role FROM {_walk_forward(Spark())} f")
    predicted, _ = learning.train_on_folds(rows, folds, "fold", TRADE_FEATURES, "label", "entered", make=_small_forest)
    return learning.fold_metrics(predicted)


def forest_importances(run: Run) -> DataFrame:
    """Of a calibrated forest on all trades: mean decrease of impurity, and how much accuracy falls when a feature is dealt out anew."""
    rows = staged(run(f"SELECT * FROM {_trades(Spark())} t"))
    model = learning.Calibrated.fit(_small_forest, learning.balanced(rows, "label", None), "entered")
    falls = learning.permutation_importance(model, rows, TRADE_FEATURES, "label", repeats=2)
    impurity = F.create_map(*(x for k, v in model.importances(TRADE_FEATURES).items() for x in (F.lit(k), F.lit(v))))
    return falls.select("feature", impurity[F.col("feature")].alias("impurity"), "importance", "deviation")


FRAMES["purged_forest_metrics"] = (purged_forest_metrics, "")
FRAMES["forest_importances"] = (forest_importances, "")


# ---- labels by barriers of any width -----------------------------------------------------------------------------------------------


def _barriers(d: Dialect, width: str, up: float, down: float, horizon: int) -> str:
    """1 or -1 by which of c + up x width, c - down x width a later close reaches first among ``horizon``; 0 for neither, without a width and in the last bars."""
    tr = f"greatest(h - l, coalesce(abs(h - {d.lag('c')}), 0e0), coalesce(abs(l - {d.lag('c')}), 0e0))"
    rows = f"SELECT symbol, ts, c, row_number() OVER ({d.over}) AS k, count(*) OVER (PARTITION BY symbol) AS n, {tr} AS tr FROM {bars(d)} b"
    wide = f"SELECT symbol, ts, c, k, n, {width.format(atr=f'CASE WHEN k >= 14 THEN {d.w('avg', 'tr', -13, 0)} END')} AS width FROM ({rows}) r"
    if d.name == "duckdb":
        ends = f"SELECT a.symbol, a.ts, a.k, a.n, min(CASE WHEN b.c >= a.c + {up} * a.width THEN b.k END) AS hi, min(CASE WHEN b.c <= a.c - {down} * a.width THEN b.k END) AS lo FROM w a LEFT JOIN w b ON b.symbol = a.symbol AND b.k > a.k AND b.k <= a.k + {horizon} GROUP BY a.symbol, a.ts, a.k, a.n"
        return f"WITH w AS MATERIALIZED ({wide}) SELECT symbol, ts, CASE WHEN k > n - {horizon} OR coalesce(hi, lo) IS NULL THEN 0 WHEN lo IS NULL OR hi < lo THEN 1 WHEN hi IS NULL OR lo < hi THEN -1 ELSE 0 END AS label FROM ({ends}) e"
    ahead = f"SELECT *, {d.list('c', 1, horizon)} AS ahead FROM ({wide}) w"
    # One walk over the closes ahead: the first that reaches either.
    first = f"aggregate(ahead, 0, (s, x) -> CASE WHEN s <> 0 THEN s WHEN x >= c + {up} * width AND x <= c - {down} * width THEN 2 WHEN x >= c + {up} * width THEN 1 WHEN x <= c - {down} * width THEN -1 ELSE 0 END)"
    return f"SELECT symbol, ts, CASE WHEN k > n - {horizon} OR width IS NULL THEN 0 ELSE {first} % 2 END AS label FROM ({ahead}) a"


@series
def labels_triple_barrier_atr(d, up: float = 2.0, down: float = 1.0, horizon: int = 20):
    """Profit at two average true ranges, stop at one, within twenty bars."""
    return _barriers(d, "{atr}", up, down, horizon)


@series
def labels_triple_barrier_percent(d, up: float = 2.0, down: float = 1.0, horizon: int = 20, base: float = 0.01):
    """Profit at two percent, stop at one, within twenty bars."""
    return _barriers(d, f"c * {base}", up, down, horizon)


# ---- relevance without redundancy ----------------------------------------------------------------------------------------------------

CHOSEN = 5


def feature_relevance_redundancy(run: Run) -> DataFrame:
    """The first five features by F value of the next return over mean correlation with those chosen before."""
    wide = run(f"SELECT w.*, y.y FROM {_wide(Spark())} w JOIN ({_ahead(Spark())}) y ON y.symbol = w.symbol AND y.ts = w.ts WHERE y.y IS NOT NULL")
    return clusters.max_relevance(wide, ["symbol"], WIDE, "y", CHOSEN).selectExpr("symbol", "place", "feature", "round(relevance, 5) + 0D AS relevance", "round(score, 4) + 0D AS score")


def _relevance_sql() -> str:
    """The chosen ones in a list that grows by one in every step."""
    d = Duck()
    long = f"long AS MATERIALIZED (SELECT w.symbol, w.ts, w.feature, w.x, a.y FROM (SELECT * FROM {_wide(d)} q UNPIVOT (x FOR feature IN ({', '.join(WIDE)}))) w JOIN ({_ahead(d)}) a ON a.symbol = w.symbol AND a.ts = w.ts WHERE a.y IS NOT NULL)"
    r = "CASE WHEN stddev_pop({0}) * stddev_pop({1}) > 1e-14 THEN covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1})) ELSE 0e0 END"
    place = "[" + ", ".join(f"'{n}'" for n in WIDE) + "]"
    own = f"own AS MATERIALIZED (SELECT symbol, feature, list_position({place}, feature) AS i, power(r, 2) / (1 - power(r, 2)) * (n - 2) AS f FROM (SELECT symbol, feature, count(*) AS n, {r.format('x', 'y')} AS r FROM long GROUP BY symbol, feature) z)"
    pairs = f"pairs AS MATERIALIZED (SELECT a.symbol, a.feature AS f1, b.feature AS f2, greatest(abs({r.format('a.x', 'b.x')}), 0.001) AS r FROM long a JOIN long b ON b.symbol = a.symbol AND b.ts = a.ts GROUP BY a.symbol, a.feature, b.feature)"
    start = "SELECT symbol, CAST([] AS VARCHAR[]) AS chosen, CAST(NULL AS VARCHAR) AS feature, CAST(NULL AS DOUBLE) AS relevance, CAST(NULL AS DOUBLE) AS score FROM own GROUP BY symbol"
    rated = "SELECT p.symbol, p.chosen, o.feature, o.f, o.i, o.f / coalesce(avg(q.r), 1) AS score FROM picked p JOIN own o ON o.symbol = p.symbol AND NOT list_contains(p.chosen, o.feature) LEFT JOIN pairs q ON q.symbol = p.symbol AND q.f1 = o.feature AND list_contains(p.chosen, q.f2) GROUP BY p.symbol, p.chosen, o.feature, o.f, o.i"
    step = f"SELECT symbol, list_append(any_value(chosen), arg_max(feature, (score, -i))), arg_max(feature, (score, -i)), arg_max(f, (score, -i)), max(score) FROM ({rated}) z WHERE len(chosen) < {CHOSEN} GROUP BY symbol"
    return f"WITH RECURSIVE {long}, {own}, {pairs}, picked AS ({start} UNION ALL {step}) SELECT symbol, len(chosen)::INT AS place, feature, round(relevance, 5) + 0e0 AS relevance, round(score, 4) + 0e0 AS score FROM picked WHERE len(chosen) > 0"


FRAMES["feature_relevance_redundancy"] = (feature_relevance_redundancy, _relevance_sql())

# ---- scalers that are fitted before and then stay ------------------------------------------------------------------------------------

FIT_UNTIL = "2024-01-20 00:00:00"
SCALED = {"volume": "standard", "span": "minmax", "position": "robust", "momentum_3": "signed_log", "activity": "standard_log"}


def scalers_frozen(run: Run) -> DataFrame:
    """Scalers of five features, fitted to the bars up to a day, on the bars after it."""
    rows = run(f"SELECT * FROM {_wide(Spark())} w")
    until = f"timestamp_ntz'{FIT_UNTIL}'"
    table = transforms.fit_scalers(rows.filter(f"ts < {until}"), ["symbol"], SCALED)
    return transforms.apply_scalers(rows.filter(f"ts >= {until}"), ["symbol"], table, SCALED).selectExpr("symbol", "ts", *(f"round({n}, 5) + 0D AS {n}" for n in SCALED))


def _scalers_sql() -> str:
    log = "sign({0}) * ln(1 + abs({0}))"
    before = f"SELECT * FROM w WHERE ts < TIMESTAMP '{FIT_UNTIL}'"
    q = lambda x, p: f"quantile_cont({x}, {p})"
    fit = f"SELECT symbol, avg(volume) AS vm, stddev_pop(volume) AS vs, min(span) AS lo, max(span) AS hi, {q('position', 0.5)} AS med, {q('position', 0.75)} - {q('position', 0.25)} AS iqr, avg({log.format('activity')}) AS am, stddev_pop({log.format('activity')}) AS sd FROM ({before}) b GROUP BY symbol"
    return f"WITH w AS MATERIALIZED (SELECT * FROM {_wide(Duck())} x) SELECT symbol, ts, round((volume - vm) / CASE WHEN vs > 0 THEN vs ELSE 1 END, 5) + 0e0 AS volume, round((span - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 5) + 0e0 AS span, round((position - med) / CASE WHEN iqr > 0 THEN iqr ELSE 1 END, 5) + 0e0 AS position, round({log.format('momentum_3')}, 5) + 0e0 AS momentum_3, round(({log.format('activity')} - am) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 5) + 0e0 AS activity FROM w JOIN ({fit}) f USING (symbol) WHERE ts >= TIMESTAMP '{FIT_UNTIL}'"


FRAMES["scalers_frozen"] = (scalers_frozen, _scalers_sql())

# ---- mutual information by nearest neighbours --------------------------------------------------------------------------------------

INFORMED = ("momentum_3", "span", "volume")


def _informing(d: Dialect) -> str:
    """A row per bar and feature with the next return; features as they are, without bars before the first value."""
    rows = f"SELECT w.symbol, w.ts, {', '.join('w.' + n for n in INFORMED)}, y.y, row_number() OVER (PARTITION BY w.symbol ORDER BY w.ts) AS k FROM {_wide(d)} w JOIN ({_ahead(d)}) y ON y.symbol = w.symbol AND y.ts = w.ts"
    if d.name == "spark":
        return f"(SELECT symbol, k, feature, f, y FROM ({rows}) r LATERAL VIEW stack({len(INFORMED)}, {', '.join(f"'{n}', {n}" for n in INFORMED)}) u AS feature, f WHERE y IS NOT NULL AND k > 10)"
    return "(" + " UNION ALL ".join(f"SELECT symbol, k, '{n}' AS feature, {n} AS f, y FROM ({rows}) r WHERE y IS NOT NULL AND k > 10" for n in INFORMED) + ")"


def feature_neighbour_information(run: Run) -> DataFrame:
    found = neighbours.mutual_information(run(f"SELECT * FROM {_informing(Spark())} i"), ["symbol", "feature"], "k", "f", "y", parts=4)
    return found.selectExpr("symbol", "feature", "n", "round(mutual_information, 5) + 0D AS mutual_information")


def _neighbour_sql(k: int = 3) -> str:
    """Every pair of points; harmonic numbers for the logarithmic derivative."""
    p = f"p AS MATERIALIZED (SELECT symbol, feature, k, f / stddev_pop(f) OVER w AS x, y / stddev_pop(y) OVER w AS y, count(*) OVER w AS n FROM {_informing(Duck())} i WINDOW w AS (PARTITION BY symbol, feature))"
    pairs = "pairs AS MATERIALIZED (SELECT a.symbol, a.feature, a.k, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM p a JOIN p b ON b.symbol = a.symbol AND b.feature = a.feature AND b.k <> a.k)"
    radius = f"radius AS MATERIALIZED (SELECT symbol, feature, k, list_sort(list(greatest(dx, dy)))[{k}] AS r FROM pairs GROUP BY symbol, feature, k)"
    counts = "counts AS (SELECT symbol, feature, k, sum((dx < r)::INT) AS nx, sum((dy < r)::INT) AS ny FROM pairs JOIN radius USING (symbol, feature, k) GROUP BY symbol, feature, k)"
    psi = "psi AS MATERIALIZED (SELECT i AS m, -0.5772156649015329 + coalesce(sum(1e0 / i) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS v FROM (SELECT unnest(range(1, (SELECT max(n) + 2 FROM p))) AS i))"
    return f"WITH {p}, {pairs}, {radius}, {counts}, {psi}, sizes AS (SELECT symbol, feature, max(n) AS n FROM p GROUP BY symbol, feature) SELECT symbol, feature, n, round(greatest(0e0, (SELECT v FROM psi WHERE m = n) + (SELECT v FROM psi WHERE m = {k}) - t), 5) + 0e0 AS mutual_information FROM sizes JOIN (SELECT symbol, feature, avg(a.v + b.v) AS t FROM counts c JOIN psi a ON a.m = c.nx + 1 JOIN psi b ON b.m = c.ny + 1 GROUP BY symbol, feature) q USING (symbol, feature)"


FRAMES["feature_neighbour_information"] = (feature_neighbour_information, _neighbour_sql())
