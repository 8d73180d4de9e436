"""Bootstrap, unit roots, clusters, resumed regimes and minute bars: by definition, and in any number of runs."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.operators import bootstrap, clusters, minute_bars, regimes, unit_root
from tidewright.streaming import regimes as regime_streams

# ---- sequential bootstrap ------------------------------------------------------------------------------------------------------


def drawn(spans, draws=None, seed=42):
    b = bootstrap.Bootstrap(draws, seed)
    for row in spans:
        b.push(row)
    return b.close()


def uniqueness(spans, chosen, i):
    """Of span i if it were drawn next: mean over its bars of one over the drawn ones and itself."""
    a, z, _ = spans[i]
    return sum(1 / (1 + sum(spans[j][0] <= t <= spans[j][1] for j in chosen)) for t in range(a, z + 1)) / (z - a + 1)


def test_draws_follow_their_probabilities():
    spans = [(0, 4, "a"), (1, 2, "b"), (2, 9, "c"), (9, 9, "d"), (30, 33, "e")]
    n, seconds, firsts = 4000, Counter(), Counter()
    for seed in range(n):
        out = drawn(spans, 2, seed * 7919)
        firsts[out[0][1]] += 1
        seconds[out[0][1], out[1][1]] += 1
    names = [s[2] for s in spans]
    p0 = np.array([uniqueness(spans, [], i) for i in range(5)])
    p0 /= p0.sum()
    for i, a in enumerate(names):
        assert abs(firsts[a] - n * p0[i]) < 4.5 * math.sqrt(n * p0[i])
        p1 = np.array([uniqueness(spans, [i], j) for j in range(5)])
        p1 /= p1.sum()
        for j, b in enumerate(names):
            want = n * p0[i] * p1[j]
            assert abs(seconds[a, b] - want) < 4.5 * math.sqrt(want)


def test_uniqueness_of_draws_and_blocks():
    rng = random.Random(1)
    spans = sorted((s := rng.randrange(3000), s + rng.choice([0, 1, 5, 200]), i) for i in range(120))
    out = drawn(spans)
    place = {i: k for k, (_, _, i) in enumerate(spans)}
    chosen = []
    for k, event, a, z, u in out[:40]:
        i = place[event]
        assert (a, z) == spans[i][:2] and abs(u - uniqueness(spans, chosen, i)) < 1e-12 and k == len(chosen) + 1
        chosen.append(i)
    assert len(out) == len(spans) and out == drawn(spans)


def test_many_events_without_a_matrix():
    rng = np.random.default_rng(0)
    start = np.sort(rng.integers(0, 100_000, 100_000))
    out = drawn([(int(s), int(s) + int(n), i) for i, (s, n) in enumerate(zip(start, rng.integers(0, 48, len(start)), strict=True))], 20_000)
    assert len(out) == 20_000 and len({r[1] for r in out}) > 15_000


def test_bootstrap_leaves_out_what_is_no_span(spark):
    rows = [("a", 1, 0, 3), ("a", 2, None, 3), ("a", 3, 5, 4), ("b", 4, 2, None), ("a", 5, 9, 9)]
    got = bootstrap.sequential_bootstrap(spark.createDataFrame(rows, "symbol string, event long, start long, stop long"), ["symbol"], "event").collect()
    assert len(got) == 2 and {r["event"] for r in got} <= {1, 5} and [r["draw"] for r in got] == [1, 2]
    assert bootstrap.sequential_bootstrap(spark.createDataFrame([], "symbol string, event long, start long, stop long"), ["symbol"], "event").count() == 0


# ---- unit roots --------------------------------------------------------------------------------------------------------------


def adf_by_definition(y, lags):
    step = np.diff(y)
    t = np.arange(lags, len(step))
    x = np.column_stack([np.ones(len(t)), y[t], *(step[t - j] for j in range(1, lags + 1))])
    q = step[t]
    beta, *_ = np.linalg.lstsq(x, q, rcond=None)
    rss = ((q - x @ beta) ** 2).sum()
    return beta[1] / math.sqrt(rss / (len(t) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1]), rss, len(t)


@pytest.fixture(scope="module")
def walks(spark):
    rng = np.random.default_rng(2)
    out, begin = {}, datetime(2024, 1, 1)
    out["walk"] = np.cumsum(rng.standard_normal(700)) + 50
    out["noise"] = rng.standard_normal(400)
    out["slow"] = np.zeros(500)
    for i in range(1, 500):
        out["slow"][i] = 0.9 * out["slow"][i - 1] + rng.standard_normal()
    out["seasonal"] = np.sin(np.arange(300) / 3) + 0.1 * np.cumsum(rng.standard_normal(300))
    out["short"], out["flat"] = np.arange(8.0), np.full(60, 3.0)
    rows = [(s, begin + timedelta(hours=7 * i), float(v)) for s, x in out.items() for i, v in enumerate(x)] + [("walk", datetime(2023, 1, 1), None)]
    return out, spark.createDataFrame(rows, "symbol string, ts timestamp, x double").repartition(3)


@pytest.mark.parametrize("block", [1 << 14, 128])
def test_unit_root_by_order(walks, block):
    series, df = walks
    orders = [0.0, 0.1, 0.4, 0.7, 1.0]
    got = {(r["symbol"], r["d"]): r for r in unit_root.unit_root_by_order(df, ["symbol"], "ts", "x", orders, threshold=1e-3, block=block).collect()}
    seen = 0
    for name, x in series.items():
        for d in orders:
            w = unit_root.difference_weights(d, 1e-3)[: len(x)]
            y = np.array([w @ x[t - len(w) + 1 : t + 1][::-1] for t in range(len(w) - 1, len(x))])
            if len(y) < 20:
                assert (name, d) not in got
                continue
            r = got[name, d]
            assert r["n_obs"] == len(y)
            if name == "flat":
                assert r["adf_stat"] is None and r["corr_with_original"] is None
                continue
            seen += 1
            assert abs(r["adf_stat"] - adf_by_definition(y, 1)[0]) < 1e-6 * max(1, abs(r["adf_stat"]))
            assert abs(r["corr_with_original"] - np.corrcoef(x[len(w) - 1 :], y)[0, 1]) < 1e-9
    assert seen > 15


def test_difference_weights():
    assert unit_root.difference_weights(1.0).tolist() == [1.0, -1.0]
    assert np.allclose(unit_root.difference_weights(0.5, 1e-2)[:4], [1, -0.5, -0.125, -0.0625])
    assert len(unit_root.difference_weights(0.3, 1e-9, 100)) == 100


def test_p_values():
    """Critical values of the test: -3.43, -2.86, -2.57 at 1, 5 and 10 %."""
    for tau, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert abs(unit_root.tau_p_value(tau) - p) < 0.002
    assert unit_root.tau_p_value(3.0) == 1.0 and unit_root.tau_p_value(-20) == 0.0 and math.isnan(unit_root.tau_p_value(math.nan))


@pytest.mark.parametrize("lags, block", [(None, 1 << 14), (None, 64), (4, 100)])
def test_lags_by_criterion(walks, lags, block):
    series, df = walks
    got = {r["symbol"]: r for r in unit_root.unit_root_tests(df, ["symbol"], "ts", "x", lags, block=block).collect()}
    assert set(got) == set(series)
    for name, x in series.items():
        r = got[name]
        if name in ("short", "flat"):
            assert r["p_value"] == 1.0 and not r["stationary"] and r["statistic"] is None
            continue
        most = min(unit_root.longest_lag(len(x)), lags if lags is not None else 10**6)
        best = []
        for k in range(most + 1):
            _, rss, m = adf_by_definition(x[most - k :], k)
            best.append((m * (math.log(2 * math.pi) + math.log(rss / m) + 1) + 2 * (k + 2), k))
        lag = min(best)[1]
        stat, _, m = adf_by_definition(x, lag)
        assert (r["lags"], r["n_obs"]) == (lag, m)
        assert abs(r["statistic"] - stat) < 1e-6 * max(1, abs(stat)) and abs(r["p_value"] - unit_root.tau_p_value(stat)) < 1e-6
    assert got["noise"]["stationary"] and not got["walk"]["stationary"]


# ---- clusters ------------------------------------------------------------------------------------------------------------------


def agglomerated(dist, threshold, inclusive):
    """The nearest two clusters merge until none are near enough."""
    groups = [[i] for i in range(len(dist))]
    while len(groups) > 1:
        d, a, b = min((np.mean([dist[i, j] for i in x for j in y]), k, m) for k, x in enumerate(groups) for m, y in enumerate(groups) if k < m)
        if d > threshold or (d == threshold and not inclusive):
            break
        groups[a] += groups.pop(b)
    label = np.zeros(len(dist), int)
    for g in groups:
        label[g] = min(g)
    return label.tolist()


def test_linkage_by_definition():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 25):
        for _ in range(20):
            p = rng.standard_normal((n, 3))
            dist = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
            merges = clusters.average_linkage(dist)
            assert len(merges) == n - 1
            for t in (0.3, 0.8, 1.5, 2.5, 9):
                assert clusters.cut(merges, n, t, True).tolist() == agglomerated(dist, t, True)


def test_threshold_in_or_out():
    dist = np.array([[0, 0.5], [0.5, 0]])
    merges = clusters.average_linkage(dist)
    assert clusters.cut(merges, 2, 0.5, True).tolist() == [0, 0] and clusters.cut(merges, 2, 0.5, False).tolist() == [0, 1]


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(4)
    n = 900
    base = rng.standard_normal((n, 2))
    wide = pd.DataFrame({"a": base[:, 0], "b": base[:, 0] * 2 + 0.2 * rng.standard_normal(n), "c": -base[:, 0] + 0.5 * rng.standard_normal(n) + 1000, "d": base[:, 1], "e": base[:, 1] + 0.1 * rng.standard_normal(n), "f": rng.standard_normal(n), "g": 1.0})
    wide.loc[rng.random(n) < 0.1, "b"] = None
    wide["symbol"], wide["ts"] = np.where(np.arange(n) % 3 == 0, "x", "y"), np.arange(n)
    df = spark.createDataFrame([tuple(None if isinstance(v, float) and v != v else v for v in r) for r in wide.itertuples(index=False)], "a double, b double, c double, d double, e double, f double, g double, symbol string, ts long")
    return wide, df.repartition(5)


NAMES = list("abcdefg")


def test_pair_moments(features):
    wide, df = features
    got = {(r["symbol"], r["i"], r["j"]): r for r in clusters.pair_moments(df, ["symbol"], NAMES).collect()}
    for s, part in wide.groupby("symbol"):
        want = part[NAMES].corr()
        for i, x in enumerate(NAMES):
            for j in range(i, 7):
                r = got[s, i, j]
                both = part[[x, NAMES[j]]].dropna() if i != j else part[[x]].dropna()
                assert r["n"] == len(both)
                if "g" in (x, NAMES[j]):
                    assert r["r"] is None
                else:
                    assert abs(r["r"] - want.loc[x, NAMES[j]]) < 1e-9
                assert abs(r["mean_i"] - both[x].mean()) < 1e-9


def test_feature_clusters_and_components(features):
    wide, df = features
    table = clusters.feature_clusters(df.fillna(0.0), ["symbol"], NAMES, 0.5)
    got = {(r["symbol"], r["feature"]): r for r in table.collect()}
    filled = wide.fillna(0.0)
    values = {(r["symbol"], r["ts"], r["feature"]): r["value"] for r in clusters.eigen_features(df.fillna(0.0), ["symbol"], "ts", NAMES, table).collect()}
    for s, part in filled.groupby("symbol"):
        assert [got[s, f]["cluster"] for f in NAMES] == [0, 0, 0, 3, 3, 5, 6]
        for group in (["a", "b", "c"], ["d", "e"]):
            cov = np.cov(part[group].T.to_numpy(), bias=True)
            e, v = np.linalg.eigh(cov)
            lead = v[:, -1] * np.sign(v[np.abs(v[:, -1]).argmax(), -1])
            assert np.allclose([got[s, f]["loading"] for f in group], lead, atol=1e-8) and abs(got[s, group[0]]["explained"] - e[-1] / e.sum()) < 1e-9
            dist = 1 - part[group].corr().abs()
            name = dist.mean().idxmin()
            assert [f for f in group if got[s, f]["representative"]] == [name]
            score = (part[group] - part[group].mean()).to_numpy() @ lead
            assert np.allclose([values[s, t, name] for t in part["ts"]], score, atol=1e-7)
        assert np.allclose([values[s, t, "f"] for t in part["ts"]], part["f"]) and got[s, "g"]["members"] == 1
    scores = table.select("symbol", "feature", F.when(F.col("feature") == "b", -0.9).when(F.col("feature") == "d", 0.3).otherwise(F.lit(None).cast("double")).alias("score"))
    best = {(r["symbol"], r["cluster"]): r["feature"] for r in clusters.best_of_clusters(table, ["symbol"], scores).collect()}
    assert best == {(s, c): f for s in "xy" for c, f in ((0, "b"), (3, "d"), (5, "f"), (6, "g"))}


# ---- regimes in several runs, as a stream ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in ("one", "two"):
        at, c = datetime(2024, 1, 1), 100.0
        for i in range(420):
            at += timedelta(hours=1 if i != 300 else 40)
            c *= math.exp(0.01 * rng.standard_normal() * (3 if 150 < i < 200 else 1))
            rows.append((s, at, c))
    return rows


SCHEMA = "symbol string, ts timestamp_ntz, c double"


def cells(rows):
    return sorted((r["symbol"], str(r["ts"]), *("null" if (v := r[n]) is None or v != v else round(v, 9) if isinstance(v, float) else v for n in regimes.OUT)) for r in rows)


@pytest.fixture(scope="module")
def whole(spark, bars):
    return cells(regimes.regime_engine(spark.createDataFrame(bars, SCHEMA), by="symbol").collect())


def test_regimes_in_runs(spark, bars, whole):
    """Each run gets all rows; those that were processed are left out."""
    got, states = [], None
    for day in (6, 13, 40):
        part = regimes.regime_update(spark.createDataFrame([r for r in bars if r[1] < datetime(2024, 1, 1) + timedelta(days=day)] * 2, SCHEMA), states).collect()
        got += part
        rows = [(r["symbol"], r["state"]) for r in part if r["state"] is not None]
        assert len(rows) == 2
        states = spark.createDataFrame(rows, "symbol string, state string")
    assert cells(got) == whole
    assert regimes.regime_update(spark.createDataFrame(bars, SCHEMA), states).count() == 0


def test_state_as_text_comes_back():
    a = regimes._State(regimes.RegimeConfig())
    rng = random.Random(1)
    prices = [100 * math.exp(0.02 * rng.gauss(0, 1)) for _ in range(600)]
    for i, c in enumerate(prices[:550]):
        a.step(3600.0 * i, c)
    b = regimes._State.load(a.cfg, a.dump())
    for i, c in enumerate(prices[550:]):
        x, y = a.step(3600.0 * (550 + i), c), b.step(3600.0 * (550 + i), c)
        assert str(x) == str(y)


def test_reset_on_gap(bars):
    """The row of the gap says so, and what follows is what a series that begins there has."""
    cfg = regimes.RegimeConfig(reset_on_gap=True)
    one = [r for r in bars if r[0] == "one"]
    seconds = [r[1].timestamp() for r in one]
    state, fresh = regimes._State(cfg), regimes._State(cfg)
    out = [state.step(t, r[2]) for t, r in zip(seconds, one, strict=True)]
    again = [fresh.step(t, r[2]) for t, r in zip(seconds[300:], one[300:], strict=True)]
    assert out[300][:4] == (regimes.GAP,) * 4 and str(out[301:]) == str(again[1:])


def run_stream(spark, folder, out, checkpoint, states=None, **kw):
    source = spark.readStream.schema("symbol string, ts timestamp, c double").option("maxFilesPerTrigger", 1).parquet(folder)
    query = regime_streams.regime_stream(source, states, **kw).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None


def add(spark, folder, rows):
    spark.createDataFrame(rows, "symbol string, ts timestamp, c double").coalesce(1).write.mode("append").parquet(folder)


def test_stream_equals_batch_across_a_restart(spark, bars, whole, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    regime_streams.use_rocksdb(spark)
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    days = lambda a, b: [r for r in bars if datetime(2024, 1, 1) + timedelta(days=a) <= r[1] < datetime(2024, 1, 1) + timedelta(days=b)]
    try:
        add(spark, folder, days(0, 5))
        add(spark, folder, days(5, 9))
        run_stream(spark, folder, out, checkpoint)
        add(spark, folder, days(7, 14) + days(10, 11))  # some that were processed, some twice
        add(spark, folder, days(14, 40))
        run_stream(spark, folder, out, checkpoint)
        assert cells(spark.read.parquet(out).collect()) == whole
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_stream_takes_a_batch_state_over(spark, bars, whole, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    regime_streams.use_rocksdb(spark)
    try:
        first = regimes.regime_update(spark.createDataFrame([r for r in bars if r[1] < datetime(2024, 1, 10)], SCHEMA)).collect()
        states = spark.createDataFrame([(r["symbol"], r["state"]) for r in first if r["state"] is not None], "symbol string, state string")
        folder, out = str(tmp_path / "in"), str(tmp_path / "out")
        add(spark, folder, bars)
        run_stream(spark, folder, out, str(tmp_path / "checkpoint"), states)
        rest = spark.read.parquet(out).collect()
        assert len(rest) == len(bars) - len(first) and cells([*first, *rest]) == whole
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


# ---- minute bars -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def minutes():
    rng = np.random.default_rng(6)
    rows = []
    for s, scale in (("one", 1.0), ("two", 30.0)):
        c, at = 100.0, datetime(2024, 3, 1)
        for _ in range(6000):
            at += timedelta(minutes=int(rng.integers(1, 4)))
            o, c = c, c * math.exp(0.002 * rng.standard_normal())
            h, low = max(o, c) * (1 + 0.0005 * rng.random()), min(o, c) * (1 - 0.0005 * rng.random())
            rows.append((s, at, o, h, low, c, float(scale * rng.lognormal(3, 1.5))))
    rows[3000] = (*rows[3000][:3], 1.0, *rows[3000][4:])  # high below low
    rows[3010] = (*rows[3010][:5], -1.0, 5.0)
    rows[3020] = (*rows[3020][:5], None, 5.0)
    return rows


MINUTE = "symbol string, ts timestamp_ntz, o double, h double, l double, c double, v double"


@pytest.mark.parametrize("kind", list(minute_bars.KINDS))
def test_minute_bars_in_runs(spark, minutes, kind):
    from dataclasses import replace

    k = minute_bars.KINDS[kind]
    spec = replace(k, per_day=60.0, bounds=(k.bounds[0] / 1000, k.bounds[1]))
    df = spark.createDataFrame(minutes, MINUTE).repartition(3)
    states = minute_bars.calibrated(df, kind, 1000, spec)
    keep = lambda out: spark.createDataFrame([(r["symbol"], r["state"]) for r in out if r["state"] is not None], "symbol string, state string")
    whole_ = minute_bars.minute_bars(df, kind, states, spec).collect()
    parts, now = [], keep(states.collect())
    for day in (2, 4, 5, 30):
        out = minute_bars.minute_bars(df.filter(F.col("ts") < F.lit(datetime(2024, 3, 1) + timedelta(days=day)).cast("timestamp_ntz")), kind, now, spec).collect()
        parts, now = parts + [r for r in out if r["state"] is None], keep(out)
    want = [r for r in whole_ if r["state"] is None]
    assert sorted(map(str, parts)) == sorted(map(str, want)) and len(want) > 100
    assert sorted(map(tuple, now.collect())) == sorted((r["symbol"], r["state"]) for r in whole_ if r["state"] is not None)
    first = {s: [r for r in minutes if r[0] == s][999][1] for s in ("one", "two")}
    assert all(r["datetime_start"] > first[r["symbol"]] for r in want)
    assert all(r["duration_minutes"] >= 2 / (2 if spec.extreme < math.inf else 1) for r in want)


def test_minute_bars_learn_within_bounds():
    rng = random.Random(3)
    spec = minute_bars.KINDS["volume"]
    p = {"target": 2000.0, "second": 0.0, "min_minutes": 2.0, "max_minutes": 60.0, "alpha": 0.15, "alpha_min": 0.05, "alpha_max": 0.35, "per_day": 8.7, "closed": 0, "monitored": 0, "since": 0, "history": [], "events": [], "recent": []}
    m = minute_bars.MinuteBars("volume", spec, p)
    at, closed = datetime(2024, 1, 1), 0
    for _ in range(6000):
        at += timedelta(minutes=rng.choice([1, 1, 1, 30]))
        closed += m.push(at, 10.0, 10.5, 9.5, 10.0, rng.choice([1.0, 50.0, 30_000.0])) is not None
    assert closed == p["closed"] > 900 and p["events"][0] == 200 and p["events"][1] == 600  # every 200 bars, at least 400 apart
    assert len(p["recent"]) == 50 and 1e3 <= p["target"] <= 5e7 and p["alpha"] != 0.15
    p.update(recent=[[1.0, 1.0], [100.0, 1.0]] * 20 + [[1.0, 200.0], [100.0, 200.0]] * 5, target=100_000.0, min_minutes=2.0)
    m._optimise()
    assert p["target"] == 110_000.0 and p["min_minutes"] == 3.0 and p["events"][-1] == p["closed"]
    p.update(target=1e9, min_minutes=99.0, alpha=0.9)
    m._bound()
    assert p["target"] == 5e7 and p["min_minutes"] == 60.0 and p["max_minutes"] == 120.0 and p["alpha"] == 0.35


def test_quality_of_bars():
    assert minute_bars.quality([10.0] * 50, [10.0, 20.0] * 25) == (1.0, 1.0)
    even, pace = minute_bars.quality([1.0, 100.0] * 25, [10.0] * 50)
    assert even < 0.2 and pace == 0.5


def test_minute_bars_without_state_or_rows(spark, minutes):
    df = spark.createDataFrame(minutes[:50], MINUTE)
    none = spark.createDataFrame([], "symbol string, state string")
    assert minute_bars.minute_bars(df, "range", none).count() == 0
    assert minute_bars.calibrated(df.limit(0), "range", 10).count() == 0
