"""Queries whose plans must hold at any size, and values beyond what a double holds."""

import math
import re

import duckdb
import pandas as pd
import pytest

from tidewright.operators import montecarlo
from tidewright.plans.dialect import Spark
from tidewright.plans.registry import ORACLES, QUERIES
from tidewright.plans.series import SERIES, STEPS

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def large(spark):
    """Tables count as too large to be broadcast, as they are at size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["cv_combinatorial", "cv_walk_forward", "cv_combined_scores", "deflated_sharpe", "cv_fold_metrics"])
def test_folds_without_cartesian_product(large, name):
    assert "CartesianProduct" not in QUERIES[name](large, SMALL)._jdf.queryExecution().executedPlan().toString()


def tables(folder, days, discount):
    """One trade a day, of a return of 100 x ``discount`` percent."""
    day = pd.date_range("2020-01-01", periods=days).astype("datetime64[us]")
    orders = pd.DataFrame({"o_orderkey": range(days), "o_custkey": 1, "o_orderstatus": "F", "o_totalprice": 100.0, "o_orderdate": day, "o_orderpriority": "1-URGENT"})
    items = pd.DataFrame({"l_orderkey": range(days), "l_discount": discount, "l_tax": 0.0, "l_shipdate": day + pd.Timedelta(days=1)})
    for name, frame in (("orders", orders), ("lineitem", items)):
        frame.to_parquet(folder / f"{name}.parquet", coerce_timestamps="us")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def same(a, b):
    return a is b is None or a == b or (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-9)


def test_drawdown_of_infinite_windows_is_undefined(spark, tmp_path):
    con = tables(tmp_path, 120, [1e10 + (i % 7) * 1e9 for i in range(120)])
    want = con.execute(ORACLES["portfolio_time_series"]).fetchone()
    got = QUERIES["portfolio_time_series"](spark, str(tmp_path)).first()
    assert math.isnan(want[6]) and all(same(float(x) if x is not None else None, float(y) if y is not None else None) for x, y in zip(got, want, strict=True))


def test_streaks_count_within_days(spark, tmp_path):
    """No window runs over all rows of a direction; runs go on over days, also when several trades share one."""
    text = SERIES["ledger_streaks"](Spark())
    assert "BY entry_datetime, id" not in text
    con = tables(tmp_path, 300, [0.1 if (i * i // 7) % 3 else -0.1 for i in range(300)])
    frame = pd.read_parquet(tmp_path / "orders.parquet")
    frame["o_orderdate"] = frame["o_orderdate"].where(frame.index % 4 != 3, frame["o_orderdate"] - pd.Timedelta(days=1))
    frame.to_parquet(tmp_path / "orders.parquet", coerce_timestamps="us")
    want = sorted(con.execute(ORACLES["ledger_streaks"]).fetchall())
    assert sorted(map(tuple, QUERIES["ledger_streaks"](spark, str(tmp_path)).collect())) == want and len(want) == 2


def test_weights_sort_no_ledger_in_one_task(spark):
    """The prices known on a day are found per day: the sort of prices sees no trades."""
    assert "{raw_weights}" in SERIES["weights_return"](Spark())
    assert "id FROM {closed}" not in STEPS["raw_weights"](Spark()) and "id FROM (SELECT o_orderkey" not in STEPS["raw_weights"](Spark())


@pytest.mark.parametrize("gain", [0.0, 400.0])
def test_paths_in_stretches(spark, gain):
    """Against one running sum per path; with gains the equity leaves the range of doubles."""
    n, paths = 3000, 3
    r = {i: gain + ((i * 7919) % 401 - 200) * 0.9 for i in range(n)}
    got = {x["path"]: x for x in montecarlo.resampled_paths(spark.createDataFrame(list(r.items()), "id long, r double"), "r", paths=paths, method="shuffle").collect()}
    p = montecarlo.PRIME
    for path in range(1, paths + 1):
        first = lambda i: (i * 48271 + 11) % p
        place = lambda i: (((first(i) ** 2 + path * 69621 + 43) % p) ** 2 + first(i)) % p
        total, top, fall = 0.0, 1.0, 0.0
        for i in sorted(r, key=lambda i: (place(i), i)):
            total += math.log1p(r[i] / 10_000)
            equity = math.exp(total) if total < 709.78 else math.inf
            top = max(top, equity)
            fall = min(fall, 0.0 if math.isinf(equity) else equity / top - 1)
        x = got[path]
        assert abs(x["max_drawdown"] - fall) < 1e-9 and (math.isclose(x["final"], math.exp(total), rel_tol=1e-9) if total < 709 else True)


def test_paths_sort_no_whole_path(spark):
    plan = montecarlo.resampled_paths(spark.range(10).selectExpr("id", "1D AS r"), "r")._jdf.queryExecution().optimizedPlan().toString()
    assert set(re.findall(r"windowspecdefinition\(path#\d+, (\w+)#", plan)) == {"stretch"}


def one_by_one(r, path, draws):
    """``final, max_drawdown`` of a path by one running sum over its trades in order; missing returns change nothing."""
    p = montecarlo.PRIME
    first = {i: int(math.fmod(i * 48271 + 11, p)) for i in r}

    def hashed(i, salt):
        return ((first[i] ** 2 + path * 69621 + 42 + salt) % p) ** 2 + first[i]

    total, top, fall = 0.0, 1.0, 0.0
    for i in sorted(r, key=lambda i: (int(math.fmod(hashed(i, 1), p)), i)):
        u, cdf = math.fmod(hashed(i, 0), p) / p, [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(6)]
        total += math.log1p((r[i] or 0.0) / 10_000) * (sum(u >= e for e in cdf) if draws else 1)
        equity = math.exp(total) if total < 709.78 else math.inf
        fall = min(fall, 0.0 if math.isinf(equity) else equity / max(top, equity) - 1)
        top = max(top, equity)
    return math.exp(total) if total < 709.78 else math.inf, fall


@pytest.mark.parametrize("method", ["bootstrap", "shuffle"])
@pytest.mark.parametrize("gain", [0.0, 4000.0])
def test_paths_of_many_stretches(spark, monkeypatch, method, gain):
    """Pairs of trades that share a place (their ids are a prime apart), ids below 0, missing returns, equity beyond doubles; stretches of a few trades."""
    monkeypatch.setattr(montecarlo, "STRETCH", 64)
    ids = [*range(-200, 2000), *range(montecarlo.PRIME, montecarlo.PRIME + 1000)]
    r = {i: None if i % 13 == 0 else gain + ((k * 7919) % 4001 - 2000) * 4.0 for k, i in enumerate(ids)}
    got = {x["path"]: x for x in montecarlo.resampled_paths(spark.createDataFrame(list(r.items()), "id long, r double"), "r", paths=4, method=method).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    for path, x in got.items():
        final, fall = one_by_one(r, path, method == "bootstrap")
        assert math.isclose(x["final"], final, rel_tol=1e-9) and math.isclose(x["max_drawdown"], fall, rel_tol=1e-9) and x["total_return"] == x["final"] - 1
    assert all(math.isinf(x["final"]) == (gain > 0) for x in got.values())


def test_paths_without_known_returns(spark):
    got = montecarlo.resampled_paths(spark.range(50).selectExpr("id", "CAST(NULL AS DOUBLE) AS r"), "r", paths=2).collect()
    assert sorted(x["path"] for x in got) == [1, 2] and all(x["final"] is None and x["max_drawdown"] is None and x["total_return"] is None for x in got)
    assert montecarlo.resampled_paths(spark.range(0).selectExpr("id", "1D AS r"), "r").collect() == []


def test_paths_shuffle_packed_trades(spark):
    """No row for each trade of each path goes through Spark's sort: trades are packed by path and stretch before the shuffle."""
    trades = spark.range(20_000).selectExpr("id", "1D AS r")
    paths = montecarlo.resampled_paths(trades, "r", paths=20)
    assert len(paths.collect()) == 20
    plan = paths._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
    most, stack = 0, [paths._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        if node.metrics().contains("shuffleRecordsWritten"):
            most = max(most, node.metrics().apply("shuffleRecordsWritten").value())
        below = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if node.nodeName().endswith("QueryStage") else []
        children = node.children()
        stack += below + [children.apply(i) for i in range(children.size())]
    assert 0 < most <= 20 * 4 * 2


def test_paths_that_lose_everything(spark):
    """An equity below the smallest double is 0, a fall of all; a stretch that begins there has no peak of its own."""
    got = montecarlo.resampled_paths(spark.range(300).selectExpr("id", "-9999.9D AS r"), "r", paths=2).collect()
    assert [(x["final"], x["max_drawdown"], x["total_return"]) for x in got] == [(0.0, -1.0, -1.0)] * 2
