"""Every series query against its twin, and the DataFrame operators on small frames."""

import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.operators import frames, info_bars, recursive, regimes, swings
from tidewright.plans.registry import ORACLES, QUERIES
from tidewright.sources import files
from tidewright.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{float(v) + 0.0:.4f}".replace("-0.0000", "0.0000") if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df = df.assign(**{c: df[c].astype("datetime64[us]").astype(str)})
        elif str(df[c].dtype) != "bool" and df[c].dtype != object:
            df = df.assign(**{c: df[c].astype(float)})
    return sorted(tuple(cell(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twins(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name,hours,op", [("asof_backward", 1, ">="), ("asof_forward", 1, "<="), ("asof_forward_strict", 24, "<")])
def test_asof_of_every_event(spark, duck, name, hours, op):
    closes = ORACLES["ohlcv_1h" if hours == 1 else "ohlcv_1d"]
    sql = f"SELECT e.event_type AS symbol, e.event_id AS id, b.c AS v, CAST(b.ts AS TIMESTAMP) AS bar_ts FROM events e ASOF LEFT JOIN ({closes}) b ON b.symbol = e.event_type AND e.ts {op} b.ts"
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(sql).fetchdf())


def test_asof_clip_of_every_event(spark, duck):
    sql = f"SELECT e.event_type AS symbol, e.event_id AS id, coalesce(b.c, f.v0) AS v FROM events e ASOF LEFT JOIN ({ORACLES['ohlcv_1h']}) b ON b.symbol = e.event_type AND e.ts > b.ts JOIN (SELECT symbol, arg_min(c, ts) AS v0 FROM ({ORACLES['ohlcv_1h']}) GROUP BY symbol) f ON f.symbol = e.event_type"
    assert rows(QUERIES["asof_clip"](spark, SF).toPandas()) == rows(duck.execute(sql).fetchdf())


def test_asof_join_against_brute_force(spark):
    left = spark.createDataFrame([("a", t, i) for i, t in enumerate((1, 3, 3, 7, 0))] + [("b", 5, 9)], "symbol string, ts long, id long")
    right = spark.createDataFrame([("a", 3, 30.0), ("a", 5, 50.0), ("c", 1, 1.0)], "symbol string, ts long, x double")
    back = {r.id: r.x for r in frames.asof_join(left, right, ["x"], ["symbol"]).collect()}
    assert back == {0: None, 1: 30.0, 2: 30.0, 3: 50.0, 4: None, 9: None}
    strict = {r.id: r.x for r in frames.asof_join(left, right, ["x"], ["symbol"], strict=True).collect()}
    assert strict == {0: None, 1: None, 2: None, 3: 50.0, 4: None, 9: None}
    ahead = {r.id: r.x for r in frames.asof_join(left, right, ["x"], ["symbol"], direction="forward").collect()}
    assert ahead == {0: 30.0, 1: 30.0, 2: 30.0, 3: None, 4: 30.0, 9: None}
    later = {r.id: r.x for r in frames.asof_join(left, right, ["x"], ["symbol"], direction="forward", strict=True).collect()}
    assert later == {0: 30.0, 1: 50.0, 2: 50.0, 3: None, 4: 30.0, 9: None}


def test_upserts(spark):
    stored = spark.createDataFrame([(1, "Open", 1.0), (2, "Closed", 2.0)], "id int, status string, x double")
    new = spark.createDataFrame([(1, "Closed", 10.0), (2, "Closed", 20.0), (3, "Open", 30.0)], stored.schema)
    key = lambda df: {r.id: r.x for r in df.collect()}
    assert key(frames.upsert(stored, new, ["id"])) == {1: 10.0, 2: 20.0, 3: 30.0}
    assert key(frames.upsert(stored, new, ["id"], F.col("status") == "Open")) == {1: 10.0, 2: 2.0, 3: 30.0}
    assert key(frames.insert_ignore(stored, new, ["id"])) == {1: 1.0, 2: 2.0, 3: 30.0}
    assert key(frames.delete_where(stored, F.col("id") == 1)) == {2: 2.0}


def test_timeframes():
    assert [frames.timeframe_minutes(x) for x in ("1m", "15m", "4h", "1d", "1w")] == [1, 15, 240, 1440, 10080]
    for bad in ("", "m", "0m", "x5", "5y"):
        with pytest.raises(ValueError):
            frames.timeframe_minutes(bad)


def test_features_see_only_the_past(spark):
    bars = files.make_ohlcv(spark, 260)
    names = ["returns_log", "realized_vol", "sma_20", "var_95", "skewness_60", "max_drawdown", "vol_yang_zhang"]
    whole = {r.ts: r for r in frames.create_features(bars, names).collect()}
    part = frames.create_features(bars.orderBy("ts").limit(180), names).collect()
    for r in part:
        for n in names:
            a, b = r[n], whole[r.ts][n]
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))
    with pytest.raises(KeyError):
        frames.create_features(bars, ["nothing"])
    assert frames.create_features(bars, ["nothing", "sma_20"], on_error="null").filter("nothing IS NOT NULL").count() == 0


def test_scans_are_prefix_invariant_and_span_batches(spark):
    bars = files.make_ohlcv(spark, 400, ("A", "B"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        small = {(r.symbol, r.ts): r.asDict() for r in recursive.recursive_indicators(bars).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    large = {(r.symbol, r.ts): r.asDict() for r in recursive.recursive_indicators(bars).collect()}
    assert len(large) == 800 and str(small) == str({k: large[k] for k in small})
    rsi = [r["rsi_14"] for r in large.values() if r["rsi_14"] is not None]
    assert rsi and all(0 <= x <= 100 for x in rsi)
    labels = {r.regime_label for r in regimes.regime_engine(bars).collect()}
    assert "INSUFFICIENT_DATA" in labels and len(labels) > 1
    assert {r.event for r in swings.market_structure(bars).collect()} >= {"swing_high", "swing_low"}


def test_info_bars_batch_equals_stream(spark, tmp_path):
    ticks = QUERIES["ticks_validated"](spark, SF).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("trade_id") * 60).cast("timestamp_ntz"))
    ticks = ticks.select("symbol", "ts", "trade_id", "price", "quantity", "is_buyer_maker")
    params = info_bars.BarParams(20_000.0, min_minutes=1.0)
    batch = info_bars.info_bars(ticks, "dollar", params).select("symbol", "open", "close", "tick_count").toPandas()
    ticks.orderBy("trade_id").coalesce(1).write.option("maxRecordsPerFile", 400).parquet(str(tmp_path / "in"))
    names = sorted(os.listdir(tmp_path / "in"))
    for k, n in enumerate(x for x in names if x.endswith(".parquet")):  # files in order of time
        os.utime(tmp_path / "in" / n, (k, k))
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.info_bars_stream(stream, "dollar", params).writeStream.format("memory").queryName("ib").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    streamed = spark.table("ib").select("symbol", "open", "close", "tick_count").toPandas()
    key = ["symbol", "open", "close", "tick_count"]
    assert len(batch) and batch.sort_values(key).reset_index(drop=True).equals(streamed.sort_values(key).reset_index(drop=True))


def test_ohlcv_stream(spark, tmp_path):
    ticks = QUERIES["ticks_validated"](spark, SF).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("trade_id") * 60))
    ticks.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    q = jobs.append_new(jobs.ohlcv_stream(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_messages(spark):
    raw = spark.createDataFrame([('{"s":"BTC","a":7,"p":"1.5","q":"2","T":5,"m":true}',), ("broken",)], "value string")
    assert [(r.symbol, r.trade_id, r.price) for r in jobs.parse_messages(raw, "trades").collect()] == [("BTC", 7, 1.5)]
    many = spark.createDataFrame([('{"data":[{"s":"X","i":"1","p":"1","v":"2","T":1,"S":"Buy"},{"s":"X","i":"2","p":"3","v":"4","T":2,"S":"Sell"}]}',)], "value string")
    assert jobs.parse_messages(many, "trade_list").count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,10.5,2,1,1,1700000000000000,true\n2,-1,2,2,2,1700000001000,false\n3,11,1,3,3,1700000002000,false\n")
    ticks = files.read_tick_csv(spark, str(tmp_path / "t.csv")).orderBy("trade_id").collect()
    assert [(r.trade_id, r.price, str(r.ts)) for r in ticks] == [(1, 10.5, "2023-11-14 22:13:20"), (3, 11.0, "2023-11-14 22:13:22")]
    (tmp_path / "m.csv").write_text("datetime,Open,High,Low,Close,Volume\n2024-01-01 00:00:00,1,2,0.5,1.5,10\nbad,1,2,0.5,1.5,10\n2024-01-01 00:01:00,1,2,0.5,1.6,11\n")
    assert files.read_minute_csv(spark, str(tmp_path / "m.csv")).count() == 2
    assert files.read_minute_csv(spark, str(tmp_path / "m.csv"), after="2024-01-01 00:00:00").count() == 1
    bars = files.make_ohlcv(spark, 50, ("A", "B"))
    files.write_bars(bars, str(tmp_path / "bars"))
    assert files.read_bars(spark, str(tmp_path / "bars"), symbol="A", start="2020-01-01 10:00:00", limit=5).count() == 5
    assert bars.filter(frames.valid_bar()).count() == 100
    files.save_state(spark, {"target": 1.5}, str(tmp_path / "state"))
    assert files.load_state(spark, str(tmp_path / "state")) == {"target": 1.5}
    assert files.load_state(spark, str(tmp_path / "none")) is None
    gaps = files.make_ohlcv(spark, 10).filter(F.hour("ts") != 4)
    assert frames.fill_gaps(gaps, "1h").count() == 10 and frames.resample(gaps, "4h").count() == 3


def test_window_stats_batches(spark):
    from tidewright.operators import window_stats

    bars = files.make_ohlcv(spark, 260, ("A", "B"))
    names = ["permutation_entropy", "hurst_exponent", "drawdown_duration", "lead_lag_signature"]
    whole = {(r.symbol, r.ts): str(r) for r in window_stats.window_stats(bars, names).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "31")
    try:
        assert whole == {(r.symbol, r.ts): str(r) for r in window_stats.window_stats(bars, names).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(KeyError):
        window_stats.window_stats(bars, ["nothing"])
