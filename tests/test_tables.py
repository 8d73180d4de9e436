"""Stored tables, messages, backtests and touches on small frames."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators import backtest, touches
from tidewright.sources import tables
from tidewright.streaming import jobs, messages


def test_tables(spark, tmp_path):
    path = str(tmp_path / "ledgers")
    tables.create_table(spark, path, "ledgers")
    tables.create_table(spark, path, "ledgers")
    assert tables.open_table(spark, path).count() == 0
    rows = [{"id": i % 2, "entry_datetime": None, "status": "Open" if i == 3 else "Closed", "trade_return_pct": float(i), "trial_id": 7} for i in range(4)]
    frame = spark.createDataFrame([(r["id"], f"2024-01-0{i + 1}", r["status"], r["trade_return_pct"], 7) for i, r in enumerate(rows)], "id long, entry_datetime string, status string, trade_return_pct double, trial_id long")
    tables.insert_rows(spark, path, frame.withColumn("entry_datetime", F.col("entry_datetime").cast("timestamp")).withColumn("exit_datetime", F.when(F.col("status") == "Closed", F.col("entry_datetime").cast("timestamp"))), "ledgers")
    tables.insert_rows(spark, path, {"id": 9, "status": "Open"}, "ledgers")
    assert [r.trade_return_pct for r in tables.read_ledger(spark, path, 1, start="2024-01-03").collect()] == [3.0]
    assert tables.read_ledger(spark, path, trial_id=7, columns=["id"], limit=3).collect() == [(0,), (1,), (0,)]
    assert {r.id for r in tables.open_trades(spark, path).collect()} == {1, 9} and tables.open_trades(spark, path, 9, columns=["id"]).collect() == [(9,)]
    assert tables.last_row(spark, path, "entry_datetime", id=0).first().trade_return_pct == 2.0 and str(tables.last_time(spark, path, "entry_datetime", id=1)).startswith("2024-01-04")
    assert tables.delete_series(spark, [path], dry_run=True, id=0) == {path: 2} and tables.open_table(spark, path).count() == 5
    assert tables.delete_series(spark, [path], id=0) == {path: 2} and {r.id for r in tables.open_table(spark, path).collect()} == {1, 9}
    assert tables.delete_series(spark, [path], exchange="x") == {}
    changed = tables.update_columns(tables.open_table(spark, path), spark.createDataFrame([(9, "Closed", 5)], "id long, status string, other int"), ["id"])
    assert {(r.id, r.status) for r in changed.collect()} == {(1, "Closed"), (1, "Open"), (9, "Closed")}
    tables.drop_table(spark, path)
    assert not tables.exists(spark, path)


def test_strategies_symbols_bars(spark, tmp_path):
    path = str(tmp_path / "s")
    tables.create_table(spark, path, "strategies")
    tables.insert_rows(spark, path, [{"strategy_id": 1, "exchange": "e", "symbol": "A", "bar_type": "time", "timeframe": "1h"}, {"strategy_id": 2, "exchange": "e", "symbol": "A", "bar_type": "time", "timeframe": "4h"}, {"strategy_id": 3, "exchange": "e", "symbol": "B", "bar_type": "dollar"}])
    assert [r.strategy_id for r in tables.read_strategies(spark, path, timeframe="1h").collect()] == [1, 3] and [r.strategy_id for r in tables.read_strategies(spark, path, limit=1, offset=1).collect()] == [2]
    assert sorted(r.strategies for r in tables.strategies_by_series(spark, path).collect()) == [[1], [2], [3]]
    symbols = str(tmp_path / "y")
    tables.create_table(spark, symbols, "symbols")
    tables.insert_rows(spark, symbols, [{"exchange": "e", "symbol": "B", "enabled": True}, {"exchange": "e", "symbol": "A", "enabled": True}, {"exchange": "f", "symbol": "C", "enabled": False}])
    assert [r.symbol for r in tables.enabled_symbols(spark, symbols).collect()] == ["A", "B"]
    bars = str(tmp_path / "b")
    tables.create_table(spark, bars, "bars")
    frame = spark.createDataFrame([("e", "A", f"2024-01-01 0{i}:00:00", "BULL" if i < 2 else None) for i in range(4)], "exchange string, symbol string, datetime string, regime_label string").withColumn("datetime", F.col("datetime").cast("timestamp"))
    tables.insert_rows(spark, bars, frame, "bars")
    assert tables.bars_without_regime(spark, bars, symbol="A").count() == 2 and [r.datetime.hour for r in tables.recent_bars(spark, bars, 2, symbol="A").collect()] == [2, 3]
    gaps = spark.createDataFrame([("A", i) for i in (0, 1, 2, 9, 10, 11)], "symbol string, h int").withColumn("ts", F.timestamp_seconds(F.col("h") * 3600))
    assert [r.w for r in gaps.withColumn("w", tables.after_gaps(gaps, "2 hours", 2)).orderBy("h").collect()] == [True, True, False, True, True, False]


def test_state_documents(spark, tmp_path):
    root = str(tmp_path / "state")
    assert tables.get_state(spark, root, ("e", "A")) is None and tables.state_keys(spark, root) == []
    tables.put_state(spark, root, ("e", "B"), {"x": 1})
    tables.put_state(spark, root, ("e", "A"), {"x": 1, "y": 2})
    tables.put_state(spark, root, ("e", "A"), {"x": 3})
    assert tables.get_state(spark, root, ("e", "A")) == {"x": 3, "y": 2} and tables.state_keys(spark, root) == [("e", "A"), ("e", "B")]
    tables.delete_state(spark, root, ("e", "A"))
    assert tables.state_keys(spark, root) == [("e", "B")]


SAMPLES = {
    "ticker": ({"s": "X", "E": 1, "p": "1.5", "c": "4"}, {"time_ms": 1, "change": 1.5, "last": 4.0}),
    "order_book": ({"s": "X", "E": 5, "b": [["1.5", "2"], ["1.4", "3"]], "a": [["1.6", "1"]]}, {"best_bid": 1.5, "best_ask_size": 1.0, "bids": [[1.5, 2.0], [1.4, 3.0]]}),
    "order_book_spot": ({"lastUpdateId": 9, "bids": [["1.5", "2"]], "asks": []}, {"best_bid": 1.5, "best_ask": None}),
    "liquidations": ({"E": 7, "o": {"s": "X", "S": "SELL", "p": "9", "X": "FILLED", "T": 6}}, {"side": "SELL", "price": 9.0, "status": "FILLED", "event_ms": 7}),
    "topic_book": ({"ts": 4, "type": "delta", "data": {"s": "X", "b": [["1", "2"]], "a": []}}, {"update": "delta", "best_bid": 1.0}),
    "topic_kline": ({"ts": 4, "data": [{"start": 1, "end": 2, "close": "1.5", "confirm": True}]}, {"sent_ms": 4, "c": 1.5, "closed": True}),
    "topic_liquidations": ({"ts": 4, "data": [{"T": 3, "s": "X", "S": "Buy", "v": "2", "p": "1"}]}, {"size": 2.0, "time_ms": 3}),
    "all_mids": ({"data": {"mids": {"A": "1.5"}}}, {"mids": {"A": 1.5}}),
    "l2_book": ({"data": {"coin": "A", "time": 7, "levels": [[{"px": "1", "sz": "2", "n": 3}], []]}}, {"best_bid": 1.0, "best_bid_orders": 3, "best_ask": None}),
    "candle": ({"data": {"s": "A", "t": 7, "o": "1", "c": "2", "n": 3}}, {"o": 1.0, "c": 2.0, "trades": 3}),
    "spot_book": ({"type": "snapshot", "data": [{"symbol": "A", "timestamp": "2024-01-01T00:00:01.5Z", "bids": [{"price": 1.5, "qty": 2}], "asks": []}]}, {"best_bid": 1.5, "update": "snapshot", "time_ms": 1704067201500}),
    "spot_ohlc": ({"data": [{"symbol": "A", "timestamp": "2024-01-01T00:00:00Z", "open": 1, "vwap": 2}]}, {"o": 1.0, "vwap": 2.0}),
    "futures_ticker": ({"product_id": "P", "markPrice": 3, "openInterest": 4, "tag": "perpetual"}, {"mark_price": 3.0, "open_interest": 4.0, "tag": "perpetual"}),
    "futures_book": ({"product_id": "P", "timestamp": 1, "seq": 2, "side": "buy", "price": 3, "qty": 4}, {"sequence": 2, "quantity": 4.0}),
}


@pytest.mark.parametrize("kind", sorted(SAMPLES))
def test_message_formats(spark, kind):
    message, want = SAMPLES[kind]
    rows = messages.parse_messages(spark.createDataFrame([(json.dumps(message), 5), ("broken", 6), ("{}", 7), (None, 8)], "value string, at int"), kind, keep=("at",)).collect()
    assert len(rows) == 1 and rows[0].at == 5 and {k: rows[0][k] for k in want} == want


def test_every_message_kind_parses_nothing(spark):
    raw = spark.createDataFrame([("{}",)], "value string")
    assert all(messages.parse_messages(raw, kind).count() == 0 for kind in messages.MESSAGES)


def test_forward_filled_batch_equals_stream(spark, tmp_path):
    rng = random.Random(4)
    rows = [(s, 10 * k, None if rng.random() < 0.6 else float(k), None if rng.random() < 0.5 else f"u{k}") for s in "AB" for k in range(30)]
    frame = spark.createDataFrame(rows, "symbol string, time_ms long, last_price double, tag string")
    batch = sorted(map(tuple, messages.forward_filled(frame).collect()), key=str)
    assert batch and all(r[2] is not None for r in batch)
    for part in range(3):
        frame.filter(F.floor(F.col("time_ms") / 100) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    import os

    for k, n in enumerate(sorted(os.listdir(tmp_path / "in"), key=lambda n: os.path.getmtime(tmp_path / "in" / n))):
        os.utime(tmp_path / "in" / n, (k + 1, k + 1))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = messages.forward_filled(stream).writeStream.format("memory").queryName("filled").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("filled").collect()), key=str) == batch


def test_run_streams(spark, tmp_path):
    frame = spark.createDataFrame([("A", 1, 1.0), ("A", 1, 2.0), ("B", 1, 1.0)], "symbol string, ts long, x double")
    frame.write.parquet(str(tmp_path / "in"))
    streams = {n: spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")) for n in ("one", "two")}
    running = jobs.run_streams(streams, str(tmp_path / "out"))
    for q in running.values():
        q.awaitTermination()
    jobs.stop_streams(running)
    assert all(spark.read.parquet(str(tmp_path / "out" / n)).count() == 2 for n in streams)


def plain_backtest(bars, r):
    """The rules told once more, bar by bar: trades as (bar, percent, reason)."""
    side = wish = 0
    balance, out = r.balance, []
    for k, (o, h, low, s) in enumerate(bars):
        if balance < r.broken * r.balance:
            break
        wish = s or wish

        def sell(price=None, percent=None, why=""):
            nonlocal side, balance
            percent = side * (price / entry - 1) * 100 if percent is None else percent
            pnl = percent * r.leverage - r.fee - r.slippage
            balance, side = balance + r.size * pnl / 100, 0
            out.append((k, round(pnl, 9), why))

        if side and side != wish:
            sell(o, why="direction change")
        if not side and wish:
            side, entry, stop, on = wish, o, o * (1 - wish * r.stop), r.activation <= 0
        if side and r.trail is None:
            up, down = (entry * (1 + r.target), entry * (1 - r.stop)) if side > 0 else (entry * (1 + r.stop), entry * (1 - r.target))
            if low <= down or h >= up:
                won = (side > 0) == (not low <= down)
                sell(percent=100 * (r.target if won else -r.stop), why="target" if won else "stop")
        elif side:
            goal = entry * (1 + side * r.target)
            if (low <= stop) if side > 0 else (h >= stop):
                sell(stop, why="trailing")
            elif (h >= goal) if side > 0 else (low <= goal):
                sell(goal, why="target")
            else:
                on = on or ((h >= entry * (1 + r.activation)) if side > 0 else (low <= entry * (1 - r.activation)))
                stop = stop if not on else max(stop, h * (1 - r.trail)) if side > 0 else min(stop, low * (1 + r.trail))
    return out


@pytest.mark.parametrize("rules", [backtest.Rules(), backtest.Rules(trail=0.01, activation=0.01), backtest.Rules(leverage=30.0, stop=0.05)])
def test_backtest_against_the_rules(spark, rules):
    rng = np.random.default_rng(5)
    rows, price = [], 100.0
    for k in range(300):
        o, price = price, price * float(np.exp(0.01 * rng.normal()))
        rows.append(("A", k, o, max(o, price) * 1.004, min(o, price) * 0.996, int(rng.choice([-1, 0, 0, 0, 1]))))
    frame = spark.createDataFrame(rows, "symbol string, ts long, o double, h double, l double, signal int")
    run = backtest.backtest(frame, rules).orderBy("ts").collect()
    want = plain_backtest([r[2:] for r in rows], rules)
    assert sum(r.closed for r in run) == len(want) > 5
    for k in {k for k, *_ in want}:
        mine = [x for x in want if x[0] == k]
        assert abs(run[k].pnl - sum(p for _, p, _ in mine)) < 1e-6 and run[k].reason == mine[-1][2]
    assert backtest.trades(backtest.backtest(frame, rules)).count() == len({k for k, *_ in want})


def test_first_touches(spark):
    rng = random.Random(6)
    bars = [(s, t, 0.0, 0.0) for s in "AB" for t in range(60)]
    bars = [(s, t, (m := rng.random()) + 0.1, m - 0.1) for s, t, *_ in bars]
    levels = [(s, rng.randrange(60), i, rng.random() * 1.4 - 0.2, rng.random() < 0.5) for i, s in enumerate("AB" * 40)]
    got = touches.first_touches(spark.createDataFrame(levels, "symbol string, ts long, id long, level double, up boolean"), spark.createDataFrame(bars, "symbol string, ts long, h double, l double"))
    want = {i: min((t for s, t, h, low in bars if s == symbol and t > ts and (h >= level if up else low <= level)), default=None) for symbol, ts, i, level, up in levels}
    assert {r.id: r.touched for r in got.collect()} == want


def test_times_and_json(spark):
    from tidewright.operators import frames

    df = spark.createDataFrame([(1_700_000_000, float("nan"), "a"), (1_700_000_000_000, 1.5, None), (1_700_000_000_000_000, float("inf"), "b")], "t long, x double, s string")
    out = frames.datetime_column(df)
    assert {str(r.datetime) for r in out.collect()} == {"2023-11-14 22:13:20"} and out.columns == ["datetime", "x", "s"]
    assert {r.e for r in out.select(frames.to_epoch(F.col("datetime")).alias("e")).collect()} == {1_700_000_000_000}
    assert [json.loads(r.value) for r in frames.json_rows(df.select("x", "s")).collect()] == [{"x": None, "s": "a"}, {"x": 1.5, "s": None}, {"x": None, "s": "b"}]
    with pytest.raises(ValueError):
        frames.datetime_column(df.select("x"))
    assert frames.datetime_column(spark.createDataFrame([("2024-01-01 00:00:00",)], "Date string")).columns == ["datetime"]


def test_rewrite_that_was_cut_short(spark, tmp_path):
    """The table that stepped aside comes back, or goes where the new rows have its name already."""
    path = str(tmp_path / "t")
    tables.create_table(spark, path, T.StructType.fromDDL("id long, v string"))
    tables.insert_rows(spark, path, [{"id": 7, "v": "x"}])
    before = sorted(map(tuple, tables.open_table(spark, path).collect()))
    (tmp_path / "t").rename(tmp_path / "t-replaced")
    assert tables.recover(spark, path) and sorted(map(tuple, tables.open_table(spark, path).collect())) == before
    assert not tables.recover(spark, path)
    tables.rewrite(spark, path, tables.open_table(spark, path).filter("id = 7"))
    assert [tuple(r) for r in tables.open_table(spark, path).collect()] == [(7, "x")] and not (tmp_path / "t-replaced").exists()
    (tmp_path / "t-replaced").mkdir()
    assert tables.recover(spark, path) and not (tmp_path / "t-replaced").exists() and tables.open_table(spark, path).count() == 1


def test_append_reads_the_range_of_a_batch(spark, tmp_path):
    """Keys that are stored, or come twice, are written once; nulls among keys are keys like others."""
    folder, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "symbol string, ts timestamp, v int"
    ts = lambda h: f"2024-01-01 {h:02d}:00:00"
    frame = lambda rows: spark.createDataFrame(rows, "symbol string, ts string, v int").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
    for batch in ([("a", ts(1), 1), ("a", ts(2), 2), (None, ts(1), 3)], [("a", ts(2), 9), ("a", ts(3), 4), (None, ts(1), 9), ("b", None, 5)], [("b", None, 9), ("c", ts(1), 6), ("c", ts(1), 6)]):
        frame(batch).write.mode("append").parquet(folder)
        q = jobs.append_new(spark.readStream.schema(schema).parquet(folder), out, ck)
        q.awaitTermination(120)
        assert q.exception() is None
    got = spark.read.parquet(out).collect()
    assert sorted(r["v"] for r in got) == [1, 2, 3, 4, 5, 6]
