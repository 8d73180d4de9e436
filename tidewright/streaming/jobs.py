"""Streams: bars with watermarks, message parsing, information bars with the batch operator's own steps. Regimes are in ``regimes.py``."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators.info_bars import BAR, BarParams, InfoBars
from tidewright.streaming.messages import MESSAGES, forward_filled, parse_messages  # noqa: F401


def ohlcv_stream(ticks: DataFrame, timeframe: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Clock bars of a tick stream; a bar comes out when the watermark has passed it."""
    order = F.struct("ts", "trade_id")
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", timeframe))
    bars = g.agg(F.min_by("price", order).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", order).alias("c"), F.sum("quantity").alias("v"))
    return bars.select("symbol", F.col("window.start").alias("ts"), "o", "h", "l", "c", "v")


def info_bars_stream(ticks: DataFrame, kind: str, params: BarParams) -> DataFrame:
    """Information bars of a tick stream (``symbol, ts, trade_id, price, quantity, is_buyer_maker``), append mode.

    The state of a series is the batch operator's object, so a stream's bars are those of a batch over the same ticks as long
    as ticks come in order within a series.
    """
    schema = T.StructType([T.StructField("symbol", T.StringType()), *BAR.fields])
    # The class travels with the function, so workers need no copy of the package.
    fresh = cloudpickle.dumps(InfoBars(kind, params))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        machine = cloudpickle.loads(fresh)
        if state.exists:
            machine.__dict__.update(pickle.loads(state.get[0]))
        ticks_ = pd.concat(list(frames)).sort_values(["ts", "trade_id"])
        rows = []
        for ts, price, quantity, seller in zip(ticks_["ts"], ticks_["price"], ticks_["quantity"], ticks_["is_buyer_maker"], strict=True):
            rows.extend((*key, *r) for r in machine.push((ts.to_pydatetime(), float(price), float(quantity), bool(seller))))
        state.update((pickle.dumps({k: v for k, v in machine.__dict__.items() if k != "p"}),))
        if rows:
            yield pd.DataFrame(rows, columns=schema.names)

    return ticks.groupBy("symbol").applyInPandasWithState(run, schema, "state binary", "append", "NoTimeout")


def append_new(bars: DataFrame, path: str, checkpoint: str, keys: tuple = ("symbol", "ts")):
    """Start writing a stream of bars, each batch without the rows whose keys are stored already; first write wins.

    Of what is stored only the range of the batch's last key is read, which the files' statistics pick out; equal keys are equal
    in nulls too.
    """

    def write(batch: DataFrame, _: int) -> None:
        from pyspark.errors import AnalysisException

        spark = batch.sparkSession
        try:
            stored = spark.read.parquet(path).select(*keys)
        except AnalysisException:
            stored = batch.limit(0).select(*keys)
        last = keys[-1]
        ends = batch.agg(F.min(last).alias("a"), F.max(last).alias("z"), F.max(F.col(last).isNull()).alias("n")).first()
        inside = F.lit(False) if ends["a"] is None else F.col(last).between(F.lit(ends["a"]), F.lit(ends["z"]))
        stored = stored.filter(inside | F.col(last).isNull() if ends["n"] else inside).select(*(F.col(k).alias(f"_{k}") for k in keys))
        same = F.lit(True)
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        batch.dropDuplicates(list(keys)).join(stored, same, "left_anti").write.mode("append").parquet(path)

    return bars.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_streams(streams: dict[str, DataFrame], root: str, keys: tuple = ("symbol", "ts")) -> dict:
    """Start one query per named stream of rows, each into its own table under ``root``; the running queries by name."""
    return {name: append_new(rows, f"{root}/{name}", f"{root}/_checkpoints/{name}", keys) for name, rows in streams.items()}


def stop_streams(queries: dict, timeout: int = 60) -> None:
    """Let every query finish what it has (or stop it after ``timeout`` seconds); the first failure is raised when all have stopped."""
    for q in queries.values():
        q.processAllAvailable() if q.isActive else None
        q.stop()
        q.awaitTermination(timeout)
    for q in queries.values():
        if (error := q.exception()) is not None:
            raise error
