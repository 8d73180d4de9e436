"""File sources and sinks of ticks, bars and state."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TICK_SCHEMA = T.StructType(
    [
        T.StructField("agg_trade_id", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("first_trade_id", T.LongType()),
        T.StructField("last_trade_id", T.LongType()),
        T.StructField("transact_time", T.LongType()),
        T.StructField("is_buyer_maker", T.BooleanType()),
    ]
)
#: Column names that stand for a time, a price, a quantity and the maker's side.
TIME_NAMES = ("datetime", "timestamp", "time", "date", "open_time", "transact_time", "t")
ALIASES = {"p": "price", "q": "quantity", "qty": "quantity", "amount": "quantity", "t": "timestamp_ms", "transact_time": "timestamp_ms", "timestamp": "timestamp_ms", "time": "timestamp_ms", "m": "is_buyer_maker"}
#: Epochs above this are microseconds.
LARGEST_MS = 9_999_999_999_999


def read_minute_csv(spark: SparkSession, path: str, after: str | None = None) -> DataFrame:
    """One-minute bars ``datetime, open, high, low, close, volume`` of a CSV file with a header.

    The first column named like a time is parsed in UTC; rows whose time or prices can't be read are dropped. ``after`` keeps
    strictly later rows.
    """
    raw = spark.read.csv(path, header=True)
    names = {c.lower(): c for c in raw.columns}
    time = next((names[n] for n in TIME_NAMES if n in names), None)
    if time is None or any(n not in names for n in ("open", "high", "low", "close", "volume")):
        raise ValueError(f"not a file of bars: {raw.columns}")
    ts = F.coalesce(F.try_to_timestamp(F.col(time)), F.timestamp_millis(F.expr(f"try_cast(`{time}` AS BIGINT)")))
    values = [F.expr(f"try_cast(`{names[n]}` AS DOUBLE)").alias(n) for n in ("open", "high", "low", "close", "volume")]
    out = raw.select(ts.alias("datetime"), *values).dropna()
    return out.filter(F.col("datetime") > F.lit(after).cast("timestamp")) if after else out


def read_tick_csv(spark: SparkSession, path: str, header: bool | None = None) -> DataFrame:
    """Trades ``trade_id, price, quantity, ts, is_buyer_maker`` of a CSV file with or without a header.

    Without one the columns are those of :data:`TICK_SCHEMA`; with one, short names are understood. Rows with a price or
    quantity that is no positive number go; times in microseconds become milliseconds.
    """
    if header is None:
        first = spark.read.text(path).head(1)
        header = bool(first) and not first[0][0][:1].isdigit()
    if header:
        raw = spark.read.csv(path, header=True)
        raw = raw.select(*[F.col(f"`{c}`").alias(ALIASES.get(c.lower().strip(), c.lower().strip())) for c in raw.columns])
        raw = raw.withColumn("trade_id", F.expr("try_cast(agg_trade_id AS BIGINT)") if "agg_trade_id" in raw.columns else F.lit(None).cast("long"))
    else:
        raw = spark.read.schema(TICK_SCHEMA).csv(path).withColumnsRenamed({"agg_trade_id": "trade_id", "transact_time": "timestamp_ms"})
    ms = F.expr("try_cast(timestamp_ms AS BIGINT)")
    ms = F.when(ms > LARGEST_MS, F.floor(ms / 1000)).otherwise(ms)
    maker = F.expr("try_cast(is_buyer_maker AS BOOLEAN)") if "is_buyer_maker" in raw.columns else F.lit(None).cast("boolean")
    out = raw.select("trade_id", F.expr("try_cast(price AS DOUBLE)").alias("price"), F.expr("try_cast(quantity AS DOUBLE)").alias("quantity"), F.timestamp_millis(ms.cast("long")).alias("ts"), maker.alias("is_buyer_maker"))
    return out.filter("price > 0 AND quantity > 0 AND ts IS NOT NULL")


def first_days(ticks: DataFrame, days: int, by: str = "symbol", ts: str = "ts") -> DataFrame:
    """Rows of each series' first ``days`` days, what calibration looks at."""
    starts = ticks.groupBy(F.col(by).alias("_key")).agg(F.min(ts).alias("_start"))
    return ticks.join(starts, ticks[by] == F.col("_key")).filter(F.col(ts) <= F.col("_start") + F.make_dt_interval(F.lit(days))).drop("_key", "_start")


def write_bars(bars: DataFrame, path: str, by: tuple = ("exchange", "symbol", "timeframe"), mode: str = "append") -> None:
    """Parquet, one folder per series key that the bars have, so that readers of one series open only its files."""
    keys = [k for k in by if k in bars.columns]
    (bars.repartition(*keys) if keys else bars).write.mode(mode).partitionBy(*keys).parquet(path)


def read_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, columns: list[str] | None = None, limit: int | None = None, newest: bool = False, ts: str = "ts", **keys: str) -> DataFrame:
    """Bars of a range of times and of the given keys, in order; the newest first with ``newest``. Filters reach the scan."""
    df = spark.read.parquet(path)
    for k, v in keys.items():
        df = df.filter(F.col(k) == v)
    if start:
        df = df.filter(F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType))
    if end:
        df = df.filter(F.col(ts) <= F.lit(end).cast(df.schema[ts].dataType))
    df = df.orderBy(F.col(ts).desc() if newest else F.col(ts))
    df = df.limit(limit) if limit else df
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, url: str, table: str, columns: list[str] | None = None, where: str | None = None, partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A database table by JDBC; columns and condition go to the database, reading is split by a column's range."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    df = reader.load()
    df = df.filter(where) if where else df
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 10_000, **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).mode(mode).save()


def save_state(spark: SparkSession, state: dict, path: str) -> None:
    """A small state document as one JSON line."""
    spark.createDataFrame([(json.dumps(state, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_state(spark: SparkSession, path: str) -> dict | None:
    """The document of :func:`save_state`; None if there is none."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(path).head(1)
    except AnalysisException:
        return None
    return json.loads(rows[0][0]) if rows else None


def make_ohlcv(spark: SparkSession, n: int = 1000, symbols: tuple = ("SYN",), start: str = "2020-01-01", hours: int = 1, mu: float = 1e-4, sigma: float = 0.01, seed: int = 42) -> DataFrame:
    """Seeded geometric random walks ``symbol, ts, o, h, l, c, v``: one value per row from hashes, so any partitioning gives the same rows."""
    from pyspark.sql import Window

    rows = spark.range(n).crossJoin(spark.createDataFrame([(s,) for s in symbols], "symbol string"))

    def normal(salt: int):
        u = lambda k: (F.pmod(F.xxhash64(F.lit(seed + k), "symbol", "id"), F.lit((1 << 30) - 1)) + 1) / float(1 << 30)
        return F.sqrt(-2 * F.log(u(salt))) * F.cos(2 * F.pi() * u(salt + 100))

    along = Window.partitionBy("symbol").orderBy("id")
    steps = rows.withColumn("z", mu + sigma * normal(1)).withColumn("c", 100 * F.exp(F.sum("z").over(along)))
    steps = steps.withColumn("o", F.coalesce(F.lag("c").over(along), F.lit(100.0)))
    steps = steps.withColumn("h", F.greatest("o", "c") * (1 + F.abs(sigma / 2 * normal(2)))).withColumn("l", F.least("o", "c") * (1 - F.least(F.abs(sigma / 2 * normal(3)), F.lit(0.5))))
    ts = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("id") * hours).cast("int"))
    return steps.select("symbol", ts.alias("ts"), "o", "h", "l", "c", F.exp(10 + 0.5 * normal(4)).alias("v"))
