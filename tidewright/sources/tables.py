"""Stored tables of the engine: schemas, creation, range reads, point look-ups, updates, state documents.

A table is a Parquet folder (``root/name``), partitioned by its series key and, for time series, by day, so that readers of a
range open only its files. Changes rewrite a table beside the old one and swap the folders.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D, _L, _S, _TS, _B = T.DoubleType(), T.LongType(), T.StringType(), T.TimestampType(), T.BooleanType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


OHLCV = _schema(datetime=_TS, exchange=_S, symbol=_S, timeframe=_S, open=_D, high=_D, low=_D, close=_D, volume=_D)
BARS = _schema(
    id=_L, datetime=_TS, datetime_end=_TS, exchange=_S, symbol=_S, open=_D, high=_D, low=_D, close=_D, volume=_D, buy_volume=_D, sell_volume=_D, tick_count=_L, duration_minutes=_D, target=_D, size=_D, regime_label=_S, regime_confidence=_D,
)
LEDGER = _schema(
    id=_L, entry_datetime=_TS, exit_datetime=_TS, direction=_S, action=_S, status=_S, avg_entry_price=_D, avg_exit_price=_D, size=_D, trade_return_pct=_D, account_return_pct=_D, balance=_D, fees=_D, trial_id=_L,
)
GRAPHS = _schema(id=_L, datetime=_TS, name=_S, value=_D, trial_id=_L)
ANALYTICS = _schema(id=_L, trial_id=_L, document=_S)
REQUESTS = _schema(request_id=_L, user_id=_L, strategy_id=_L, status=_S, created=_TS, document=_S)
SIGNALS = _schema(strategy_id=_L, datetime=_TS, signal=T.IntegerType())
STRATEGIES = _schema(strategy_id=_L, exchange=_S, symbol=_S, bar_type=_S, timeframe=_S, document=_S)
SYMBOLS = _schema(exchange=_S, symbol=_S, enabled=_B)
#: Kind of table -> schema, folders, time column.
KINDS: dict[str, tuple[T.StructType, tuple[str, ...], str | None]] = {
    "ohlcv": (OHLCV, ("exchange", "symbol", "timeframe"), "datetime"), "bars": (BARS, ("exchange", "symbol"), "datetime"), "ledgers": (LEDGER, (), "entry_datetime"), "graphs": (GRAPHS, (), "datetime"), "graphs_daily": (GRAPHS, (), "datetime"),
    "analytics": (ANALYTICS, (), None), "requests": (REQUESTS, (), None), "signals": (SIGNALS, ("strategy_id",), "datetime"), "strategies": (STRATEGIES, (), None), "symbols": (SYMBOLS, (), None),
}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def create_table(spark: SparkSession, path: str, kind: str | T.StructType, folders: tuple[str, ...] | None = None) -> None:
    """An empty table of a known kind or a schema; nothing happens if it is there."""
    schema, keys, _ = KINDS[kind] if isinstance(kind, str) else (kind, (), None)
    if not exists(spark, path):
        empty = spark.createDataFrame([], schema)
        empty.write.partitionBy(*(keys if folders is None else folders)).parquet(path)
        # Of a table without rows only the schema is stored, beside the data.
        spark.createDataFrame([(schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_schema")


def drop_table(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def open_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table; an AnalysisException if there is none."""
    stored = spark.read.text(f"{path}/_schema").head() if exists(spark, f"{path}/_schema") else None
    reader = spark.read.schema(T.StructType.fromJson(json.loads(stored[0]))) if stored else spark.read
    return reader.parquet(path)


def insert_rows(spark: SparkSession, path: str, rows: DataFrame | list[dict] | dict, kind: str | None = None) -> None:
    """Append rows (a frame, one dict or several); columns that they lack are null."""
    schema = open_table(spark, path).schema
    keys = KINDS[kind][1] if kind else ()
    df = rows if isinstance(rows, DataFrame) else spark.createDataFrame([{f.name: r.get(f.name) for f in schema} for r in ([rows] if isinstance(rows, dict) else rows)], schema)
    df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    df.write.mode("append").partitionBy(*keys).parquet(path)


def rewrite(spark: SparkSession, path: str, rows: DataFrame, kind: str | None = None) -> None:
    """Replace a table by rows that may be made of it: they are written beside it, the table steps aside, and only when they have its name it goes.

    Of a run that ends in between, the old or the new rows are whole under one of the names; :func:`recover` puts them back.
    """
    schema, beside = open_table(spark, path).schema, f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    rows.select(*schema.names).write.partitionBy(*(KINDS[kind][1] if kind else ())).parquet(beside)
    spark.createDataFrame([(schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{beside}/_schema")
    fs, p = _fs(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}-replaced")
    fs.delete(old, True)
    fs.rename(p, old)
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), p)
    fs.delete(old, True)


def recover(spark: SparkSession, path: str) -> bool:
    """After a :func:`rewrite` that was cut short: the table that had stepped aside gets its name back. Whether there was one."""
    fs, p = _fs(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}-replaced")
    if not fs.exists(old):
        return False
    if fs.exists(p):  # the new rows have the name already
        fs.delete(old, True)
    else:
        fs.rename(old, p)
    return True


# ---- reads -------------------------------------------------------------------------------------------------------------------


def read_range(spark: SparkSession, path: str, time: str | None = None, start: str | None = None, end: str | None = None, columns: list[str] | None = None, limit: int | None = None, offset: int = 0, newest: bool = False, **equal) -> DataFrame:
    """Rows of a range of times (both ends included) whose columns equal the given values (one of them, for a list), in order of time.

    None stands for no condition. Conditions and columns reach the scan. With ``newest`` the latest ``limit`` rows come, latest first.
    """
    df = open_table(spark, path)
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == F.lit(value))
    if time:
        kind = df.schema[time].dataType
        df = df.filter(F.col(time) >= F.lit(start).cast(kind)) if start else df
        df = df.filter(F.col(time) <= F.lit(end).cast(kind)) if end else df
        df = df.orderBy(F.col(time).desc() if newest else F.col(time))
    df = df.offset(offset) if offset else df
    df = df.limit(limit) if limit is not None else df
    return df.select(*columns) if columns else df


def last_row(spark: SparkSession, path: str, time: str, **equal) -> DataFrame:
    """The row with the latest time among those that match; a top-1, not a sort."""
    return read_range(spark, path, time, limit=1, newest=True, **equal)


def last_time(spark: SparkSession, path: str, time: str, **equal):
    return read_range(spark, path, **equal).agg(F.max(time)).first()[0]


def read_ledger(spark, path, id=None, start=None, end=None, trial_id=None, columns=None, limit=None):
    return read_range(spark, path, "entry_datetime", start, end, columns, limit, id=id, trial_id=trial_id)


def read_graphs(spark, path, id=None, start=None, end=None, trial_id=None, columns=None, limit=None):
    """Also the reader of daily graphs, which are a table of their own."""
    return read_range(spark, path, "datetime", start, end, columns, limit, id=id, trial_id=trial_id)


def read_analytics(spark, path, id, trial_id=None):
    return read_range(spark, path, id=id, trial_id=trial_id)


def read_requests(spark, path, request_ids=None, user_id=None, status=None, strategy_id=None, limit=None):
    return read_range(spark, path, limit=limit, request_id=request_ids, user_id=user_id, status=status, strategy_id=strategy_id)


def read_signals(spark, path, strategy_id, start=None, end=None, columns=None, limit=None):
    return read_range(spark, path, "datetime", start, end, columns, limit, strategy_id=strategy_id)


def last_signal(spark, path, strategy_id):
    return last_row(spark, path, "datetime", strategy_id=strategy_id)


def read_strategies(spark, path, exchange=None, symbol=None, bar_type=None, timeframe=None, limit=None, offset=0):
    """A timeframe is a condition for time bars only."""
    df = read_range(spark, path, exchange=exchange, symbol=symbol, bar_type=bar_type)
    df = df.filter((F.col("bar_type") != "time") | (F.col("timeframe") == timeframe)) if timeframe else df
    df = df.orderBy("strategy_id").offset(offset)
    return df.limit(limit) if limit is not None else df


def strategies_by_series(spark, path) -> DataFrame:
    return open_table(spark, path).groupBy("exchange", "symbol", "bar_type", "timeframe").agg(F.array_sort(F.collect_set("strategy_id")).alias("strategies"))


def enabled_symbols(spark, path, exchange=None) -> DataFrame:
    return read_range(spark, path, exchange=exchange, enabled=True).select("exchange", "symbol").orderBy("exchange", "symbol")


def open_trades(spark, path, id=None, trial_id=None, columns=None) -> DataFrame:
    df = read_range(spark, path, id=id, trial_id=trial_id).filter(F.col("exit_datetime").isNull())
    return df.select(*columns) if columns else df


def bars_without_regime(spark, path, **series) -> DataFrame:
    return read_range(spark, path, **series).filter(F.col("regime_label").isNull()).orderBy("datetime")


def recent_bars(spark, path, limit: int, **series) -> DataFrame:
    """The latest bars, oldest of them first."""
    return read_range(spark, path, "datetime", limit=limit, newest=True, **series).orderBy("datetime")


# ---- changes -----------------------------------------------------------------------------------------------------------------


def update_columns(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with the columns that ``changes`` has; rows and columns that it lacks, and its nulls, keep the old value.

    Of several changes of one key, one wins. Used for regimes of bars and for metadata of strategies.
    """
    new = [c for c in changes.columns if c not in keys and c in stored.columns]
    other = changes.dropDuplicates(keys).select(*keys, *[F.col(c).alias(f"_{c}") for c in new])
    joined = stored.join(other, keys, "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in new else F.col(c) for c in stored.columns])


def new_rows(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not stored."""
    return rows.join(stored.select(*keys).distinct(), keys, "left_anti").select(*rows.columns)


def after_gaps(bars: DataFrame, gap: str, warmup: int, by: str = "symbol", ts: str = "ts") -> Column:
    """Whether a bar is among the first ``warmup`` ones after a gap longer than ``gap`` (an interval) or a series' beginning."""
    w = Window.partitionBy(by).orderBy(ts)
    opens = F.coalesce(F.col(ts) - F.lag(ts).over(w) > F.expr(f"INTERVAL {gap}"), F.lit(True))
    return F.max(opens.cast("int")).over(w.rowsBetween(-(warmup - 1), 0)) == 1


def delete_series(spark: SparkSession, paths: list[str], dry_run: bool = False, **equal) -> dict[str, int]:
    """Delete the rows that match from every table that has all the columns; rows deleted (or to be, with ``dry_run``) by table."""
    gone = {}
    for path in paths:
        df = open_table(spark, path)
        if equal and all(c in df.columns for c in equal):
            match = F.lit(True)
            for c, v in equal.items():
                match = match & (F.col(c) == F.lit(v))
            gone[path] = df.filter(match).count()
            if gone[path] and not dry_run:
                rewrite(spark, path, df.filter(~F.coalesce(match, F.lit(False))))
    return gone


# ---- state documents ---------------------------------------------------------------------------------------------------------


def _state_path(root: str, key: tuple) -> str:
    return f"{root}/key={'~'.join(str(k) for k in key)}"


def put_state(spark: SparkSession, root: str, key: tuple, state: dict) -> None:
    """Store a series' small state document; an update keeps the fields that it doesn't name."""
    old = get_state(spark, root, key) or {}
    spark.createDataFrame([(json.dumps({**old, **state}, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(_state_path(root, key))


def get_state(spark: SparkSession, root: str, key: tuple) -> dict | None:
    try:
        row = spark.read.text(_state_path(root, key)).head()
    except AnalysisException:
        return None
    return json.loads(row[0]) if row else None


def delete_state(spark: SparkSession, root: str, key: tuple) -> None:
    drop_table(spark, _state_path(root, key))


def state_keys(spark: SparkSession, root: str) -> list[tuple]:
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    return sorted(tuple(s.getPath().getName().removeprefix("key=").split("~")) for s in fs.listStatus(p))
