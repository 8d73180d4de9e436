"""DataFrame operators on ordered series: bars, gaps, as-of joins, features, upserts, adjacent statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.features import FEATURES, features_sql
from tidewright.plans.dialect import Spark


def timeframe_minutes(timeframe: str) -> int:
    """Minutes of ``15m``, ``4h``, ``1d``, ``1w``."""
    unit = {"m": 1, "h": 60, "d": 1440, "w": 10080}
    if len(timeframe) < 2 or timeframe[-1].lower() not in unit or not timeframe[:-1].isdigit() or int(timeframe[:-1]) < 1:
        raise ValueError(f"not a timeframe: {timeframe!r}")
    return int(timeframe[:-1]) * unit[timeframe[-1].lower()]


def ohlcv(ticks: DataFrame, timeframe: str = "1h", by: str = "symbol", ts: str = "ts", price: str = "price", quantity: str = "quantity", tie: str = "trade_id") -> DataFrame:
    """Clock bars: first, largest, smallest, last price, summed quantity; partial aggregation before the shuffle."""
    order = F.struct(ts, tie)
    g = ticks.groupBy(by, F.window(ts, f"{timeframe_minutes(timeframe)} minutes").start.alias(ts))
    return g.agg(F.min_by(price, order).alias("o"), F.max(price).alias("h"), F.min(price).alias("l"), F.max_by(price, order).alias("c"), F.sum(quantity).alias("v"), F.count("*").alias("n"))


def resample(bars: DataFrame, timeframe: str, by: str = "symbol", ts: str = "ts") -> DataFrame:
    g = bars.groupBy(by, F.window(ts, f"{timeframe_minutes(timeframe)} minutes").start.alias(ts + "_"))
    return g.agg(F.min_by("o", ts).alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", ts).alias("c"), F.sum("v").alias("v")).withColumnRenamed(ts + "_", ts)


def valid_bar() -> Column:
    return F.expr("o > 0 AND h > 0 AND l > 0 AND c > 0 AND h >= l AND h >= greatest(o, c) AND l <= least(o, c) AND v >= 0")


def fill_gaps(bars: DataFrame, timeframe: str, by: str = "symbol", ts: str = "ts") -> DataFrame:
    """Every step between a series' first and last bar; missing closes are carried forward, volumes are 0."""
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(timeframe_minutes(timeframe)))
    grid = bars.groupBy(by).agg(F.min(ts).alias("a"), F.max(ts).alias("b")).select(by, F.explode(F.sequence("a", "b", step)).alias(ts))
    w = Window.partitionBy(by).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    out = grid.join(bars, [by, ts], "left").withColumn("c", F.last("c", ignorenulls=True).over(w))
    return out.withColumns({**{x: F.coalesce(x, "c") for x in ("o", "h", "l")}, "v": F.coalesce("v", F.lit(0.0))})


def asof_join(left: DataFrame, right: DataFrame, values: list[str], by: list[str], ts: str = "ts", direction: str = "backward", strict: bool = False, suffix: str = "", within: str | None = None) -> DataFrame:
    """Each left row with the latest (``forward``: the next) right row of its key; exact times match unless ``strict``.

    Both sides are sorted together and values are carried along, so the cost is one shuffle and one sort however many right
    rows there are, and no pair is ever made. Left rows without a match have nulls. ``within`` limits the distance.
    Of right rows with one time, the last in the order of their values wins.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction: {direction}")
    back = direction == "backward"
    inner = F.struct(F.col(ts).alias("_ts"), *[F.col(v).alias(v) for v in values])
    rows = left.select(*by, F.col(ts), F.lit(1 if back != strict else 0).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(inner).schema[0].dataType).alias("_right"))
    others = right.select(*by, F.col(ts), F.lit(0 if back != strict else 1).alias("_side"), F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), inner.alias("_right"))
    w = Window.partitionBy(*by).orderBy(ts, "_side", F.col("_right").asc() if back else F.col("_right").desc())
    frame = w.rowsBetween(Window.unboundedPreceding, 0) if back else w.rowsBetween(0, Window.unboundedFollowing)
    pick = (F.last if back else F.first)("_right", ignorenulls=True).over(frame)
    out = rows.unionByName(others).withColumn("_hit", pick).filter("_left IS NOT NULL")
    if within:
        apart = F.col("_left")[ts] - F.col("_hit._ts") if back else F.col("_hit._ts") - F.col("_left")[ts]
        out = out.withColumn("_hit", F.when(apart <= F.expr(f"INTERVAL {within}"), F.col("_hit")))
    return out.select("_left.*", *[F.col(f"_hit.{v}").alias(v + suffix) for v in values])


def create_features(bars: DataFrame, names: list[str], on_error: str = "raise") -> DataFrame:
    """``symbol, ts`` and the named features; unknown names raise, or give null columns with ``on_error='null'``."""
    known = [n for n in names if n in FEATURES]
    if len(known) < len(names) and on_error != "null":
        raise KeyError(f"unknown features: {sorted(set(names) - set(known))}")
    out = bars.sparkSession.sql(features_sql(Spark(), known, "{bars}"), bars=bars)
    return out.withColumns({n: F.lit(None).cast("double") for n in names if n not in FEATURES}) if len(known) < len(names) else out


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], only_where: Column | None = None) -> DataFrame:
    """Stored rows replaced by new ones of their key; with ``only_where`` (on stored rows) the others stay as they are."""
    w = Window.partitionBy(*keys)
    cond = only_where if only_where is not None else F.lit(True)
    both = stored.withColumn("_new", F.lit(0)).withColumn("_open", cond).unionByName(new.withColumn("_new", F.lit(1)).withColumn("_open", F.lit(None).cast("boolean")))
    both = both.withColumn("_fixed", F.max(F.when((F.col("_new") == 0) & ~F.coalesce("_open", F.lit(False)), 1)).over(w))
    rank = F.row_number().over(w.orderBy(F.when(F.col("_fixed") == 1, F.col("_new")).otherwise(-F.col("_new"))))
    return both.withColumn("_k", rank).filter("_k = 1").drop("_new", "_open", "_fixed", "_k")


def insert_ignore(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and new ones of other keys; first write wins."""
    return stored.unionByName(new.dropDuplicates(keys).join(stored.select(*keys).distinct(), keys, "left_anti").select(*stored.columns))


def delete_where(stored: DataFrame, condition: Column) -> DataFrame:
    return stored.filter(~F.coalesce(condition, F.lit(False)))


def majority(signals: DataFrame, columns: list[str] | None = None, name: str = "signal") -> DataFrame:
    """Sign of the sum of all ``*_signals`` columns."""
    columns = columns or [c for c in signals.columns if c.endswith("_signals")]
    return signals.withColumn(name, F.signum(sum((F.coalesce(F.col(c), F.lit(0)) for c in columns), F.lit(0))).cast("int"))


def datetime_column(df: DataFrame, name: str = "datetime") -> DataFrame:
    """``df`` with its time in a timestamp column ``name``: of that name, or one named like a time; text is parsed, numbers are
    seconds, milliseconds or microseconds by their size. A ValueError if there is none.
    """
    from tidewright.sources.files import TIME_NAMES

    names = {c.lower(): c for c in df.columns}
    found = names.get(name.lower()) or next((names[n] for n in TIME_NAMES if n in names), None)
    if found is None:
        raise ValueError(f"no time among {df.columns}")
    kind = df.schema[found].dataType.typeName()
    if kind in ("long", "integer", "double"):
        value = from_epoch(F.col(found))
    else:
        value = F.to_timestamp(F.col(found)) if kind == "string" else F.col(found).cast("timestamp")
    return df.withColumn(found, value).withColumnRenamed(found, name)


def from_epoch(x: Column) -> Column:
    """A number of seconds, milliseconds or microseconds since 1970 as a timestamp."""
    size = F.abs(x)
    return F.when(size < 1e11, F.timestamp_millis((x * 1000).cast("long"))).when(size < 1e14, F.timestamp_millis(x.cast("long"))).otherwise(F.timestamp_micros(x.cast("long")))


def to_epoch(ts: Column, unit: str = "ms") -> Column:
    return {"s": F.unix_seconds, "ms": F.unix_millis, "us": F.unix_micros}[unit](ts.cast("timestamp"))


def json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON texts; NaN and infinite numbers are null, as JSON has none."""
    clean = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("value"))
