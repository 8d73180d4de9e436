"""The regime engine as a stream: one state a series, handed over from a batch run, kept from start to start.

Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``), as all of Spark's arbitrary state of this kind.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewright.operators.regimes import NONE, OUT, RegimeConfig, _State

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STALE = "STALE"


class RegimeProcessor(StatefulProcessor):
    """Takes a series' new bars in order of time; those up to the last one processed are dropped.

    The state is the batch engine's own, as text. With ``stale_ms`` a timer runs from each batch with new bars on: when it goes off
    before the next bar has come, one row of labels :data:`STALE` says so, at the time of the last bar; the state stays as it is.
    """

    def __init__(self, cfg: RegimeConfig, by: str, order: str, stale_ms: int | None) -> None:
        self.cfg, self.by, self.order, self.stale_ms = cfg, by, order, stale_ms
        # The class travels with the processor, so workers need no copy of the package.
        self.engine = cloudpickle.dumps((_State, list(OUT)))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("engine", "state string, last_us long")
        self.cls, self.names = cloudpickle.loads(self.engine)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803  the interface's names
        text = initialState["state"].iloc[0]
        state = self.cls.load(self.cfg, text)
        self.kept.update((text, round(state.last_ts * 1_000_000)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # A batch of one series' bars is what came since the last trigger; files or offsets per trigger bound it.
        bars = pd.concat(list(rows))
        bars = bars[bars["c"].notna()].drop_duplicates(self.order).sort_values(self.order, kind="stable")
        at = bars[self.order].astype("datetime64[us]").astype("int64")
        found = self.kept.get() if self.kept.exists() else None
        state = self.cls.load(self.cfg, found[0]) if found else self.cls(self.cfg)
        if found:
            new = (at > found[1]).to_numpy()
            bars, at = bars[new], at[new]
        if not len(bars):
            return
        out = [(*key, ts, *(None if v != v else v for v in state.step(us / 1e6, c))) for ts, us, c in zip(bars[self.order], at.tolist(), bars["c"].tolist(), strict=True)]
        self.kept.update((state.dump(), int(at.iloc[-1])))
        if self.stale_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stale_ms)
        yield pd.DataFrame(out, columns=[self.by, self.order, *self.names])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.kept.exists():
            row = {self.by: [key[0]], self.order: [pd.Timestamp(self.kept.get()[1], unit="us")], **{n: [None] for n in self.names}}
            row.update({n: [STALE] for n in self.names[:4]})
            yield pd.DataFrame(row)

    def close(self) -> None:
        pass


def regime_stream(bars: DataFrame, states: DataFrame | None = None, cfg: RegimeConfig = RegimeConfig(), by: str = "symbol", order: str = "ts", stale_ms: int | None = None) -> DataFrame:
    """Regime columns of a stream of bars (``by, order, c``), append mode; those of :func:`~tidewright.operators.regimes.regime_engine` on the same bars.

    ``states`` (``by, state``, as ``regime_update`` makes them) is taken over when the stream starts for the first time; a restart
    goes on from the checkpoint. Bars must come in order within a series, from batch to batch; repeated or late ones are
    dropped.
    """
    schema = T.StructType([bars.schema[by], T.StructField(order, T.TimestampType()), *(T.StructField(n, t) for n, t in OUT.items())])
    rows = bars.select(by, F.col(order).cast("timestamp").alias(order), F.col("c").cast("double").alias("c"))
    given = None if states is None else states.select(by, "state").groupBy(by)
    return rows.groupBy(by).transformWithStateInPandas(RegimeProcessor(cfg, by, order, stale_ms), schema, "append", "None" if stale_ms is None else "ProcessingTime", given)


def use_rocksdb(spark: SparkSession) -> None:
    """Set the state store that :func:`regime_stream` needs, for queries started from now on in this session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


__all__ = ["NONE", "STALE", "RegimeProcessor", "regime_stream", "use_rocksdb"]
