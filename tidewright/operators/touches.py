"""First later touch of price levels: one sort of levels and bars together, open levels in two heaps per series.

A range join of every level with every later bar would be quadratic; here a level is put in when it becomes known and taken out
by the first bar that reaches it, so the work is that of the sort and of one heap operation a level.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators.scan import sessions


class _Open:
    """Open levels of one series; rows are bars (``id`` null) or levels."""

    def __init__(self) -> None:
        self.above: list[tuple] = []  # reached by a high
        self.below: list[tuple] = []  # reached by a low; levels negated

    def push(self, row: tuple) -> list[tuple]:
        ts, ident, level, up, high, low = row
        if ident is not None:
            heapq.heappush(self.above if up else self.below, (level if up else -level, ident))
            return []
        out = []
        while self.above and self.above[0][0] <= high:
            out.append((heapq.heappop(self.above)[1], ts))
        while self.below and -self.below[0][0] >= low:
            out.append((heapq.heappop(self.below)[1], ts))
        return out

    def close(self) -> list[tuple]:
        return []


def first_touches(levels: DataFrame, bars: DataFrame, by: str = "symbol") -> DataFrame:
    """``levels`` with ``touched``: the time of the first bar after ``ts`` whose high reaches ``level`` (``up``) or whose low does; null if none.

    ``levels`` has ``symbol, ts, id, level, up`` with ids that are unique within a series; ``bars`` has ``symbol, ts, h, l``.
    """
    when = bars.schema["ts"].dataType
    rows = levels.select(by, F.col("ts").cast(when).alias("ts"), F.lit(1).alias("_side"), F.col("id").cast("long").alias("id"), F.col("level").cast("double").alias("level"), "up", F.lit(None).cast("double").alias("h"), F.lit(None).cast("double").alias("l"))
    rows = rows.unionByName(bars.select(by, "ts", F.lit(0).alias("_side"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("level"), F.lit(None).cast("boolean").alias("up"), "h", "l"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("touched", when)])
    hits = sessions(rows, [by], ["ts", "_side"], ["ts", "id", "level", "up", "h", "l"], _Open, schema)
    return levels.join(hits, [by, "id"], "left")
