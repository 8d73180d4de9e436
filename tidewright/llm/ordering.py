"""Places in a total order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, staged


def only(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names; others, also those that differ in case alone, are left behind."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(plain[f"c{df.columns.index(n)}"].alias(n) for n in names))


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``idx``, the place from 0 of each row in its group (nulls first, rows alike in any order), ``n``, the group's size, and ``group_idx``, the group's place among all.

    Rows are dealt by ranges of (group, order) and counted within their range; the counts of ranges, of which there are few,
    give what stands before each. So a group that holds most of the rows is many tasks' work. ``df`` should be a staged table:
    ranges come from a sample that is taken from it first.
    """
    keys = [*group, *order]
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = staged(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "ranged")
    spans = ranged.groupBy(*group, "_part").agg(F.count("*").alias("_size"), F.min("_row").alias("_first"))
    spans = spans.withColumns({"_base": F.sum("_size").over(W.partitionBy(*group).orderBy("_part")) - F.col("_size"), "n": F.sum("_size").over(W.partitionBy(*group))})
    # Groups stand in order: those that begin in earlier ranges, then those before it in its own.
    spans = spans.withColumn("_begins", (F.col("_base") == 0).cast("long"))
    begun = spans.groupBy("_part").agg(F.sum("_begins").alias("_n")).select(F.col("_part").alias("_p"), (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_earlier"))
    spans = spans.join(begun, spans["_part"] == begun["_p"]).withColumn("group_idx", F.col("_earlier") + F.sum("_begins").over(W.partitionBy("_part").orderBy("_first")) - 1)
    spans = spans.select(*(F.col(g).alias(f"_{i}") for i, g in enumerate(group)), F.col("_part").alias("_of"), (F.col("_base") - F.col("_first")).alias("_shift"), "n", "group_idx")
    same = ranged["_part"] == spans["_of"]
    for i, g in enumerate(group):
        same &= ranged[g].eqNullSafe(spans[f"_{i}"])
    out = staged(ranged.join(spans, same).select(*(ranged[c] for c in df.columns), (F.col("_row") + F.col("_shift")).alias("idx"), "n", "group_idx"), "numbered")
    discard(ranged)
    return out
