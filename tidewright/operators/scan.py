"""Ordered scans with carried state.

A scan sorts every series once and streams it through a step function in Arrow batches. State goes from batch
to batch, so a series of any length needs the memory of one batch, and many series share a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: State of a series -> (arrays of one stretch of it) -> arrays to return; made anew for each series.
Step = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]


def ordered_scan(df: DataFrame, by: list[str], order: list[str], columns: list[str], make: Callable[[], Step], out: dict[str, T.DataType], keep: list[str] | None = None) -> DataFrame:
    """Run ``make()`` over each series of ``df``.

    The step gets the named columns of a stretch (nulls as NaN) and returns one array per ``out`` column, as long as the
    stretch. ``keep`` columns (default: keys and order) come along. ``order`` must be total.
    """
    keep = keep or [*by, *order]
    need = list(dict.fromkeys([*by, *keep, *columns]))
    schema = T.StructType([*(df.schema[k] for k in keep), *(T.StructField(n, t) for n, t in out.items())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(need.index(k)).to_pylist() for k in by), strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if step is None or keys[a] != key:
                    key, step = keys[a], make()
                part = batch.slice(a, b - a)
                values = {c: part.column(need.index(c)).to_numpy(zero_copy_only=False) for c in columns}
                made = step(values)
                arrays = [part.column(need.index(k)) for k in keep]
                arrays += [pa.array(made[n], f.type, from_pandas=True) for n, f in zip(out, list(arrow)[len(keep) :], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.select(*need).repartition(n, *by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def sessions(df: DataFrame, by: list[str], order: list[str], columns: list[str], make: Callable[[], object], schema: T.StructType) -> DataFrame:
    """Run an object per series that takes rows and now and then emits one.

    ``make()`` gives an object with ``push(row) -> list of tuples`` and ``close() -> list of tuples``; tuples are rows of
    ``schema`` without the keys, which come first.
    """
    need = [*by, *columns]
    full = T.StructType([*(df.schema[k] for k in by), *schema.fields])
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, rows = None, None, []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
            rows.clear()
            return out

        for batch in batches:
            lists = [c.to_pylist() for c in batch.columns]
            for values in zip(*lists, strict=True):
                k, row = values[: len(by)], values[len(by) :]
                if k != key:
                    if state is not None:
                        rows.extend((*key, *r) for r in state.close())
                    key, state = k, make()
                rows.extend((*k, *r) for r in state.push(row))
            if len(rows) > 4096:
                yield flush()
        if state is not None:
            rows.extend((*key, *r) for r in state.close())
        if rows:
            yield flush()

    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.select(*need, *[o for o in order if o not in need]).repartition(n, *by).sortWithinPartitions(*by, *order).select(*need).mapInArrow(run, full)
