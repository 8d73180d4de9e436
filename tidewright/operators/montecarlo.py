"""Resampled equity paths of a ledger."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.sources.staging import staged

PRIME = 2**31 - 1
#: Trades of the ledger for each stretch of a path; a stretch is sorted in one piece.
STRETCH = 2**20
#: Stretches, of any path, for each task that sorts them.
SHARE = 16
#: Trades that a task deals out to all paths at a time.
BLOCK = 2**18
#: Distribution function of Poisson(1), for draws by inversion.
EDGES = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]


def _first(ids: np.ndarray) -> np.ndarray:
    return np.fmod(ids * 48271 + 11, PRIME)


def _hashed(first: np.ndarray, path: int, salt: int) -> np.ndarray:
    """Squares modulo a prime: a hash that any engine can repeat."""
    second = np.fmod(first * first + (path * 69621 + salt), PRIME)
    return np.fmod(second * second + first, PRIME)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            held.append(batch.slice(at, BLOCK))
            n += held[-1].num_rows
            if n >= BLOCK:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _drawn(table: pa.Table, paths: int, seed: int, bootstrap: bool, stretches: int) -> Iterator[tuple]:
    """Per path: its number, and of the trades that it draws the rows, the stretches and the growths (times drawn x logarithm)."""
    first = _first(table["id"].to_numpy())
    growth = pc.fill_null(table["growth"], 0.0).to_numpy()
    rows = np.arange(len(first))
    for path in range(1, paths + 1):
        if bootstrap:
            u, times = _hashed(first, path, seed) / float(PRIME), np.zeros(len(first), np.int8)
            for e in EDGES:
                times += u >= e
            rows = np.flatnonzero(times)
        # Places below 0, of ids below 0, come first as well.
        stretch = np.maximum(_hashed(first[rows], path, seed + 1) * stretches // PRIME, 0)
        yield path, rows, stretch, growth[rows] * times[rows] if bootstrap else growth


def _sums(paths: int, seed: int, bootstrap: bool, stretches: int) -> Callable:
    """What each stretch of each path grows by in a task's trades; null where no return is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros((paths, stretches)), np.zeros((paths, stretches), np.int64)
        for table in _blocks(batches):
            valid = table["growth"].is_valid().to_numpy()
            for path, rows, stretch, growth in _drawn(table, paths, seed, bootstrap, stretches):
                total[path - 1] += np.bincount(stretch, growth, stretches)
                known[path - 1] += np.bincount(stretch, None if valid.all() else valid[rows], stretches).astype(np.int64)
        path, stretch = np.divmod(np.arange(paths * stretches), stretches)
        yield pa.RecordBatch.from_arrays([pa.array(path + 1, pa.int32()), pa.array(stretch, pa.int32()), pa.array(total.ravel(), mask=known.ravel() == 0)], ["path", "stretch", "total"])

    return run


def _deal(paths: int, seed: int, bootstrap: bool, stretches: int) -> Callable:
    """A row per block of trades, path and stretch, with the ids and growths of those drawn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            ids = table["id"].to_numpy()
            for path, rows, stretch, growth in _drawn(table, paths, seed, bootstrap, stretches):
                order = np.argsort(stretch.astype(np.min_scalar_type(stretches)), kind="stable")
                counts = np.bincount(stretch, minlength=stretches)
                some = np.flatnonzero(counts)
                ends = pa.py_buffer(np.concatenate([[0], np.cumsum(counts[some])]).astype(np.int32) * np.int32(8))
                packed = [pa.Array.from_buffers(pa.binary(), len(some), [None, ends, pa.py_buffer(x[order])]) for x in (ids[rows], growth)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), path), pa.int32()), pa.array(some, pa.int32()), *packed], ["path", "stretch", "ids", "growths"])

    return run


def _walk(seed: int) -> Callable:
    """Lowest and highest equity of a stretch and its deepest fall from its own peaks, as a share that is left."""

    def run(table: pa.Table) -> pa.Table:
        ids, growth = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table[n]]) for n, t in (("ids", np.int64), ("growths", np.float64)))
        path, stretch, known, so_far = (table[n][0].as_py() for n in ("path", "stretch", "known", "so_far"))
        place = _hashed(_first(ids), path, seed + 1)
        order = np.argsort(place)
        # Places that several trades share, next to one another by now, go by id.
        place = place[order]
        same = place[1:] == place[:-1]
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        order[tied] = order[tied][np.lexsort((ids[order[tied]], place[tied]))]
        growth = growth[order]
        with np.errstate(over="ignore", invalid="ignore"):
            equity = np.exp(so_far + np.cumsum(growth))
            top = np.maximum.accumulate(equity)
            # NaN counts as the largest value.
            low, within = np.fmin.reduce(equity), np.fmin.reduce(equity / top)
        row = {"path": path, "stretch": stretch, "total": growth.sum() if known else None, "low": low, "top": top[-1], "within": within}
        return pa.table({n: pa.array([x], pa.int32() if n in ("path", "stretch") else pa.float64()) for n, x in row.items()})

    return run


def resampled_paths(ledger: DataFrame, column: str, paths: int = 50, seed: int = 42, method: str = "bootstrap") -> DataFrame:
    """``path, total_return, max_drawdown, final`` of trades in percent, compounded at one hundredth of each trade's return.

    ``bootstrap`` draws trades with replacement by Poisson weights of a hash (each trade 0, 1, 2, ... times), ``shuffle`` only
    reorders. Both are functions of (seed, path, trade), so reruns agree and trades are never collected. ``id`` must be unique.
    A path is cut into stretches by the leading part of its order, as many as the ledger needs; each carries in the equity and the
    peak that the stretches before it leave. Trades are dealt out to paths and stretches in packed blocks, one shuffle of 16 bytes
    for each trade that a path draws.
    """
    if method not in ("bootstrap", "shuffle"):
        raise ValueError(f"unknown method: {method}")
    parts = max(1, int(ledger.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Read for their number, for the sums and for the paths, of which each part makes many rows.
    trades = staged(ledger.select(F.col("id").cast("long").alias("id"), F.log1p(F.col(column) / 10_000).alias("growth")).filter("id IS NOT NULL").repartition(parts, "id"))
    stretches = max(1, -(-trades.count() // STRETCH))
    how = (paths, seed, method == "bootstrap", stretches)
    before = Window.partitionBy("path").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = trades.mapInArrow(_sums(*how), "path int, stretch int, total double").groupBy("path", "stretch").agg(F.sum("total").alias("total"))
    # Staged, as a broadcast that waits for work runs into its time limit.
    sums = staged(sums.select("path", "stretch", F.col("total").isNotNull().alias("known"), F.coalesce(F.sum("total").over(before), F.lit(0.0)).alias("so_far")))
    dealt = trades.mapInArrow(_deal(*how), "path int, stretch int, ids binary, growths binary").repartition(max(parts, paths * stretches // SHARE), "path", "stretch")
    ends = dealt.join(F.broadcast(sums), ["path", "stretch"]).groupBy("path", "stretch").applyInArrow(_walk(seed), "path int, stretch int, total double, low double, top double, within double")
    # A fall is from the peak of the stretch or of those before it, whichever is higher; it is undefined (NaN, the largest) between infinite values.
    peak = F.greatest(F.lit(1.0), F.max("top").over(before))
    ends = ends.withColumn("left", F.when(F.col("low") == float("inf"), F.lit(float("nan"))).otherwise(F.least(F.col("low") / peak, "within")))
    # Stretches are added up in their order, which reruns share.
    whole = before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.withColumn("growth", F.sum("total").over(whole))
    out = ends.groupBy("path").agg(F.exp(F.first("growth")).alias("final"), (F.min("left") - 1).alias("max_drawdown"))
    return out.select("path", "final", F.when(F.col("final").isNotNull(), F.col("max_drawdown")).alias("max_drawdown"), (F.col("final") - 1).alias("total_return"))
