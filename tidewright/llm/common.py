"""Helpers shared by the corpus operators: shared storage, staged tables, text predicates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch that goes to a Python worker, unless the session has a value of its own: rows are texts of any
#: length, so a limit on their number alone bounds no memory.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "4m"
#: Shuffle files of a query go when it ends, not when the driver happens to collect garbage.
_CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def bounded_batches(spark: SparkSession) -> None:
    """Limit the bytes of Arrow batches in this session, where it has no limit of its own."""
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, BATCH_BYTES)


def lean(run: Callable) -> Callable:
    """A batch function that gives its memory back when its rows are through: Python workers are reused, what one task leaves
    behind would add to the next one's.
    """

    def through(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return through


def give_back() -> None:
    import ctypes
    import gc

    import pyarrow

    gc.collect(1)  # what the task made is young
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or the folder set by ``setCheckpointDir``.

    Only in local mode, where all are one machine, a missing setting is made up for by a temporary folder; a cluster without it
    is an error, as its executors would write to their own disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get().rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = "file://" + tempfile.mkdtemp(prefix="tidewright-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    The plan is cut there: what follows neither repeats the work above nor depends on
    executors that held its shuffle files, which go when the table is written.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = new_path(spark, name)
    with settings(spark, _CLEANUP):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables. Only those whose every reader has been written itself: a lost executor must not need them again."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Spark's own runtime Bloom filters, from small tables on: at most 8 MB of bits however many keys.
_BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1MB",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB",
}


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """Session settings for the time of a block."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def staged_selective(df: DataFrame, name: str) -> DataFrame:
    """:func:`staged`, for inner joins that need few rows of a large table: those are picked before the shuffle."""
    with settings(df.sparkSession, _BLOOM):
        return staged(df, name)


def picked(keys: DataFrame, column: str) -> DataFrame:
    """``keys``, marked as a selection (by a condition that all rows meet), which is what makes Spark derive a filter from it."""
    return keys.filter(F.pmod(F.hash(column), F.lit(1)) == 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, compared as Spark does (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name
