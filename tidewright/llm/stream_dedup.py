"""Exact deduplication as a stateful stream.

A stream of documents is reduced to one state entry for each distinct text: the digest of the
normalised text as key, and as value the earliest row seen (its stable id and the locator of
its content: file and row) with the number of rows. The state is kept in RocksDB on the
executors' disks, with change logs in the shared folder, and never expires; a lost executor's
part is rebuilt from there, and the next run over the same state folder goes on where the last
one ended. A digest that has been seen is only a hit: the locator leads to the stored content
and the full bytes are compared. Rows whose bytes differ are grouped among themselves.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, staged

SPACES = r"[\x20\x09-\x0D]+"
#: For one micro-batch; a larger backlog is worked off in several.
FILES_PER_BATCH = 100_000
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.minBatchesToRetain": "2",
    # A store's local files go when its task has committed, so disk follows the running tasks and not the number of partitions.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: Column) -> Column:
    """White space runs as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


@contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _keyed(docs: DataFrame) -> DataFrame:
    """``digest`` of the normalised text, ``norm``, and ``who``: the row's id and locator, in order of precedence."""
    norm = normalised(docs["text"])
    who = F.struct(docs["doc_id"].isNull().alias("no_id"), docs["doc_id"].alias("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return docs.select(F.unhex(F.sha2(norm, 256)).alias("digest"), norm.alias("norm"), who.alias("who"))


def _as_glob(path: str) -> str:
    """A pattern that matches ``path`` alone: streams take a single file only as the match of a pattern."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def run_stream(spark: SparkSession, path: str, state_dir: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Feed every file under ``path`` that the state has not seen; return the state: ``digest, first, n``.

    ``first`` is the earliest row: smallest id (nulls last), then file and row.
    """
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(_as_glob(path))
    state = _keyed(stream).groupBy("digest").agg(F.min("who").alias("first"), F.count("*").alias("n"))
    with _settings(spark, STATE_CONF):
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", state_dir).trigger(availableNow=True).start()
        query.awaitTermination()
        kept = spark.read.format("statestore").load(state_dir)
        value = kept.schema["value"].dataType.names
        return staged(kept.select(F.col("key.digest").alias("digest"), F.col("value")[value[0]].alias("first"), F.col("value")[value[1]].alias("n")), "dedup-state")


def dedup_exact(spark: SparkSession, path: str, state_dir: str | None = None, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """One row per document under ``path``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are, after each run of ASCII white space has become one space; null counts as empty, so
    null and empty texts form one group. Of equal texts the row with the smallest ``doc_id`` stays, null ids last; of rows that
    share that id, the first by file and row. An empty table gives an empty result; other columns are not read.
    """
    state = run_stream(spark, path, state_dir or new_path(spark, "dedup-stream"), files_per_batch)
    docs = spark.read.parquet(path)
    rows = _keyed(docs).select("digest", "who").join(state, "digest")
    clashes = _clashes(docs, state)
    if not clashes.isEmpty():
        groups = clashes.groupBy("digest", "norm").agg(F.min("who").alias("_first"), F.count("*").alias("_n"))
        moved = clashes.join(groups, ["digest", "norm"]).select(F.col("digest").alias("_digest"), F.col("who").alias("_who"), "_first", "_n")
        gone = clashes.groupBy("digest").agg(F.count("*").alias("_gone"))
        rows = (
            rows.join(gone, "digest", "left")
            .join(moved, (F.col("digest") == F.col("_digest")) & (F.col("who.file") == F.col("_who.file")) & (F.col("who.row") == F.col("_who.row")), "left")
            .select("digest", "who", F.coalesce("_first", "first").alias("first"), F.coalesce("_n", F.col("n") - F.coalesce("_gone", F.lit(0))).alias("n"))
        )
    return rows.select(
        F.col("who.doc_id").alias("doc_id"),
        F.col("first.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        ((F.col("who.file") == F.col("first.file")) & (F.col("who.row") == F.col("first.row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _clashes(docs: DataFrame, state: DataFrame) -> DataFrame:
    """Rows whose digest was a hit but whose bytes differ from the stored content: ``digest, norm, who``."""
    hits = _keyed(docs).join(state.filter("n > 1").select("digest", "first"), "digest")
    hits = staged(hits, "dedup-hits")
    stored = hits.filter((F.col("who.file") == F.col("first.file")) & (F.col("who.row") == F.col("first.row"))).select("digest", F.col("norm").alias("stored"))
    return staged(hits.join(stored, "digest").filter("norm != stored").select("digest", "norm", "who"), "dedup-clashes")
