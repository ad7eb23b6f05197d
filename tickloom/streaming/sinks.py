"""Sinks: append tables, revised tables and periodic snapshots."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.slots import interval_scope
from ..sources.snapshots import add, capture, compact, load, parts_of, save
from .stateful import state_store

MIN_SAVE_SECONDS = 60
#: Parts of a saved snapshot before they are summed up.
PARTS = 16


def append_table(stream: DataFrame, path: str, trigger: dict) -> StreamingQuery:
    """Append-mode results as a parquet table (exactly once)."""
    with state_store(stream.sparkSession):
        return (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{path}/data")
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(**trigger)
            .start()
        )


def revised_table(stream: DataFrame, path: str, trigger: dict, keys: Sequence[str] = (), parts: int = PARTS) -> StreamingQuery:
    """Update-mode results, one partition per micro-batch.

    A replayed micro-batch overwrites its own partition.  With ``keys`` the
    partitions are summed up to the newest revision of every row whenever there
    are ``parts`` of them (:func:`compact_revisions`).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch_id={batch_id}")
        if keys and (batch_id + 1) % parts == 0:
            compact_revisions(batch.sparkSession, path, keys, batch_id)

    return (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**trigger)
        .start()
    )


def compact_revisions(spark: SparkSession, path: str, keys: Sequence[str], batch_id: int) -> None:
    """The newest revisions up to ``batch_id`` as one partition in place of that micro-batch's and those before.

    It is written beside them first.  A reader that meets both it and older
    partitions still takes the newest of every row, as the values are the same.
    """
    rows = spark.read.parquet(f"{path}/data").filter(F.col("batch_id") <= batch_id)
    older = [r[0] for r in rows.select("batch_id").distinct().collect() if r[0] < batch_id]  # fewer than ``parts``
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v")).select(*keys, "v.*")
    beside = f"{path}/compacted/{batch_id}"
    newest.write.mode("overwrite").parquet(beside)
    spark.read.parquet(beside).write.mode("overwrite").parquet(f"{path}/data/batch_id={batch_id}")
    for name in [*(f"data/batch_id={n}" for n in sorted(older)), f"compacted/{batch_id}"]:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def latest(spark: SparkSession, path: str, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Newest revision of every row of a revised table."""
    rows = spark.read.parquet(f"{path}/data")
    return rows.groupBy(*keys).agg(F.max_by(value, "batch_id").alias(value))


def save_trigger(granularity: int) -> dict:
    """Snapshots are at least a minute and a slot apart."""
    return {"processingTime": f"{max(MIN_SAVE_SECONDS, granularity)} seconds"}


def snapshot_writer(
    path: str, granularity: int, restore_from: str | None = None, retention: int = 0, parts: int = PARTS
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that keeps a saved snapshot up to date.

    A micro-batch adds a part with the slots it touched; one that is repeated
    changes nothing.  From ``parts`` parts on they are summed up, and slots older
    than ``retention`` seconds go.  ``restore_from`` is the snapshot to start from.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = parts_of(spark, path)
        if restore_from is not None and restore_from != path and not before:
            save(load(spark, restore_from, granularity), path)
        batch = batch.persist()  # read by all three tables
        add(capture(batch, interval_scope(batch), granularity), path, batch_id)
        batch.unpersist()
        if len(before) + 1 >= parts:
            compact(spark, path, granularity, retention)

    return write


def save_snapshots(
    reports: DataFrame,
    path: str,
    granularity: int,
    trigger: dict | None = None,
    restore_from: str | None = None,
    retention: int = 0,
    parts: int = PARTS,
) -> StreamingQuery:
    """Save the slots of a report stream (``inst_id, source, t, slot, value...``)."""
    return (
        reports.writeStream.foreachBatch(snapshot_writer(path, granularity, restore_from, retention, parts))
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or save_trigger(granularity)))
        .start()
    )
