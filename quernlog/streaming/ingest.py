"""Streaming ingest: change-log files as a stream, into a store or into last-writer-wins state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.versions import live
from ..sources.store import Store, scratch_folder

RECORD = ("value", "rec_type", "seq", "ts")


def read_changes(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """New files under ``path`` as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def into_store(changes: DataFrame, store: Store, checkpoint: str, available_now: bool = True, delay: int | None = None) -> StreamingQuery:
    """Apply each micro-batch as one run, and compact where that is due.

    A batch that is replayed after a failure writes records that are already there, which changes no
    read.  With ``delay`` (of ts) the store's watermark follows the newest record at that distance, and
    records that are later than that are dropped; without it nothing is, and tombstones stay.
    """

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            store.apply(rows, late="refuse" if delay is None else "drop")
            if delay is not None:
                store.advance(store.newest() - delay)
            store.compact_where_due()

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
    store.streams.append(query)
    return query


def latest_state(changes: DataFrame) -> DataFrame:
    """Each key's newest record as streaming state; it grows with the keys, as nothing expires."""
    newest = F.max_by(F.struct(*RECORD), F.struct("ts", "seq"))
    return changes.groupBy("key").agg(newest.alias("r")).select("key", "r.*")


def into_table(state: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what each micro-batch changed of a streaming state under ``path``; a batch that is replayed overwrites its own part."""

    def batch(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return state.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live snapshot of ``events``, computed as a stream that runs until all files are read; the state stays with the executors."""
    from ..plans.events import as_change_log

    path = scratch_folder(spark, "states")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A file source takes a folder and a pattern of names.
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    state = latest_state(as_change_log(events).select("key", *RECORD))
    into_table(state, f"{path}/state", f"{path}/checkpoint").awaitTermination()
    return live(spark.read.schema(state.schema).parquet(f"{path}/state")).select("key", "value", "ts", "seq")
