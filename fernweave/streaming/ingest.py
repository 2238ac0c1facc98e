"""Incremental ingest and event rollups on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.manage import batch_dedup
from ..sources.snapshots import SnapshotTable


def ingest_records(spark: SparkSession, source: str, schema: StructType | str, target: SnapshotTable, checkpoint: str, keys: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda d: d, files_per_batch: int = 100) -> StreamingQuery:
    """Parquet files that appear in ``source``, in micro-batches, upserted into the target. Within a batch the
    first record of a key counts; the checkpoint makes a restart go on where it stopped, and as an upsert by
    key a batch that runs twice changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        first = batch_dedup(batch.withColumn("_at", F.monotonically_increasing_id()), keys, "_at").drop("_at")
        target.upsert(prepare(first))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_usage(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events counted by type in tumbling windows of event time; for streams and static frames alike."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def fan_out(batch: DataFrame, sinks: list[Callable[[DataFrame], None]]) -> list[str]:
    """Writes a batch to several sinks; one that fails doesn't keep the others from theirs."""
    notes = []
    kept = batch.persist()
    for sink in sinks:
        try:
            sink(kept)
        except Exception as e:
            notes.append(f"{getattr(sink, '__name__', 'sink')}: {type(e).__name__}: {e}")
    kept.unpersist()
    return notes
