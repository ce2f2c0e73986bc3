"""The event history as a stream: parsing, day digests, first-seen queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import normalize_text
from ..sources.events import event_digest, parse_events, valid_events


def read_event_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """raw lines (raw, file) of JSON-lines files that arrive in a folder."""
    return (
        spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(folder)
        .select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"))
    )


def event_stream(raw: DataFrame) -> DataFrame:
    """Parsed events with their instant `ts`; the same row-local parse as in batch."""
    return parse_events(raw).withColumn("ts", F.timestamp_millis("epoch_ms"))


def append_event_table(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append new events to a table, then stop: run it on a schedule."""
    return (
        events.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start()
    )


def digest_stream(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events per window and kind. Events later than `late` are not counted: the bound that the
    batch digest does not have, as it reads the whole history each time."""
    valid = events.where("code is null").withWatermark("ts", late)
    return valid.groupBy(F.window("ts", window), "kind").agg(
        F.count(F.lit(1)).cast("bigint").alias("events")
    ).select(F.col("window.start").alias("period_start"), "kind", "events")


def refresh_digest_batch(batch: DataFrame, events: DataFrame, path: str) -> None:
    """Count the days again that a batch of events touches, over the whole event table.

    events is the table that the batch was appended to; path holds the digest, a folder per
    day. However late an event comes, its day is counted as in batch, and a repeated batch
    writes the same again.
    """
    days = batch.where("code is null").select("event_date").distinct()
    touched = event_digest(valid_events(events).join(days, "event_date", "left_semi"))
    touched.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period_start").parquet(path)


def digest_batches(events: DataFrame, table: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append streaming events to a table and keep the digest of every touched day exact, then stop.

    A batch lands in a folder of its own, so that one that is repeated replaces itself.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={epoch}")
        spark = batch.sparkSession
        refresh_digest_batch(spark.read.parquet(f"{table}/batch={epoch}"), spark.read.parquet(table), path)

    return (
        events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start()
    )


def first_queries(queries: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (model, normalised query) once within the watermark: what has to be embedded.

    queries(ts, model, query), streaming.
    """
    keyed = queries.withColumn("normalized", normalize_text(F.col("query")))
    return keyed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["model", "normalized"])
