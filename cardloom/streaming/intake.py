"""Event streams: idempotent intake within a watermark, windowed counts, rate limits by first hit, and merging sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_files(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet event files as they arrive in a folder."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "24 hours") -> DataFrame:
    """Each event once: repeats within the bound are dropped, later ones than the watermark too."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_usage(events: DataFrame, width: str = "1 day", late: str | None = "24 hours") -> DataFrame:
    """Events and value of each user and type in aligned windows, given out when a window can no longer change.

    A stream that has its watermark already, as one of once(), keeps it with late None.
    """
    bounded = events if late is None else events.withWatermark("ts", late)
    grouped = bounded.groupBy(F.window("ts", width).alias("w"), "user_id", "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "user_id", "event_type", "events", "total")


def sliding_usage(events: DataFrame, width: str = "6 hours", slide: str = "1 hour", late: str = "24 hours") -> DataFrame:
    """Events by type in sliding windows; an extra beside the aligned ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), "event_type", "events")


def rate_limited(events: DataFrame, limit: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """user_id, event_id, used, allowed: hits in windows that begin at a user's first hit after the last one ended.

    State is one window start and count for each user; it goes when the watermark passes the
    window's end. Within a micro-batch hits are taken in the order of their times.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event, at in zip(rows["event_id"], rows["ts"].astype("int64") // 1000, strict=True):
            if start is None or at - start >= seconds * 1_000_000:
                start, used = at, 0
            used += 1
            out.append((key[0], event, used, used <= limit))
        state.update((start, used))
        state.setTimeoutTimestamp(max(start // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "used", "allowed"])

    return (
        events.withWatermark("ts", late)
        .select("user_id", "event_id", F.col("ts"))
        .groupBy("user_id")
        .applyInPandasWithState(step, "user_id bigint, event_id bigint, used int, allowed boolean", "start bigint, used int", "append", GroupStateTimeout.EventTimeTimeout)
    )


def merge_latest(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep the last event of each user as a new version of a Parquet table in folder for each micro-batch.

    A batch that runs again after a failure writes the same version again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select("user_id", "ts", "event_id", "event_type")
        if number > 0:
            new = new.unionByName(spark.read.parquet(f"{folder}/version={number - 1}"))
        last = new.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("l")).select("user_id", "l.*")
        last.write.mode("overwrite").parquet(f"{folder}/version={number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
