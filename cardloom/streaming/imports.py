"""Streams that can stop and go on: line files imported with a ledger, and late echoes joined to what was sent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_hashes(lines: DataFrame, *more: str) -> DataFrame:
    """path and hash of the files of lines (path, value, and columns more that are one for each file): a sum over lines and their number, so a file of any size is hashed in many tasks."""
    sums = lines.groupBy("path", *more).agg(F.sum(F.xxhash64("value").cast("decimal(38,0)")).cast("string").alias("_sum"), F.count(F.lit(1)).alias("_lines"))
    return sums.select("path", *more, F.sha2(F.concat_ws(":", "_sum", "_lines"), 256).alias("hash"))


def changed_files(spark: SparkSession, source: str, target: str) -> DataFrame:
    """path of the files that were imported and hold other lines now; only those of another size or time are read."""
    ledger = spark.read.parquet(f"{target}/ledger")
    now = spark.read.format("binaryFile").load(source).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("_size"), F.col("_metadata.file_modification_time").alias("_time"))
    touched = now.join(ledger, "path").filter((F.col("_size") != F.col("size")) | (F.col("_time") != F.col("time"))).select("path", F.col("hash").alias("_hash"))
    lines = spark.read.text(source).select(F.col("_metadata.file_path").alias("path"), "value")
    return file_hashes(lines.join(touched.select("path"), "path", "left_semi")).join(touched, "path", "right").filter(~F.col("hash").eqNullSafe(F.col("_hash"))).select("path")


def import_lines(spark: SparkSession, source: str, schema: str, target: str, files_per_batch: int = 1) -> StreamingQuery:
    """Import the JSON lines of the files in a folder into target/good, the lines that are no JSON objects into target/rejected, and counts into target/ledger.

    Progress is checkpointed in target/checkpoint: a run that stops, or files that come later, are gone on with by calling this again,
    and a micro-batch that runs again writes the same folders again, so nothing is lost or doubled. The ledger has path, size, time, hash, read and rejected
    of each file; before anything is read, a file that was imported and has other lines now is an error. Empty lines are not read; an empty file has no entry.
    """
    ledger = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/ledger")
    if ledger.getFileSystem(spark._jsc.hadoopConfiguration()).exists(ledger):
        changed = changed_files(spark, source, target).limit(1).collect()
        if changed:
            raise ValueError(f"{changed[0]['path']} has changed since it was imported")

    def write(batch: DataFrame, number: int) -> None:
        lines = batch.filter(F.trim("value") != "").withColumn("_row", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
        lines = lines.withColumn("_bad", F.col("_row._bad").isNotNull() | ~F.trim("value").startswith("{"))
        counts = lines.groupBy("path").agg(F.count(F.lit(1)).alias("read"), F.count_if("_bad").alias("rejected"))
        entries = file_hashes(batch, "size", "time").join(counts, "path", "left").fillna(0, ["read", "rejected"])
        lines.filter("NOT _bad").select("_row.*", "path").drop("_bad").write.mode("overwrite").parquet(f"{target}/good/batch={number}")
        lines.filter("_bad").select("path", "value").write.mode("overwrite").parquet(f"{target}/rejected/batch={number}")
        entries.write.mode("overwrite").parquet(f"{target}/ledger/batch={number}")

    meta = [F.col(f"_metadata.{m}").alias(n) for m, n in (("file_path", "path"), ("file_size", "size"), ("file_modification_time", "time"))]
    files = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source).select("value", *meta)
    return files.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()


def import_state(spark: SparkSession, target: str) -> DataFrame:
    """read, rejected and files of an import so far."""
    return spark.read.parquet(f"{target}/ledger").agg(F.sum("read").alias("read"), F.sum("rejected").alias("rejected"), F.count(F.lit(1)).alias("files"))


def reconciled_echoes(events: DataFrame, late: str = "1 hour", keep_seconds: int = 86_400) -> DataFrame:
    """owner, message_id, job_id, echo_at: each sent message with its earliest echo, given out again when an earlier one comes.

    events: kind (sent or echo), owner, message_id, job_id, status, at. Echoes may come before what was sent; only jobs with status SENT
    are joined. State is one job and one time for each message and goes keep_seconds after its last event, by the watermark. Repeated events change nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        job, echo, given = state.get if state.exists else (None, None, None)
        last = 0
        for rows in batches:
            sent = rows[(rows["kind"] == "sent") & (rows["status"] == "SENT")]
            if job is None and len(sent):
                job = int(sent["job_id"].min())
            times = rows["at"].astype("int64") // 1000
            echoes = times[rows["kind"] == "echo"]
            if len(echoes):
                echo = int(echoes.min()) if echo is None else min(echo, int(echoes.min()))
            last = max(last, int(times.max()))
        out = []
        if job is not None and echo is not None and (given is None or echo < given):
            given = echo
            out.append((key[0], key[1], job, pd.Timestamp(echo, unit="us")))
        state.update((job, echo, given))
        state.setTimeoutTimestamp(max(last // 1000 + keep_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["owner", "message_id", "job_id", "echo_at"]).astype({"echo_at": "datetime64[us]"})

    return (
        events.filter("owner IS NOT NULL AND message_id IS NOT NULL AND at IS NOT NULL")
        .withWatermark("at", late)
        .groupBy("owner", "message_id")
        .applyInPandasWithState(step, "owner string, message_id string, job_id bigint, echo_at timestamp", "job bigint, echo bigint, given bigint", "append", GroupStateTimeout.EventTimeTimeout)
    )


def echoes_of(events: DataFrame) -> DataFrame:
    """What reconciled_echoes comes to over all events: owner, message_id, job_id, echo_at, and matched, false for echoes without a sent job."""
    sent = events.filter("kind = 'sent' AND status = 'SENT'").groupBy("owner", "message_id").agg(F.min("job_id").alias("job_id"))
    echoes = events.filter("kind = 'echo'").groupBy("owner", "message_id").agg(F.min("at").alias("echo_at"))
    return echoes.join(sent, ["owner", "message_id"], "left").select("owner", "message_id", "job_id", "echo_at", F.col("job_id").isNotNull().alias("matched"))
