"""Event intake and queues as tables: idempotency, lateness, windows, latest states, transitions and task graphs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.expr import choose

#: The tasks of a crop and what each waits for.
CROP_TASKS = {"normalize": [], "ocr": ["normalize"], "embed": ["normalize"], "retrieve": ["embed"], "rerank": ["ocr", "retrieve"], "adjudicate": ["rerank"], "price": ["adjudicate"]}


def intake(events: DataFrame, key: list[str], time: str, now: Column, payload: str, max_age: str = "24 hours", ahead: str = "5 minutes") -> DataFrame:
    """Events with outcome: late, early, accepted, duplicate, or conflict for a repeat with another payload."""
    first = Window.partitionBy(*key).orderBy(time, payload)
    out = events.withColumn("_turn", F.row_number().over(first)).withColumn("_first", F.first(payload).over(first))
    at = F.col(time)
    outcome = choose([(at < now - F.expr(f"INTERVAL {max_age}"), "late"), (at > now + F.expr(f"INTERVAL {ahead}"), "early"), (F.col("_turn") == 1, "accepted"), (F.col("_first").eqNullSafe(F.col(payload)), "duplicate")], "conflict")
    return out.withColumn("outcome", outcome).drop("_turn", "_first")


def tumbling_counts(events: DataFrame, time: str, width: str, *by: str) -> DataFrame:
    """Events in aligned windows."""
    return events.groupBy(F.window(time, width).alias("_w"), *by).agg(F.count(F.lit(1)).alias("events")).select(F.col("_w.start").alias("start"), *by, "events")


def first_hit_windows(events: DataFrame, key: str, time_us: str, width_us: int, limit: int) -> DataFrame:
    """key, at, used, allowed: hits of each key in windows that begin at its first hit after the last one ended.

    The windows depend on what came before, so a key's times are folded in order: they are one
    stream through one task, read in batches; the start of the window and its hits are all that is kept.
    """
    hits = events.filter(F.col(time_us).isNotNull()).select(F.col(key), F.col(time_us).cast("long").alias("at"))
    dealt = hits.repartition(key).sortWithinPartitions(key, "at")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, used = object(), 0, 0
        for batch in batches:
            counts = []
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != now or at - start >= width_us:
                    now, start, used = name, at, 0
                used += 1
                counts.append(used)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int32())], [key, "at", "used"])

    folded = dealt.mapInArrow(fold, f"`{key}` {hits.schema[key].dataType.simpleString()}, at bigint, used int")
    return folded.withColumn("allowed", F.col("used") <= limit)


def latest_of(rows: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of each key's last row in order, and how many rows it has; sums in each task before the shuffle."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last"), F.count(F.lit(1)).alias("rows")).select(*key, "_last.*", "rows")


def transition(jobs: DataFrame, now: Column) -> DataFrame:
    """The next status of outbox jobs after an attempt (outcome), and of leases that have run out."""
    expired = (F.col("status") == "LEASED") & (F.col("lease_until") < now)
    tries = F.col("attempts") + 1
    after = choose(
        [(F.col("status").isin("SENT", "DEAD_LETTER"), F.col("status")), (F.col("outcome") == "ok", "SENT"), ((F.col("outcome") == "retry") & (tries < F.col("max_attempts")), "RETRY_WAIT"), (F.col("outcome").isin("retry", "fail"), "DEAD_LETTER"), (expired, "DELIVERY_UNKNOWN")],
        F.col("status"),
    )
    wait = F.when(after == "RETRY_WAIT", now + F.make_dt_interval(secs=tries * 30))
    return jobs.withColumns({"next_status": after, "available_at": wait})


def claim(jobs: DataFrame, now: Column, n: int, by: str) -> DataFrame:
    """The first n due jobs of each owner, in the order of availability and age."""
    due = jobs.filter(F.col("status").isin("PENDING", "RETRY_WAIT") & (F.col("due_at") <= now))
    return due.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy("due_at", "job_id"))).filter(F.col("turn") <= n)


def crop_tasks(crops: DataFrame, key: str) -> DataFrame:
    """One row for each crop and task with the ids of the tasks it depends on."""
    named = lambda t: F.concat_ws(":", F.col(key).cast("string"), F.lit(t))
    made = [F.struct(named(t).alias("task_id"), F.lit(t).alias("task"), F.array(*[named(d) for d in waits]).cast("array<string>").alias("depends_on")) for t, waits in CROP_TASKS.items()]
    return crops.select("*", F.inline(F.array(*made)))


def readiness(tasks: DataFrame) -> DataFrame:
    """task_id with ready and blocked: whether all it depends on is done, and whether any of it failed."""
    needs = tasks.select("task_id", F.explode_outer("depends_on").alias("_need"))
    states = tasks.select(F.col("task_id").alias("_need"), F.col("status").alias("_state"))
    done = F.col("_need").isNull() | F.coalesce(F.col("_state").isin("complete", "skipped"), F.lit(False))
    failed = F.coalesce(F.col("_state").isin("failed", "dead_letter"), F.lit(False))
    g = needs.join(states, "_need", "left").groupBy("task_id").agg(F.every(done).alias("_done"), F.some(failed).alias("_failed"))
    waiting = F.col("status").isin("pending", "retry_wait")
    return tasks.join(g, "task_id").withColumns({"ready": waiting & F.col("_done"), "blocked": (F.col("status") == "pending") & F.col("_failed")}).drop("_done", "_failed")


def job_status(tasks: DataFrame, job: str) -> DataFrame:
    """complete when every task has ended well, review on a failure, else running."""
    ended = F.every(F.col("status").isin("complete", "skipped", "cancelled"))
    bad = F.some(F.col("status").isin("failed", "dead_letter"))
    return tasks.groupBy(job).agg(F.when(ended, "complete").when(bad, "review").otherwise("running").alias("job_status"), F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("status") == "complete").alias("done"))


#: Kinds of failures in the order in which they are tried: status codes, patterns of messages, code, whether to try again and how to wait.
FAILURES = [
    ([429], ["rate.?limit", "too many requests", "quota"], "RATE_LIMITED", True, "provider"),
    ([408, 502, 503, 504], ["timeout", "temporar", "unavailable", "overload", "busy"], "TRANSIENT_PROVIDER_FAILURE", True, "transient"),
    ([413], ["payload too large"], "PAYLOAD_TOO_LARGE", False, None),
    ([], ["invalid image", "decode", "unsupported image", "corrupt"], "INVALID_IMAGE", False, None),
    ([], ["out of memory", "cuda.*memory", "oom"], "GPU_OOM", True, "smaller_batch"),
    ([], ["model.*missing", "configuration", "credential", "unauthorized", "forbidden"], "CONFIGURATION_ERROR", False, None),
]


def failure_class(status: Column, message: Column, code: Column | None = None) -> Column:
    """A struct of code, retryable and backoff for a task's failure, by its status and message; passing and unknown failures keep a code of their own."""
    text = F.lower(F.coalesce(message, F.lit("")))
    own = F.nullif(F.upper(F.coalesce(code, F.lit(""))) if code is not None else F.lit(""), F.lit(""))
    made = lambda name, again, wait: F.struct(name.alias("code"), F.lit(again).alias("retryable"), F.lit(wait).cast("string").alias("backoff"))
    kinds = []
    for codes, patterns, name, again, wait in FAILURES:
        shown = F.coalesce(own, F.lit(name)) if name == "TRANSIENT_PROVIDER_FAILURE" else F.lit(name)
        met = text.rlike("|".join(patterns))
        kinds.append((F.coalesce(status.isin(codes), F.lit(False)) | met if codes else met, made(shown, again, wait)))
    return choose(kinds, made(F.coalesce(own, F.lit("UNKNOWN_TASK_FAILURE")), False, None))

