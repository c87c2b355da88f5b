import pytest
from pyspark.sql import functions as F

from cardloom.streaming import intake


@pytest.fixture
def folder(spark, tmp_path):
    """Two files of January events: the second repeats some of the first."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts")
    rows = events.collect()
    half = len(rows) // 2
    for name, part in (("a", rows[:half]), ("b", rows[half - 5 :])):
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / name))
    return str(tmp_path / "in" / "*"), rows


def run(stream, name, mode, spark, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_repeats_are_taken_once(spark, folder, tmp_path):
    path, rows = folder
    got = run(intake.once(intake.event_files(spark, path)), "once", "append", spark, tmp_path)
    assert sorted(r["event_id"] for r in got) == sorted(r["event_id"] for r in rows)


def test_rate_limit_state_lives_across_batches(spark, tmp_path):
    base = spark.range(12).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 10).alias("ts"), F.lit(1).cast("bigint").alias("user_id"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    base.filter("event_id < 6").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    base.filter("event_id >= 6").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    got = run(intake.rate_limited(intake.event_files(spark, str(tmp_path / "in/*")), 3, 60), "limited", "append", spark, tmp_path)
    assert sorted((r["event_id"], r["used"], r["allowed"]) for r in got) == [(i, i % 6 + 1, i % 6 < 3) for i in range(12)]


def test_merging_sink_keeps_the_latest(spark, folder, tmp_path):
    path, rows = folder
    intake.merge_latest(intake.event_files(spark, path), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    versions = sorted((tmp_path / "out").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    got = {r["user_id"]: r["event_id"] for r in spark.read.parquet(str(versions[-1])).collect()}
    expected = {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
        expected[r["user_id"]] = r["event_id"]
    assert got == expected


def test_windowed_counts_match_the_batch_query(spark, folder, tmp_path):
    path, rows = folder
    stream = intake.windowed_usage(intake.once(intake.event_files(spark, path)), late=None)
    got = {(r["start"], r["user_id"], r["event_type"]): r["events"] for r in run(stream, "usage", "append", spark, tmp_path)}
    days = {}
    for r in rows:
        key = (r["ts"].replace(hour=0, minute=0, second=0, microsecond=0), r["user_id"], r["event_type"])
        days[key] = days.get(key, 0) + 1
    assert got and all(days[k] == n for k, n in got.items())
