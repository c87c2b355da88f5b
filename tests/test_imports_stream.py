import json
import random

import pytest
from pyspark.sql import functions as F

from cardloom.streaming import imports as S


def put(folder, name, lines):
    (folder / name).write_text("\n".join(lines) + "\n")


def test_an_import_stops_goes_on_and_rejects(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    schema = "id int, name string"
    put(source, "a.ndjson", ['{"id": 1, "name": "x"}', "", "no json", '{"id": 2}', "[1]"])
    S.import_lines(spark, str(source), schema, str(target)).awaitTermination()
    state = S.import_state(spark, str(target)).first()
    assert (state["read"], state["rejected"], state["files"]) == (4, 2, 1)

    put(source, "b.ndjson", ['{"id": 3}', '{"id": "bad"}'])
    put(source, "c.ndjson", ['{"id": 4}'])
    S.import_lines(spark, str(source), schema, str(target)).awaitTermination()
    good = spark.read.parquet(f"{target}/good")
    assert sorted(r["id"] for r in good.collect()) == [1, 2, 3, 4]
    assert sorted(r["value"] for r in spark.read.parquet(f"{target}/rejected").collect()) == ["[1]", "no json", '{"id": "bad"}']
    state = S.import_state(spark, str(target)).first()
    assert (state["read"], state["rejected"], state["files"]) == (7, 3, 3)

    # nothing new: the same table
    S.import_lines(spark, str(source), schema, str(target)).awaitTermination()
    assert spark.read.parquet(f"{target}/good").count() == 4


def test_a_batch_that_fails_half_way_is_done_again_once(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    put(source, "a.ndjson", [json.dumps({"id": i}) for i in range(50)])
    (target / "good").mkdir(parents=True)
    (target / "good" / "batch=0").write_text("in the way")
    (target / "good" / "batch=0").chmod(0o000)
    blocked = target / "rejected"
    blocked.write_text("a file where the folder must be")
    with pytest.raises(Exception):  # noqa: B017
        S.import_lines(spark, str(source), "id int", str(target)).awaitTermination()
    blocked.rename(tmp_path / "moved")
    S.import_lines(spark, str(source), "id int", str(target)).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{target}/good").collect()) == list(range(50))
    assert S.import_state(spark, str(target)).first()["read"] == 50


def test_a_changed_file_is_an_error(spark, tmp_path):
    import os

    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    put(source, "a.ndjson", ['{"id": 1}'])
    S.import_lines(spark, str(source), "id int", str(target)).awaitTermination()
    put(source, "b.ndjson", ['{"id": 2}'])
    S.import_lines(spark, str(source), "id int", str(target)).awaitTermination()
    put(source, "a.ndjson", ['{"id": 9}'])
    os.utime(source / "a.ndjson", (2_000_000_000, 2_000_000_000))
    os.utime(source / "b.ndjson", (2_000_000_000, 2_000_000_000))  # touched, with the lines that it had
    with pytest.raises(ValueError, match="a.ndjson has changed"):
        S.import_lines(spark, str(source), "id int", str(target)).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{target}/good").collect()) == [1, 2]


def test_echoes_in_any_order_give_the_batch_answer(spark, tmp_path):
    draw = random.Random(6)
    rows = []
    for m in range(40):
        owner, at = f"o{m % 3}", 1_700_000_000 + m * 10
        if m % 5:
            rows.append(("sent", owner, f"m{m}", m, "SENT" if m % 7 else "FAILED", at))
        rows += [("echo", owner, f"m{m}", None, None, at + draw.randrange(60)) for _ in range(draw.randrange(3))]
    rows += draw.sample(rows, 20)
    draw.shuffle(rows)
    schema = "kind string, owner string, message_id string, job_id bigint, status string, at bigint"
    whole = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("at"))
    for part in range(3):
        whole.filter(F.pmod(F.xxhash64(*whole.columns), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    query = S.reconciled_echoes(stream).writeStream.format("memory").queryName("echoes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.table("echoes").groupBy("owner", "message_id", "job_id").agg(F.min("echo_at").alias("echo_at"))
    wanted = S.echoes_of(whole).filter("matched").select("owner", "message_id", "job_id", "echo_at")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, wanted.collect()))
    assert S.echoes_of(whole).filter("NOT matched").count() > 0
