import random

import pytest
from pyspark.sql import functions as F

from cardloom.operators import evaluation as E
from cardloom.operators.events import failure_class


def chosen(positives, negatives):
    best = None
    for t in {*E.TRIED, *positives, *negatives}:
        tp, fp = sum(s >= t for s in positives), sum(s >= t for s in negatives)
        tpr, fpr = tp / max(1, len(positives)), fp / max(1, len(negatives))
        best = max(best, (tpr - 8 * fpr, -fpr, tpr, t, tp, fp)) if best else (tpr - 8 * fpr, -fpr, tpr, t, tp, fp)
    _, less, tpr, t, tp, fp = best
    return round(max(0.74, min(0.94, t)), 4), t, round(tpr, 4), round(-less, 4), tp, len(positives) - tp, fp, len(negatives) - fp


@pytest.mark.parametrize("seed", [1, 2])
def test_threshold_against_every_candidate(spark, seed):
    draw = random.Random(seed)
    positives = [round(draw.betavariate(6, 2), 2) for _ in range(200)]
    negatives = [round(draw.betavariate(2, 4), 2) for _ in range(300)]
    rows = [(s, True) for s in positives] + [(s, False) for s in negatives] + [(None, True)]
    found = E.grouping_threshold(spark.createDataFrame(rows, "score double, positive boolean")).first()
    assert tuple(found) == chosen(positives, negatives)


def test_threshold_without_scores(spark):
    assert tuple(E.grouping_threshold(spark.createDataFrame([], "score double, positive boolean")).first()) == chosen([], [])


def test_directions_go_by_the_last_part_of_a_name(spark):
    before = spark.createDataFrame([("x.latency_p50_ms", 5.0), ("accuracy", 0.5), ("same", 1.0), ("failure_rate.x", 0.1), ("gone", 1.0), ("none", None)], "metric string, value double")
    after = spark.createDataFrame([("x.latency_p50_ms", 4.0), ("accuracy", 0.4), ("same", 1.0), ("failure_rate.x", 0.2), ("new", 1.0), ("none", 1.0)], "metric string, value double")
    compared = E.compare(before, after)
    assert {r["metric"]: (r["direction"], r["assessment"]) for r in compared.collect()} == {
        "x.latency_p50_ms": ("lower_is_better", "improved"), "accuracy": ("higher_is_better", "regressed"), "same": ("higher_is_better", "equivalent"), "failure_rate.x": ("higher_is_better", "improved"),
    }
    assert tuple(E.promotion(compared).first()) == (4, 1, "REJECTED_REGRESSION")
    assert tuple(E.promotion(compared.filter("metric <> 'accuracy'")).first()) == (3, 0, "REVIEW_REQUIRED")


def test_failures(spark):
    cases = [
        (429, None, None, ("RATE_LIMITED", True, "provider")), (None, "Too many requests", "x", ("RATE_LIMITED", True, "provider")), (503, "", None, ("TRANSIENT_PROVIDER_FAILURE", True, "transient")), (200, "is busy", "eBusy", ("EBUSY", True, "transient")),
        (413, None, "x", ("PAYLOAD_TOO_LARGE", False, None)), (None, "corrupt file", None, ("INVALID_IMAGE", False, None)), (None, "CUDA error: memory", None, ("GPU_OOM", True, "smaller_batch")), (401, "Forbidden", None, ("CONFIGURATION_ERROR", False, None)),
        (None, None, None, ("UNKNOWN_TASK_FAILURE", False, None)), (500, "odd", "E1", ("E1", False, None)),
    ]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, status int, message string, code string")
    found = rows.select("i", failure_class(F.col("status"), F.col("message"), F.col("code")).alias("f")).orderBy("i").collect()
    assert [tuple(r["f"]) for r in found] == [c[3] for c in cases]
