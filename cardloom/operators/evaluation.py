"""Evaluation: confusion figures, latencies, leakage, threshold choice, gates and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.operators.order import in_order


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 6))


def confusion(rows: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Counts, precision, recall, F1 and accuracy of a binary prediction; null where there is nothing to divide by."""
    cell = lambda a, p, n: F.count_if((F.col(actual) == a) & (F.col(predicted) == p)).alias(n)
    g = rows.groupBy(*(by or [])).agg(cell(1, 1, "tp"), cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"))
    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    return g.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn), "accuracy": share(tp + tn, tp + tn + fp + fn)})


def latency(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, mean, median, 95th percentile and maximum."""
    q = lambda p, n: F.round(F.percentile(value, F.lit(p)), 4).alias(n)
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), q(0.5, "p50"), q(0.95, "p95"), F.round(F.max(value), 4).alias("max"))


def leaking_groups(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups found in more than one split."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("splits"), F.count(F.lit(1)).alias("rows")).filter("splits > 1")


def choose_threshold(scores: DataFrame, thresholds: list[float], penalty: float = 8.0) -> DataFrame:
    """true and false positive rates of each threshold, the one with the largest tpr - penalty * fpr first (rank 1).

    scores has score and positive; one pass counts all thresholds.
    """
    at = [F.struct(F.lit(t).alias("threshold"), (F.col("score") >= t).alias("hit")) for t in thresholds]
    g = scores.select("positive", F.inline(F.array(*at))).groupBy("threshold").agg(
        F.count_if(F.col("positive")).alias("_p"), F.count_if(~F.col("positive")).alias("_n"), F.count_if(F.col("positive") & F.col("hit")).alias("_tp"), F.count_if(~F.col("positive") & F.col("hit")).alias("_fp")
    )
    out = g.select("threshold", F.coalesce(share(F.col("_tp"), F.col("_p")), F.lit(0.0)).alias("tpr"), F.coalesce(share(F.col("_fp"), F.col("_n")), F.lit(0.0)).alias("fpr"))
    out = out.withColumn("utility", F.round(F.col("tpr") - penalty * F.col("fpr"), 6))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("utility"), "threshold")))  # one row for each threshold


def gates(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """profile, passed, failed: a profile passes when every one of its limits (metric, kind min or max, limit) holds; a missing metric fails."""
    both = limits.join(metrics, "metric", "left")
    ok = F.coalesce(F.when(F.col("kind") == "min", F.col("value") >= F.col("limit")).otherwise(F.col("value") <= F.col("limit")), F.lit(False))
    return both.groupBy("profile").agg(F.every(ok).alias("passed"), F.count_if(~ok).alias("failed"))


#: Metrics of which less is better, by the last part of their names.
LOWER_IS_BETTER = [
    "false_confident_rate", "false_confident_matches", "latency_p50_ms", "latency_p95_ms", "latency_p99_ms", "expected_calibration_error", "peak_vram_mb", "peak_ram_mb", "failure_rate",
]


def compare(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """metric, before, after, change, direction and assessment (equivalent, improved, regressed) of the metrics that both have; null values count as missing."""
    known = lambda rows, name: rows.filter(F.col("value").isNotNull()).select("metric", F.col("value").alias(name))
    both = known(baseline, "before").join(known(candidate, "after"), "metric")
    lower = F.regexp_extract("metric", r"([^.]*)$", 1).isin(LOWER_IS_BETTER)
    change = F.round(F.col("after") - F.col("before"), 12)
    better = F.when(lower, F.col("change") < 0).otherwise(F.col("change") > 0)
    assessment = F.when(F.abs("change") <= 1e-12, "equivalent").when(better, "improved").otherwise("regressed")
    return both.withColumn("change", change).withColumns({"direction": F.when(lower, "lower_is_better").otherwise("higher_is_better"), "assessment": assessment})


def promotion(compared: DataFrame) -> DataFrame:
    """metrics, regressions and decision: any regression rejects, else the change goes to review."""
    g = compared.agg(F.count(F.lit(1)).alias("metrics"), F.count_if(F.col("assessment") == "regressed").alias("regressions"))
    return g.withColumn("decision", F.when(F.col("regressions") > 0, "REJECTED_REGRESSION").otherwise("REVIEW_REQUIRED"))


#: Thresholds that are tried besides the scores, the weight of false positives, and the bounds of what is chosen.
TRIED, PENALTY, CHOSEN = [0.60, 0.65, 0.70, 0.75, 0.80, 0.82, 0.84, 0.86, 0.88, 0.90, 0.92], 8.0, (0.74, 0.94)


def grouping_threshold(scores: DataFrame) -> DataFrame:
    """One row: threshold (within CHOSEN), best, tpr, fpr, tp, fn, fp, tn for the threshold of the largest tpr - 8 * fpr over all scores and those of TRIED.

    scores has score and positive. Ties go to fewer false positives, more true ones, then the larger threshold. Scores are counted first and
    put in order over ranges; counts from the largest down add up from task sums, so no task holds all scores. Null scores are left out; without scores all counts are 0.
    """
    tried = scores.sparkSession.createDataFrame([(t, 0, 0) for t in TRIED], "score double, p bigint, n bigint")
    counted = scores.filter("score IS NOT NULL").groupBy(F.col("score").cast("double").alias("score")).agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    both = counted.unionByName(tried).groupBy("score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    placed = in_order(both, [F.desc("score")]).withColumn("_task", F.shiftright("_at", 33))
    sums = placed.groupBy("_task").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
    sums = sums.select("_task", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}") for c in ("_p", "_n")], *[F.sum(c).over(Window.partitionBy(F.lit(0))).alias(f"_t{c}") for c in ("_p", "_n")])
    upto = Window.partitionBy("_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = placed.withColumns({"tp": F.sum("p").over(upto), "fp": F.sum("n").over(upto)}).join(sums, "_task").withColumns({"tp": F.col("tp") + F.col("_b_p"), "fp": F.col("fp") + F.col("_b_n")})
    tpr, fpr = F.col("tp") / F.greatest(F.lit(1), "_t_p"), F.col("fp") / F.greatest(F.lit(1), "_t_n")
    best = F.max(F.struct((tpr - PENALTY * fpr).alias("goal"), (-fpr).alias("less"), tpr.alias("tpr"), F.col("score").alias("best"), "tp", "fp", (F.col("_t_p") - F.col("tp")).alias("fn"), (F.col("_t_n") - F.col("fp")).alias("tn")))
    found = rows.agg(best.alias("b")).select("b.*")
    return found.select(F.round(F.greatest(F.lit(CHOSEN[0]), F.least(F.lit(CHOSEN[1]), "best")), 4).alias("threshold"), "best", F.round("tpr", 4).alias("tpr"), F.round(-F.col("less"), 4).alias("fpr"), "tp", "fn", "fp", "tn")

