"""Queries on vectors, groups, evaluation, events and task graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.operators import evaluation as E
from cardloom.operators import events as Q
from cardloom.operators import vector_index as X
from cardloom.operators import vectors as V
from cardloom.session import table

NOW = "2024-01-20 00:00:00"


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", V.unit(F.col("embedding"), 64).alias("v")).filter("v is not null")


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 20."""
    rows = unit_vectors(spark, sf_dir)
    return V.cosine_search(rows.filter("id % 20 = 0"), rows, 10)


def vector_search_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of those found, the ones with an even label: the filter comes after the ten are found, so fewer may stay."""
    return vector_search(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id").filter("label % 2 = 0").select("query_id", "rank", "id", "similarity", "label")


def indexed_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 20, over an index of all vectors."""
    rows = unit_vectors(spark, sf_dir)
    return X.indexed_search(rows.filter("id % 20 = 0"), X.build_index(rows), 10)


def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the ten nearest of each query the index finds."""
    return X.recall_of(indexed_vector_search(spark, sf_dir), vector_search(spark, sf_dir))


def inventory_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, quantity and price span of the part behind each vector found, zero where there are none."""
    found = vector_search(spark, sf_dir).filter("rank <= 3")
    stock = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"), F.expr("min(l_extendedprice) FILTER (WHERE l_linestatus = 'O')").alias("low"), F.expr("max(l_extendedprice) FILTER (WHERE l_linestatus = 'O')").alias("high")
    )
    return found.join(stock, "id", "left").select("query_id", "rank", "id", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("quantity", F.lit(0.0)).alias("quantity"), "low", "high")


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, distinct texts and copies of each source."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct(F.md5(F.coalesce("text", F.lit("")))).alias("texts")).withColumn("copies", F.col("documents") - F.col("texts"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score by length and the prediction it makes."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return joined.withColumn("score", F.round(F.least(F.lit(1.0), F.col("n_chars") / 4000), 4)).withColumn("predicted", (F.col("n_chars") >= 400).cast("int"))


def scene_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(predictions(spark, sf_dir), "quality", "predicted", ["lang"])


def latency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.latency(table(spark, sf_dir, "events"), "value", ["event_type"])


def threshold_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).select("score", (F.col("quality") == 1).alias("positive"))
    return E.choose_threshold(rows, [round(0.05 * i, 2) for i in range(1, 20)])


def metric_rows(spark: SparkSession, sf_dir: str, cut: int) -> DataFrame:
    rows = predictions(spark, sf_dir).withColumn("predicted", (F.col("n_chars") >= cut).cast("int"))
    g = E.confusion(rows, "quality", "predicted")
    g = g.withColumn("failure_rate", F.round(1 - F.col("accuracy"), 6))
    return g.select(F.inline(F.array(*[F.struct(F.lit(f"all.{m}" if m == "failure_rate" else m).alias("metric"), F.col(m).alias("value")) for m in ("precision", "recall", "f1", "accuracy", "failure_rate")])))


def release_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = [("beta", "precision", "min", 0.5), ("beta", "recall", "min", 0.5), ("production", "precision", "min", 0.8), ("production", "recall", "min", 0.9), ("superior", "accuracy", "min", 0.99), ("superior", "hallucination", "max", 0.1)]
    table_of = spark.createDataFrame(limits, "profile string, metric string, kind string, `limit` double")
    return E.gates(metric_rows(spark, sf_dir, 400), table_of)


def benchmark_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.compare(metric_rows(spark, sf_dir, 400), metric_rows(spark, sf_dir, 1200))


def promotion_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.promotion(benchmark_comparison(spark, sf_dir))


def grouping_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold on the scores of labelled documents that keeps false positives rare."""
    return E.grouping_threshold(predictions(spark, sf_dir).select("score", (F.col("quality") == 1).alias("positive")))


def event_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of events, some of them sent again with the same or another payload, counted by type."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "props")
    again = events.filter("event_id % 7 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 second")).withColumn("props", F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("{}"))
    judged = Q.intake(events.unionByName(again), ["event_id"], "ts", F.lit(NOW).cast("timestamp"), "props")
    return judged.groupBy("event_type", "outcome").agg(F.count(F.lit(1)).alias("events"))


def usage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and value of each user, type and day."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("total"))


def usage_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use of each user in January against the limit of their plan."""
    used = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("used"))
    plans = spark.createDataFrame([(0, "free", 40), (1, "pro", 70), (2, "shop", 1000)], "k int, plan string, quota int")
    return used.withColumn("k", (F.col("user_id") % 3).cast("int")).join(F.broadcast(plans), "k").select("user_id", "plan", "used", (F.col("used") < F.col("quota")).alias("within"))


def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = Q.tumbling_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", "event_type")
    return counts.select(F.unix_seconds("start").alias("start_s"), "event_type", "events")


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each user that a limit of three a day from the first hit on lets through."""
    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    hits = Q.first_hit_windows(e, "user_id", "at_us", 86_400_000_000, 3)
    return hits.groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"), F.count_if("allowed").alias("allowed"), F.max("used").alias("most"))


def conversation_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turn of each conversation."""
    rows = table(spark, sf_dir, "conversations").withColumn("chars", F.char_length("text").cast("long"))
    return Q.latest_of(rows, ["conv_id"], ["turn"], ["turn", "role", "chars"])


def reply_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose last turn is the user's, with the last inbound turn before any reply."""
    rows = table(spark, sf_dir, "conversations")
    last = Q.latest_of(rows, ["conv_id"], ["turn"], ["turn", "role"])
    inbound = Q.latest_of(rows.filter("role = 'user'"), ["conv_id"], ["turn"], ["turn"]).select("conv_id", F.col("turn").alias("inbound_turn"))
    return last.join(inbound, "conv_id", "left").select("conv_id", "turn", "inbound_turn", (F.col("role") == "user").alias("waiting"))


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs made from events."""
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.pmod("event_id", F.lit(n)) + 1).cast("int"))
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("owner"), pick(["PENDING", "LEASED", "RETRY_WAIT", "SENT", "DEAD_LETTER"], 5).alias("status"), pick([None, "ok", "retry", "fail"], 4).alias("outcome"),
        F.pmod("event_id", F.lit(6)).cast("int").alias("attempts"), F.lit(4).alias("max_attempts"), (F.col("ts") + F.expr("INTERVAL 5 minutes")).alias("lease_until"), F.col("ts").alias("due_at"),
    )


def outbox_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = Q.transition(outbox(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return moved.groupBy("status", "next_status").agg(F.count(F.lit(1)).alias("jobs"), F.count("available_at").alias("scheduled"))


def outbox_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.claim(outbox(spark, sf_dir), F.lit(NOW).cast("timestamp"), 2, "owner").select("owner", "turn", "job_id", "status")


def graph_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    crops = table(spark, sf_dir, "pages").select("page_id")
    tasks = Q.crop_tasks(crops, "page_id")
    depth = F.element_at(F.create_map(*[x for i, t in enumerate(Q.CROP_TASKS) for x in (F.lit(t), F.lit(i))]), F.col("task"))
    reach = F.pmod("page_id", F.lit(9))
    status = F.when(depth < reach, "complete").when((depth == reach) & (F.col("page_id") % 2 == 0), "failed").otherwise("pending")
    return tasks.withColumn("status", status)


def task_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.readiness(graph_tasks(spark, sf_dir)).select("task_id", "task", "status", "ready", "blocked")


def scan_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.job_status(graph_tasks(spark, sf_dir), "page_id")


QUERIES = {f.__name__: f for f in (vector_search, vector_search_active, indexed_vector_search, vector_index_recall, inventory_rollup, exact_duplicates, scene_confusion, latency_report, threshold_choice, release_gates, benchmark_comparison, promotion_decision, grouping_threshold, event_intake, usage_counters, usage_quota, hourly_windows, rate_limit, conversation_latest, reply_work, outbox_transitions, outbox_claims, task_readiness, scan_job_status)}

COSINE_SQL = r"""u AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE len(embedding) = 64
), n AS (SELECT id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM u
), c AS (SELECT q.id AS query_id, r.id, round(list_sum(list_transform(range(1, 65), lambda i: q.e[i] * r.e[i])) / q.norm / r.norm, 6) AS cosine FROM n q, n r WHERE q.id % 20 = 0 AND q.norm > 0 AND r.norm > 0
), f AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id)::INT AS rank, id, greatest(0, least(1, cosine)) AS similarity FROM c
), found AS (SELECT * FROM f WHERE rank <= 10)"""

PREDICTED_SQL = "p AS (SELECT l.*, lang, n_chars, round(least(1, n_chars / 4000.0::DOUBLE), 4) AS score, (n_chars >= 400)::INT AS predicted FROM labels l JOIN documents USING (doc_id))"


def _confusion_sql(cut: int, by: str = "") -> str:
    cells = ", ".join(f"count(*) FILTER (WHERE quality = {a} AND (n_chars >= {cut})::INT = {p}) AS {n}" for a, p, n in ((1, 1, "tp"), (0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn")))
    part = lambda x, y: f"CASE WHEN {y} > 0 THEN round(({x})::DOUBLE / ({y}), 6) END"
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}tp, tn, fp, fn, {part('tp', 'tp + fp')} AS precision, {part('tp', 'tp + fn')} AS recall, {part('2 * tp', '2 * tp + fp + fn')} AS f1, {part('tp + tn', 'tp + tn + fp + fn')} AS accuracy
      FROM (SELECT {lead}{cells} FROM p {'GROUP BY ' + by if by else ''})"""


def _metrics_sql(cut: int) -> str:
    return f"SELECT unnest(['precision', 'recall', 'f1', 'accuracy', 'all.failure_rate']) AS metric, unnest([precision, recall, f1, accuracy, round(1 - accuracy, 6)]) AS value FROM ({_confusion_sql(cut)})"


_COMPARED_SQL = f"""{PREDICTED_SQL}, a AS ({_metrics_sql(400)}), b AS ({_metrics_sql(1200)}), d AS (SELECT metric, a.value AS before, b.value AS after, round(b.value - a.value, 12) AS change, metric = 'all.failure_rate' AS lower_ FROM a JOIN b USING (metric)
), compared AS (SELECT metric, before, after, change, CASE WHEN lower_ THEN 'lower_is_better' ELSE 'higher_is_better' END AS direction, CASE WHEN abs(change) <= 1e-12 THEN 'equivalent' WHEN (change < 0) = lower_ THEN 'improved' ELSE 'regressed' END AS assessment FROM d)"""

OUTBOX_SQL = r"""jobs AS (SELECT event_id AS job_id, user_id AS owner, (['PENDING', 'LEASED', 'RETRY_WAIT', 'SENT', 'DEAD_LETTER'])[event_id % 5 + 1] AS status, ([NULL, 'ok', 'retry', 'fail'])[event_id % 4 + 1] AS outcome, event_id % 6 AS attempts,
    ts + INTERVAL 5 MINUTE AS lease_until, ts AS due_at FROM events)"""

TASKS_SQL = r"""t AS (SELECT page_id, unnest(['normalize', 'ocr', 'embed', 'retrieve', 'rerank', 'adjudicate', 'price']) AS task, unnest(range(0, 7)) AS depth,
    unnest([[]::VARCHAR[], ['normalize'], ['normalize'], ['embed'], ['ocr', 'retrieve'], ['rerank'], ['adjudicate']]) AS needs FROM pages
), tasks AS (SELECT page_id, page_id::VARCHAR || ':' || task AS task_id, task, needs, CASE WHEN depth < page_id % 9 THEN 'complete' WHEN depth = page_id % 9 AND page_id % 2 = 0 THEN 'failed' ELSE 'pending' END AS status FROM t)"""

ORACLES = {
    "vector_search": f"WITH {COSINE_SQL} SELECT * FROM found",
    "vector_search_active": f"WITH {COSINE_SQL} SELECT found.*, label FROM found JOIN n USING (id) WHERE label % 2 = 0",
    "inventory_rollup": f"""WITH {COSINE_SQL}, s AS (SELECT l_partkey AS id, count(*) AS lines, sum(l_quantity) AS quantity, min(l_extendedprice) FILTER (WHERE l_linestatus = 'O') AS low, max(l_extendedprice) FILTER (WHERE l_linestatus = 'O') AS high FROM lineitem GROUP BY 1)
      SELECT query_id, rank, found.id, coalesce(lines, 0) AS lines, coalesce(quantity, 0) AS quantity, low, high FROM found LEFT JOIN s ON s.id = found.id WHERE rank <= 3""",
    "exact_duplicates": "SELECT source, count(*) AS documents, count(DISTINCT coalesce(text, '')) AS texts, count(*) - count(DISTINCT coalesce(text, '')) AS copies FROM documents GROUP BY source",
    "scene_confusion": f"WITH {PREDICTED_SQL} {_confusion_sql(400, 'lang')}",
    "latency_report": "SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(max(value), 4) AS max FROM events GROUP BY event_type",
    "threshold_choice": f"""WITH {PREDICTED_SQL}, th AS (SELECT unnest([{', '.join(str(round(0.05 * i, 2)) for i in range(1, 20))}])::DOUBLE AS threshold), g AS (
        SELECT threshold, count(*) FILTER (WHERE quality = 1) AS np, count(*) FILTER (WHERE quality <> 1) AS nn, count(*) FILTER (WHERE quality = 1 AND score >= threshold) AS tp, count(*) FILTER (WHERE quality <> 1 AND score >= threshold) AS fp FROM p, th GROUP BY threshold
      ), r AS (SELECT threshold, round(tp::DOUBLE / np, 6) AS tpr, round(fp::DOUBLE / nn, 6) AS fpr FROM g) SELECT *, round(tpr - 8 * fpr, 6) AS utility, row_number() OVER (ORDER BY round(tpr - 8 * fpr, 6) DESC, threshold)::INT AS rank FROM r""",
    "release_gates": f"""WITH {PREDICTED_SQL}, m AS ({_metrics_sql(400)}), l(profile, metric, kind, lim) AS (VALUES ('beta', 'precision', 'min', 0.5), ('beta', 'recall', 'min', 0.5), ('production', 'precision', 'min', 0.8), ('production', 'recall', 'min', 0.9), ('superior', 'accuracy', 'min', 0.99), ('superior', 'hallucination', 'max', 0.1)
      ), x AS (SELECT profile, coalesce(CASE WHEN kind = 'min' THEN value >= lim ELSE value <= lim END, false) AS ok FROM l LEFT JOIN m USING (metric)) SELECT profile, bool_and(ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed FROM x GROUP BY profile""",
    "benchmark_comparison": f"WITH {_COMPARED_SQL} SELECT * FROM compared",
    "promotion_decision": f"WITH {_COMPARED_SQL} SELECT count(*) AS metrics, count(*) FILTER (WHERE assessment = 'regressed') AS regressions, CASE WHEN count(*) FILTER (WHERE assessment = 'regressed') > 0 THEN 'REJECTED_REGRESSION' ELSE 'REVIEW_REQUIRED' END AS decision FROM compared",
    "grouping_threshold": f"""WITH {PREDICTED_SQL}, t AS (SELECT DISTINCT score AS threshold FROM p UNION SELECT unnest({E.TRIED})::DOUBLE), n AS (SELECT greatest(1, count(*) FILTER (WHERE quality = 1)) AS np, greatest(1, count(*) FILTER (WHERE quality <> 1)) AS nn FROM p
      ), c AS (SELECT threshold, count(*) FILTER (WHERE quality = 1 AND score >= threshold) AS tp, count(*) FILTER (WHERE quality = 1 AND score < threshold) AS fn, count(*) FILTER (WHERE quality <> 1 AND score >= threshold) AS fp, count(*) FILTER (WHERE quality <> 1 AND score < threshold) AS tn FROM p, t GROUP BY threshold
      ) SELECT round(greatest(0.74::DOUBLE, least(0.94::DOUBLE, threshold)), 4) AS threshold, threshold AS best, round(tp / np, 4) AS tpr, round(fp / nn, 4) AS fpr, tp, fn, fp, tn FROM c, n ORDER BY tp / np - 8 * (fp / nn) DESC, fp, tp DESC, c.threshold DESC LIMIT 1""",
    "event_intake": """WITH e AS (SELECT event_id, ts, event_type, props FROM events UNION ALL SELECT event_id, ts + INTERVAL 1 SECOND, event_type, CASE WHEN event_id % 2 = 0 THEN props ELSE '{}' END FROM events WHERE event_id % 7 = 0
      ), w AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts, props) AS r, first_value(props) OVER (PARTITION BY event_id ORDER BY ts, props) AS f FROM e
      ), o AS (SELECT event_type, CASE WHEN ts < TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR THEN 'late' WHEN ts > TIMESTAMP '2024-01-20' + INTERVAL 5 MINUTE THEN 'early' WHEN r = 1 THEN 'accepted' WHEN f IS NOT DISTINCT FROM props THEN 'duplicate' ELSE 'conflict' END AS outcome FROM w)
      SELECT event_type, outcome, count(*) AS events FROM o GROUP BY ALL""",
    "usage_counters": "SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2, 3",
    "usage_quota": "SELECT user_id, (['free', 'pro', 'shop'])[user_id % 3 + 1] AS plan, count(*) AS used, count(*) < ([40, 70, 1000])[user_id % 3 + 1] AS within FROM events GROUP BY user_id",
    "hourly_windows": "SELECT epoch(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'))::BIGINT AS start_s, event_type, count(*) AS events FROM events GROUP BY ALL",
    "rate_limit": """WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS k FROM events
      ), s AS (SELECT user_id, k, at_us AS start, 1 AS used FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, CASE WHEN o.at_us - s.start >= 86400000000 THEN o.at_us ELSE s.start END, CASE WHEN o.at_us - s.start >= 86400000000 THEN 1 ELSE s.used + 1 END FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1)
      SELECT user_id, count(*) AS hits, count(*) FILTER (WHERE used <= 3) AS allowed, max(used) AS most FROM s GROUP BY user_id""",
    "conversation_latest": 'SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(length(text), turn) AS chars, count(*) AS "rows" FROM conversations GROUP BY conv_id',
    "reply_work": "SELECT conv_id, max(turn) AS turn, max(turn) FILTER (WHERE role = 'user') AS inbound_turn, arg_max(role, turn) = 'user' AS waiting FROM conversations GROUP BY conv_id",
    "outbox_transitions": f"""WITH {OUTBOX_SQL}, m AS (SELECT *, CASE WHEN status IN ('SENT', 'DEAD_LETTER') THEN status WHEN outcome = 'ok' THEN 'SENT' WHEN outcome = 'retry' AND attempts + 1 < 4 THEN 'RETRY_WAIT' WHEN outcome IN ('retry', 'fail') THEN 'DEAD_LETTER'
        WHEN status = 'LEASED' AND lease_until < TIMESTAMP '2024-01-20' THEN 'DELIVERY_UNKNOWN' ELSE status END AS next_status FROM jobs) SELECT status, next_status, count(*) AS jobs, count(*) FILTER (WHERE next_status = 'RETRY_WAIT') AS scheduled FROM m GROUP BY ALL""",
    "outbox_claims": f"WITH {OUTBOX_SQL}, r AS (SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY due_at, job_id)::INT AS turn, job_id, status FROM jobs WHERE status IN ('PENDING', 'RETRY_WAIT') AND due_at <= TIMESTAMP '2024-01-20') SELECT * FROM r WHERE turn <= 2",
    "task_readiness": f"""WITH {TASKS_SQL}, x AS (SELECT a.task_id, bool_and(coalesce(b.status = 'complete', len(a.needs) = 0)) AS done, bool_or(coalesce(b.status = 'failed', false)) AS bad FROM tasks a LEFT JOIN tasks b ON b.page_id = a.page_id AND list_contains(a.needs, b.task) GROUP BY a.task_id)
      SELECT task_id, task, status, status = 'pending' AND done AS ready, status = 'pending' AND bad AS blocked FROM tasks JOIN x USING (task_id)""",
    "scan_job_status": f"WITH {TASKS_SQL} SELECT page_id, CASE WHEN bool_and(status = 'complete') THEN 'complete' WHEN bool_or(status = 'failed') THEN 'review' ELSE 'running' END AS job_status, count(*) AS tasks, count(*) FILTER (WHERE status = 'complete') AS done FROM tasks GROUP BY page_id",
}
