"""Queries on recognition benchmarks over the results of catalog search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.operators import benchmark as B
from cardloom.operators import catalog as C
from cardloom.plans.catalog import RANKED_SQL, search_queries
from cardloom.plans.views import cards
from cardloom.session import table, written

SCENES = ["single_card", "binder_page", "multi_card_table", "mixed_raw_slab"]
CARD_FIELDS = ["player", "year", "brand", "set_name", "card_number"]


def benchmark_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """cases, expected, items and matches: images of three cards each, the searches of search_queries as what was read of them, the items of every other image in reverse."""
    place = lambda key: [F.floor(F.col(key) / 60).alias("case_id"), F.pmod(F.floor(F.col(key) / 20), F.lit(3)).alias("at")]
    rows = cards(spark, sf_dir)
    few = rows.filter("card_id % 20 = 0")
    expected = few.select(*place("card_id"), "card_id", *CARD_FIELDS)
    turned = F.when(F.col("case_id") % 2 == 1, 2 - F.col("at")).otherwise(F.col("at"))
    ranked = written(C.rank_cards(search_queries(spark, sf_dir), rows, 3))
    seen = F.when(F.col("card_id") % 40 == 0, F.col("player")).otherwise(F.concat(F.lit("x"), F.substring("player", 2, 99)))
    sure = ranked.filter("rank = 1").select(F.col("query_id").alias("card_id"), (F.col("confidence") < 0.8).alias("needs_confirmation"))
    items = few.join(sure, "card_id", "left").select(*place("card_id"), seen.alias("player"), "year", "brand", "card_number", F.coalesce("needs_confirmation", F.lit(True)).alias("needs_confirmation")).withColumn("at", turned)
    matches = ranked.join(rows.select("card_id", *CARD_FIELDS), "card_id").select(*place("query_id"), "rank", "confidence", "card_id", *CARD_FIELDS).withColumn("at", turned)
    kind = lambda n: F.element_at(F.array(*map(F.lit, SCENES)), (F.pmod(n, F.lit(4)) + 1).cast("int"))
    case = F.col("case_id")
    cases = expected.select("case_id").distinct().select("case_id", kind(case).alias("scene_expected"), kind(F.when(case % 5 == 0, case + 1).otherwise(case)).alias("scene_actual"), (case % 7 != 3).alias("scorable"))
    return cases, expected, items, matches


def scored_benchmark(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cases, expected, items, matches = benchmark_tables(spark, sf_dir)
    known = expected.join(cases.filter("scorable").select("case_id"), "case_id", "left_semi")
    return cases, written(B.score_cards(known, items, matches, B.in_place(known, items)))


def recognition_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.by_scene(*scored_benchmark(spark, sf_dir))


def benchmark_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.by_field(scored_benchmark(spark, sf_dir)[1])


def benchmark_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.failures(*scored_benchmark(spark, sf_dir))


def assigned_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark with each image's items assigned to the cards with which they agree most."""
    cases, expected, items, matches = benchmark_tables(spark, sf_dir)
    known = expected.join(cases.filter("scorable").select("case_id"), "case_id", "left_semi")
    return B.by_scene(cases, B.score_cards(known, items, matches, B.assigned(known, items)))


def labelled_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as images and labels as the labels of some of them, whatever the spelling of their names."""
    image = F.concat(F.lit("scans/Doc "), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 9 == 0, ".txt").otherwise(".JPG"))
    name = F.concat(F.lit("labels\\doc-"), F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")).cast("string"), F.lit(".png"))
    return B.images_with_labels(table(spark, sf_dir, "documents").select(image.alias("image")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), name.alias("name")))


QUERIES = {f.__name__: f for f in (recognition_benchmark, benchmark_fields, benchmark_failures, assigned_benchmark, labelled_images)}

_AGREES = lambda e, a: f"(e.{e}::VARCHAR = a.{a}::VARCHAR OR contains(lower(a.{a}::VARCHAR), lower(e.{e}::VARCHAR)) OR contains(lower(e.{e}::VARCHAR), lower(a.{a}::VARCHAR)))::INT"
_PLACE = "card_id // 60 AS case_id, card_id // 20 % 3 AS pos"
_PCT = lambda n, d: f"CASE WHEN {d} > 0 THEN floor({n} * 1000 / {d} + 0.5) / 10 ELSE 0 END"
_SCENE = f"({SCENES})"
BENCHMARK_SQL = f"""{RANKED_SQL}, exp AS (SELECT {_PLACE}, * FROM cards WHERE card_id % 20 = 0 AND (card_id // 60) % 7 <> 3
), itm AS (SELECT card_id // 60 AS case_id, CASE WHEN (card_id // 60) % 2 = 1 THEN 2 - card_id // 20 % 3 ELSE card_id // 20 % 3 END AS pos, card_id AS query_id, CASE WHEN card_id % 40 = 0 THEN player ELSE 'x' || substr(player, 2) END AS player, year, brand, card_number FROM cards WHERE card_id % 20 = 0
), cs AS (SELECT DISTINCT case_id, {_SCENE}[case_id % 4 + 1] AS scene, {_SCENE}[CASE WHEN case_id % 5 = 0 THEN case_id + 1 ELSE case_id END % 4 + 1] AS actual FROM exp
), placed AS (SELECT e.case_id, e.pos, coalesce(o.query_id, f.query_id) AS query_id FROM exp e LEFT JOIN itm o ON o.case_id = e.case_id AND o.pos = e.pos LEFT JOIN itm f ON f.case_id = e.case_id AND f.pos = (SELECT min(m.pos) FROM itm m WHERE m.case_id = e.case_id)
), hit AS (SELECT e.case_id, e.pos, r.rank, r.confidence, a.card_id, e.card_id = a.card_id OR {" + ".join(_AGREES(f, f) for f in CARD_FIELDS)} >= 4 AS is_card
    FROM exp e JOIN placed p ON p.case_id = e.case_id AND p.pos = e.pos JOIN ranked r ON r.query_id = p.query_id AND r.rank <= 3 JOIN cards a ON a.card_id = r.card_id
), top AS (SELECT case_id, pos, bool_or(is_card AND rank = 1) AS top1, bool_or(is_card) AS top3, max(confidence) FILTER (WHERE rank = 1) AS conf FROM hit GROUP BY ALL
), told AS (SELECT e.case_id, e.pos, {", ".join(f"{_AGREES(f, f)} AS {f}" for f in CARD_FIELDS if f != "set_name")}, 0 AS set_name FROM exp e JOIN placed p ON p.case_id = e.case_id AND p.pos = e.pos JOIN itm a ON a.query_id = p.query_id
), per AS (SELECT t.case_id, t.pos, coalesce(top1, false) AS top1, coalesce(top3, false) AS top3, coalesce(conf, 0) < 0.8 AS asks, NOT coalesce(top1, false) AND coalesce(conf, 0) >= 0.86 AS falsely, player, year, brand, set_name, card_number FROM told t LEFT JOIN top USING (case_id, pos)
), bsums AS (SELECT case_id, count(*) AS n, sum(top1::INT) AS t1, sum(top3::INT) AS t3, sum(falsely::INT) AS fc, sum(asks::INT) AS nc, sum(player + year + brand + set_name + card_number) AS r FROM per GROUP BY 1
), labels AS (SELECT cs.*, bsums.* EXCLUDE (case_id), unnest(['all', scene] || CASE WHEN n > 1 OR scene <> 'single_card' THEN ['multi_card_binder_focus'] ELSE [] END) AS label FROM cs JOIN bsums USING (case_id))"""

ORACLES = {
    "recognition_benchmark": f"""WITH {BENCHMARK_SQL} SELECT label AS scene, count(*) AS cases, sum(n)::BIGINT AS expected, {_PCT("sum((scene = actual)::INT)", "count(*)")} AS scene_accuracy, {_PCT("sum(t1)", "sum(n)")} AS top1_accuracy, {_PCT("sum(t3)", "sum(n)")} AS top3_accuracy,
      {_PCT("sum(r)", "sum(n * 5)")} AS field_accuracy, {_PCT("sum(fc)", "sum(n)")} AS false_confident_rate, {_PCT("sum(nc)", "sum(n)")} AS needs_confirmation_rate FROM labels GROUP BY label""",
    "benchmark_fields": f"""WITH {BENCHMARK_SQL}, f AS (SELECT unnest({CARD_FIELDS}) AS field, unnest([{", ".join(CARD_FIELDS)}]) AS ok FROM per)
      SELECT field, count(*) AS total, sum(ok)::BIGINT AS correct, {_PCT("sum(ok)", "count(*)")} AS accuracy, {_PCT("sum(ok)", "count(*)")} < 85 AS weak FROM f GROUP BY field""",
    "benchmark_failures": f"""WITH {BENCHMARK_SQL}, rows AS (SELECT unnest(list_filter([CASE WHEN NOT top1 THEN 'missed_top1' END, CASE WHEN NOT top1 AND top3 THEN 'correct_in_top3' END, CASE WHEN falsely THEN 'false_confident' END, CASE WHEN asks THEN 'needs_confirmation' END], lambda x: x IS NOT NULL)) AS pattern, case_id, pos FROM per
        UNION ALL SELECT 'scene_miss', case_id, 0 FROM cs WHERE scene <> actual
      ), t AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY case_id, pos) AS turn FROM rows)
      SELECT pattern, count(*) AS found, string_agg(case_id::VARCHAR || ':' || pos::VARCHAR, ',' ORDER BY turn) FILTER (WHERE turn <= 8) AS examples FROM t GROUP BY pattern""",
    "labelled_images": """WITH i AS (SELECT 'doc' || doc_id::VARCHAR AS key, 'scans/Doc ' || doc_id::VARCHAR || '.JPG' AS image FROM documents WHERE doc_id % 9 <> 0
      ), l AS (SELECT 'doc' || (CASE WHEN doc_id % 5 = 0 THEN doc_id + 1 ELSE doc_id END)::VARCHAR AS key, doc_id AS label_id, row_number() OVER (PARTITION BY CASE WHEN doc_id % 5 = 0 THEN doc_id + 1 ELSE doc_id END ORDER BY doc_id) AS turn FROM labels)
      SELECT key, image, label_id, CASE WHEN label_id IS NULL THEN 'unlabeled_image' WHEN image IS NULL THEN 'unmatched_label' ELSE 'paired' END AS status FROM i FULL JOIN (SELECT * FROM l WHERE turn = 1) USING (key)
      UNION ALL SELECT key, NULL, label_id, 'repeated_label' FROM l WHERE turn > 1""",
}
