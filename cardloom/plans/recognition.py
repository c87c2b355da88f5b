"""Queries on candidates, evidence and decisions, and on sales held against their cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.operators import recognition as X
from cardloom.operators.scoring import apply_reviews, score_sales
from cardloom.plans.imports import pick, pick_sql
from cardloom.plans.market import JUDGED_SQL
from cardloom.plans.views import CARDS_SQL, SALES_SQL, as_of, cards, sales
from cardloom.session import table

SURE = [0.9, 0.6, 0.75, 0.4]


def visual_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five candidates for every card whose id is divisible by 20, and what its image shows: some fields wrong, some missing."""
    rows = cards(spark, sf_dir)
    asked = rows.filter("card_id % 20 = 0").select(
        F.col("card_id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("step"), F.col("player").alias("seen_player"), (F.col("year") + F.when(F.col("card_id") % 60 == 0, 1).otherwise(0)).alias("seen_year"), F.lit(None).cast("string").alias("seen_sport"),
        F.col("brand").alias("seen_brand"), F.when(F.col("card_id") % 40 != 0, F.col("set_name")).alias("seen_set_name"), F.concat(F.lit("card no. #"), "card_number").alias("seen_card_number"),
        *[pick(SURE, F.floor(F.col("card_id") / 20) + at).alias(f"sure_{f}") for at, f in enumerate(X.FIELD_WEIGHTS)],
    )
    met = asked.withColumn("card_id", F.col("query_id") + F.col("step")).join(rows, "card_id")
    return met.withColumn("cosine", F.lit(0.8) - F.col("step") * 0.05)


def visual_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.rerank(visual_candidates(spark, sf_dir))
    return rows.select("query_id", "rank", "card_id", "score", F.array_join("matched", ",").alias("matched"), F.array_join("conflicts", ",").alias("conflicts"), "margin", "status")


def constrained_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of one year within a scope of cards."""
    scope = cards(spark, sf_dir).filter("card_id % 3 <> 0")
    return X.in_scope(X.hard_constraints(visual_candidates(spark, sf_dir), year=1992, set_name=None), scope).select("query_id", "card_id", "cosine")


FIELDS = ["player", "year", "set_name", "grade"]
VALUES = ["Red Fox", "red fox!", "Blue", "Green", "blue"]


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of cards, made from events."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.floor(n / 7).alias("item"), pick(FIELDS, F.floor(n / 2)).alias("field"), pick(VALUES, n * 3 + F.floor(n / 11)).alias("value"), pick(["vision", "manual", "cert"], n).alias("source"), (F.pmod(n * 7, F.lit(11)) / 10).alias("confidence")
    )


def evidence_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.ledger(observations(spark, sf_dir))


def recognition_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on items with evidence and up to three candidates each."""
    ledgers = evidence_ledger(spark, sf_dir).filter("item % 9 <> 0")
    n = F.col("event_id")
    found = table(spark, sf_dir, "events").filter("event_id % 7 < 3 AND floor(event_id / 7) % 8 <> 0 AND NOT (floor(event_id / 7) % 5 = 1 AND event_id % 7 > 0)").select(F.floor(n / 7).alias("item"), (n % 7 + 1).alias("rank"), (F.lit(0.9) - (n % 7) * pick([0.2, 0.03, 0.1], F.floor(n / 7))).alias("confidence"))
    decided = X.decide(ledgers, found, {"sample_size": 50, "lower_bound": 0.99})
    return decided.select("item", "status", F.array_join("reasons", ",").alias("reasons"), "choices")


def learned_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = visual_candidates(spark, sf_dir).select(F.col("query_id").alias("item"), "card_id", F.col("cosine").alias("confidence"), F.concat_ws(" ", "player", "set_name").alias("label"))
    corrections = cards(spark, sf_dir).filter("card_id % 2 = 0").select("card_id", F.when(F.col("card_id") % 3 == 0, F.col("set_name")).otherwise("no reason").alias("reason"))
    return X.learned_boosts(matches, corrections).select("item", "card_id", "confidence", "boost")


def image_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    share = lambda k, m: (n * k % m) / m
    return table(spark, sf_dir, "pages").select("page_id", X.pair_score(n * 3 % 31, share(5, 7), share(7, 11), share(11, 13), n * 13 % 101).alias("score"))


def card_aware_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales held against the card that was asked for: some name another card, year, grade or parallel."""
    own = cards(spark, sf_dir).select(F.col("card_id").alias("asked_id"), "card_id", "player", "set_name", "card_number", "year", F.concat_ws(" ", "grader", F.col("grade").cast("string")).alias("grade"), pick(["gold", None, "silver"], F.col("card_id")).alias("parallel"))
    line, supp = F.col("seen.l_linenumber"), F.col("seen.l_suppkey")
    said = sales(spark, sf_dir).join(own.select("card_id", *[F.col(c).alias(f"o_{c}") for c in X.MATCH_WEIGHTS]), "card_id").select(
        F.col("card_id").alias("asked_id"), (F.col("card_id") + F.when(supp % 11 == 0, 1).otherwise(0)).alias("card_id"), "raw_id", F.col("seen.l_extendedprice").alias("list_price"), "confidence", F.when(line != 2, F.upper("o_player")).alias("said_player"), F.col("o_set_name").alias("said_set_name"),
        F.col("o_card_number").alias("said_card_number"), (F.col("o_year") + F.when(line == 3, 1).otherwise(0)).alias("said_year"), F.when(supp % 7 == 0, "PSA 1").when(supp % 7 == 1, None).otherwise(F.col("o_grade")).alias("said_grade"), F.when(line % 2 == 0, "gold").alias("said_parallel"),
    )
    return X.score_against_cards(said, own).select("asked_id", "raw_id", "list_price", "match_score", "mismatch")


def reviewed_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales after reviews of every fifth and seventh order line."""
    scored = score_sales(sales(spark, sf_dir), as_of())
    order = F.col("seen.l_orderkey")
    decisions = sales(spark, sf_dir).filter((order % 5 == 0) | (order % 7 == 0)).select(F.col("raw_id").alias("sale_id"), F.when(order % 5 == 0, "approved").otherwise("rejected").alias("decision")).distinct()
    return apply_reviews(scored, decisions).groupBy("status", "usable").agg(F.count(F.lit(1)).alias("sales"))


QUERIES = {f.__name__: f for f in (visual_rerank, constrained_candidates, evidence_ledger, recognition_decisions, learned_boosts, image_pair_scores, card_aware_sales, reviewed_sales)}

_norm = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
_words = lambda x: f"list_distinct(list_filter(string_split({_norm(x)}, ' '), lambda w: w <> ''))"
_overlap = lambda a, b: f"coalesce(len(list_intersect({_words(a)}, {_words(b)})) / nullif(len(list_distinct(list_concat({_words(a)}, {_words(b)}))), 0)::DOUBLE, 0)"

CANDIDATES_SQL = rf"""{CARDS_SQL}, a AS (SELECT card_id AS query_id, unnest(range(0, 5)) AS step, player AS seen_player, year + CASE WHEN card_id % 60 = 0 THEN 1 ELSE 0 END AS seen_year, brand AS seen_brand, CASE WHEN card_id % 40 <> 0 THEN set_name END AS seen_set_name, card_number AS seen_card_number,
    {", ".join(f"{pick_sql(SURE, f'card_id // 20 + {at}')}::DOUBLE AS sure_{f}" for at, f in enumerate(X.FIELD_WEIGHTS))} FROM cards WHERE card_id % 20 = 0
), cand AS (SELECT a.*, c.*, 0.8::DOUBLE - step * 0.05::DOUBLE AS cosine FROM a JOIN cards c ON c.card_id = query_id + step)"""

_AGREES = {
    "player": _overlap("seen_player", "player") + " >= 0.999", "year": "seen_year = year", "brand": _overlap("seen_brand", "brand") + " >= 0.72", "set_name": f"CASE WHEN seen_set_name IS NOT NULL THEN {_overlap('seen_set_name', 'set_name')} >= 0.72 END", "card_number": "seen_card_number = card_number",
}
_FLAGS = ", ".join(f"{rule} AS ag_{f}" for f, rule in _AGREES.items())
_SHIFT = " + ".join(f"coalesce(sure_{f} * CASE WHEN ag_{f} THEN {X.FIELD_WEIGHTS[f]}::DOUBLE WHEN ag_{f} IS NULL THEN 0 " + (f"WHEN sure_{f} >= 0.75 THEN {-1.65 * X.FIELD_WEIGHTS[f]}::DOUBLE " if f in X.HARD_FIELDS else "") + f"ELSE {-0.75 * X.FIELD_WEIGHTS[f]}::DOUBLE END, 0)" for f in _AGREES)
_MATCHED = ", ".join(f"CASE WHEN ag_{f} THEN '{f}' END" for f in X.FIELD_WEIGHTS if f in _AGREES)
_CONFLICTS = ", ".join(f"CASE WHEN NOT ag_{f} AND sure_{f} >= 0.75 THEN '{f}' END" for f in X.FIELD_WEIGHTS if f in X.HARD_FIELDS)

OBSERVED_SQL = rf"""ob AS (SELECT event_id // 7 AS item, {pick_sql(FIELDS, 'event_id // 2')} AS field, {pick_sql(VALUES, 'event_id * 3 + event_id // 11')} AS value, {pick_sql(['vision', 'manual', 'cert'], 'event_id')} AS source, (event_id * 7 % 11) / 10.0::DOUBLE AS confidence FROM events
), gr AS (SELECT item, field, {_norm('value')} AS v, max(confidence) AS c, count(*) AS n, max((confidence, value))[2] AS value FROM ob GROUP BY ALL
), fi AS (SELECT item, field, max((c, n, value)) AS best, count(*) FILTER (WHERE c >= 0.6::DOUBLE) AS confident FROM gr GROUP BY ALL
), led AS (SELECT item, field, CASE WHEN confident >= 2 THEN 'conflicted' ELSE 'supported' END AS status, CASE WHEN confident < 2 THEN best[3] END AS value, CASE WHEN confident < 2 THEN best[1] END AS confidence, (SELECT count(DISTINCT source) FROM ob WHERE ob.item = fi.item AND ob.field = fi.field) AS sources FROM fi)"""

ORACLES = {
    "visual_rerank": rf"""WITH {CANDIDATES_SQL}, fl AS (SELECT *, {_FLAGS} FROM cand), sc AS (SELECT *, round(least(1, greatest(0, cosine + {_SHIFT})), 6) AS score, concat_ws(',', {_MATCHED}) AS matched, concat_ws(',', {_CONFLICTS}) AS conflicts FROM fl
      ), rk AS (SELECT *, row_number() OVER w::INT AS rank, sum((conflicts = '')::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS via FROM sc WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, cosine DESC, card_id)
      ), mg AS (SELECT *, round(max(score) FILTER (WHERE conflicts = '' AND via = 1) OVER (PARTITION BY query_id) - coalesce(max(score) FILTER (WHERE conflicts = '' AND via = 2) OVER (PARTITION BY query_id), 0), 6) AS margin FROM rk)
      SELECT query_id, rank, card_id, score, matched, conflicts, margin, CASE WHEN conflicts <> '' OR via <> 1 THEN NULL WHEN score >= 0.88 AND margin >= 0.07 AND (ag_card_number OR (coalesce(ag_set_name, false) AND ag_year)) THEN 'exact' WHEN score >= 0.72 AND margin >= 0.035 THEN 'likely' ELSE 'unresolved' END AS status FROM mg""",
    "constrained_candidates": f"WITH {CANDIDATES_SQL} SELECT query_id, card_id, cosine FROM cand WHERE year = 1992 AND card_id % 3 <> 0",
    "evidence_ledger": f"WITH {OBSERVED_SQL} SELECT item, field, status, value, confidence, sources FROM led",
    "recognition_decisions": rf"""WITH {OBSERVED_SQL}, s AS (SELECT item, count(*) AS fields, count(*) FILTER (WHERE status = 'conflicted' OR confidence >= 0.6::DOUBLE) AS supported, count(*) FILTER (WHERE status = 'conflicted') AS conflicted FROM led WHERE item % 9 <> 0 GROUP BY item
      ), c AS (SELECT event_id // 7 AS item, event_id % 7 + 1 AS rank, 0.9::DOUBLE - (event_id % 7) * {pick_sql([0.2, 0.03, 0.1], 'event_id // 7')}::DOUBLE AS confidence FROM events WHERE event_id % 7 < 3 AND (event_id // 7) % 8 <> 0 AND NOT ((event_id // 7) % 5 = 1 AND event_id % 7 > 0)
      ), t AS (SELECT item, count(*) AS n, max(confidence) FILTER (WHERE rank = 1) AS f, max(confidence) FILTER (WHERE rank = 2) AS g FROM c GROUP BY item
      ), b AS (SELECT item, coalesce(fields, 0) AS fields, coalesce(supported, 0) AS supported, coalesce(conflicted, 0) AS conflicted, coalesce(n, 0) AS n, CASE WHEN coalesce(round(f - g, 6) >= 0.08, false) AND n > 1 THEN 1 ELSE coalesce(n, 0) END AS choices FROM s FULL JOIN t USING (item)
      ), r AS (SELECT *, concat_ws(',', CASE WHEN fields = 0 THEN 'no_observed_identity_evidence' END, CASE WHEN conflicted > 0 THEN 'critical_evidence_conflict' END, CASE WHEN n = 0 THEN 'no_candidate' END, CASE WHEN fields > 0 AND supported < 2 THEN 'insufficient_observed_fields' END, CASE WHEN choices > 1 THEN 'ambiguous_prediction_set' END) AS reasons FROM b)
      SELECT item, CASE WHEN fields = 0 OR conflicted > 0 OR n = 0 THEN 'abstained' WHEN reasons <> '' THEN 'review' ELSE 'accepted' END AS status, reasons, choices FROM r""",
    "learned_boosts": rf"""WITH {CANDIDATES_SQL}, x AS (SELECT query_id AS item, card_id, cosine, CASE WHEN card_id % 2 = 0 THEN {_overlap("CASE WHEN card_id % 3 = 0 THEN set_name ELSE 'no reason' END", "player || ' ' || set_name")} END AS o FROM cand
      ), y AS (SELECT *, round(CASE WHEN o IS NULL THEN 0 WHEN o > 0 THEN 0.03::DOUBLE + o * 0.05::DOUBLE ELSE 0.02::DOUBLE END, 6) AS boost FROM x) SELECT item, card_id, least(0.995::DOUBLE, round(cosine + boost, 6)) AS confidence, boost FROM y""",
    "image_pair_scores": """SELECT page_id, round(0.12::DOUBLE * greatest(0, 1 - (page_id * 3 % 31) / 24.0::DOUBLE) + 0.16::DOUBLE * ((page_id * 5 % 7) / 7.0::DOUBLE) + 0.23::DOUBLE * least(1, (page_id * 7 % 11) / 11.0::DOUBLE / 0.40::DOUBLE) + 0.43::DOUBLE * least(1, (page_id * 11 % 13) / 13.0::DOUBLE / 0.85::DOUBLE)
      + 0.06::DOUBLE * least(1, (page_id * 13 % 101) / 80.0::DOUBLE), 6) AS score FROM pages""",
    "card_aware_sales": rf"""WITH {SALES_SQL}, {CARDS_SQL}, own AS (SELECT card_id, grader || ' ' || grade::VARCHAR AS grade, {pick_sql(['gold', None, 'silver'], 'card_id')} AS parallel FROM cards
      ), x AS (SELECT s.card_id AS asked_id, raw_id, seen[6] AS list_price, confidence, seen[4] % 11 <> 0 AS same, seen[2] <> 2 AS p, seen[2] <> 3 AS y, CASE WHEN seen[4] % 7 = 0 THEN 'PSA 1' WHEN seen[4] % 7 = 1 THEN NULL ELSE grade END AS sg, grade, CASE WHEN seen[2] % 2 = 0 THEN 'gold' END AS sp, parallel FROM sales s JOIN own USING (card_id)
      ), m AS (SELECT *, floor(least(100, greatest(1, (CASE WHEN same THEN 35.0::DOUBLE ELSE 0 END + CASE WHEN p THEN 16 ELSE 0 END + 12 + 16 + CASE WHEN y THEN 12 ELSE 0 END + CASE WHEN sg = grade THEN 10 ELSE 0 END + CASE WHEN sp = parallel THEN 14 ELSE 0 END)
          / (35 + CASE WHEN p THEN 16 ELSE 0 END + 12 + 16 + 12 + CASE WHEN sg IS NULL THEN 0 ELSE 10 END + CASE WHEN sp IS NULL OR parallel IS NULL THEN 0 ELSE 14 END) * 100 + confidence * 10)) + 0.5)::BIGINT AS match_score FROM x)
      SELECT asked_id, raw_id, list_price, match_score, CASE WHEN NOT same THEN 'excluded_wrong_card' WHEN sg <> grade THEN 'excluded_wrong_grade' WHEN sp <> parallel THEN 'excluded_wrong_parallel' WHEN parallel IS NOT NULL AND sp IS NULL AND match_score < 82 THEN 'needs_review' END AS mismatch FROM m""",
    "reviewed_sales": f"""WITH {JUDGED_SQL}, d AS (SELECT *, seen[1] AS o FROM firsts), r AS (SELECT CASE WHEN o % 5 = 0 AND status0 NOT IN ('excluded_active_listing', 'excluded_missing_price', 'excluded_missing_sale_date', 'excluded_future_sale') THEN 'included' WHEN o % 5 <> 0 AND o % 7 = 0 THEN 'excluded_wrong_card' ELSE status0 END AS status FROM d)
      SELECT status, status = 'included' AS usable, count(*) AS sales FROM r GROUP BY ALL""",
}
