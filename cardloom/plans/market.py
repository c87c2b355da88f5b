"""Queries on sales: scores, provider quality, values, asking context, prices, lots, dealer offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions.expr import half_up, money
from cardloom.operators.scoring import judge_sales, score_sales
from cardloom.operators.valuation import WINDOWS, asking_context, dealer_offers, lot_economics, robust_prices, value_sales
from cardloom.plans.views import ASKS_SQL, SALES_SQL, as_of, as_sales, asks, cards, sale_lines, sales
from cardloom.session import table

JUDGED_SQL = (
    SALES_SQL
    + r""", aged AS (
  SELECT *, greatest((epoch_us(TIMESTAMP '2001-11-05 00:00:00') - epoch_us(sold_at)) / 86400000000.0::DOUBLE, 0) AS age,
    floor(least(100, greatest(1, coalesce(nullif(confidence, 0), 0.7) * 100)) + 0.5)::BIGINT AS match_score,
    CASE basis WHEN 'official_api' THEN 96 WHEN 'ebay_api' THEN 96 WHEN 'written_license' THEN 92 WHEN 'commercial_partner' THEN 88
      WHEN 'user_authorized_export' THEN 80 WHEN 'user_csv' THEN CASE WHEN verified THEN 76 ELSE 68 END ELSE CASE WHEN verified THEN 60 ELSE 28 END END::BIGINT AS trust_score,
    CASE WHEN all_in IS NULL OR all_in < 0 THEN 0 ELSE 72 + 8 + 6 + CASE sale_type WHEN 'auction' THEN 6 WHEN 'private' THEN -8 ELSE 0 END END::BIGINT AS reliability_score,
    54::BIGINT AS completeness_score FROM sales
), scored AS (
  SELECT *, floor(least(100, greatest(8, 100 * exp(-age / 180))) + 0.5)::BIGINT AS freshness_score,
    CASE WHEN all_in IS NULL OR all_in < 0 THEN 'excluded_missing_price' WHEN sold_at IS NULL THEN 'excluded_missing_sale_date'
      WHEN sold_at > TIMESTAMP '2001-11-05 00:00:00' THEN 'excluded_future_sale' WHEN NOT completed THEN 'excluded_active_listing'
      WHEN basis = 'scraped' THEN 'excluded_unverified_source' WHEN trust_score < 45 OR match_score < 68 THEN 'needs_review' ELSE 'included' END AS status0
  FROM aged
), firsts AS (
  SELECT *, floor(least(100, match_score * 0.30::DOUBLE + trust_score * 0.25::DOUBLE + freshness_score * 0.16::DOUBLE + reliability_score * 0.18::DOUBLE + completeness_score * 0.11::DOUBLE) + 0.5)::BIGINT AS quality_score,
    floor(least(100, match_score * 0.42::DOUBLE + trust_score * 0.26::DOUBLE + reliability_score * 0.18::DOUBLE + completeness_score * 0.14::DOUBLE) + 0.5)::BIGINT AS confidence_score,
    row_number() OVER (PARTITION BY card_id, provider, raw_id ORDER BY seen) > 1 AS is_repeat FROM scored
), fenced AS (
  SELECT *, status0 = 'included' AND NOT is_repeat AS usable0 FROM firsts
), bands AS (
  SELECT card_id, count(*) AS n, quantile_cont(all_in, 0.25) AS q1, quantile_cont(all_in, 0.75) AS q3 FROM fenced WHERE usable0 GROUP BY card_id
), judged AS (
  SELECT f.*, coalesce(usable0 AND n >= 5 AND (all_in < greatest(0, q1 - 1.5 * (q3 - q1)) OR all_in > q3 + 1.5 * (q3 - q1)), false) AS is_outlier,
    usable0 AND NOT coalesce(n >= 5 AND (all_in < greatest(0, q1 - 1.5 * (q3 - q1)) OR all_in > q3 + 1.5 * (q3 - q1)), false) AS usable,
    CASE WHEN is_repeat AND status0 = 'included' THEN 'excluded_duplicate'
      WHEN usable0 AND n >= 5 AND (all_in < greatest(0, q1 - 1.5 * (q3 - q1)) OR all_in > q3 + 1.5 * (q3 - q1)) THEN 'excluded_outlier' ELSE status0 END AS status
  FROM fenced f LEFT JOIN bands USING (card_id)
)"""
)

_money = lambda x: f"floor(({x}) * 100 + 0.5) / 100"


def _window_sql(days: int) -> str:
    ok = f"usable AND status = 'included' AND age <= {days}"
    agg = lambda f: f"floor(({f} FILTER (WHERE {ok})) * 100 + 0.5) / 100"
    return f"""count(*) FILTER (WHERE {ok}) AS d{days}_count, {agg('min(all_in)')} AS d{days}_low, {agg('quantile_cont(all_in, 0.25)')} AS d{days}_p25,
    {agg('quantile_cont(all_in, 0.5)')} AS d{days}_median, {agg('avg(all_in)')} AS d{days}_average, {agg('quantile_cont(all_in, 0.75)')} AS d{days}_p75, {agg('max(all_in)')} AS d{days}_high,
    {_money(f"sum(all_in * w_aged) FILTER (WHERE {ok}) / sum(w_aged) FILTER (WHERE {ok})")} AS d{days}_weighted"""


def _prior_sql(least: int, most: int) -> str:
    ok = f"usable AND status = 'included' AND age > {least} AND age <= {most}"
    return _money(f"sum(all_in * w_plain) FILTER (WHERE {ok}) / sum(w_plain) FILTER (WHERE {ok})")


VALUED_SQL = (
    JUDGED_SQL
    + rf""", weighed AS (
  SELECT *, CASE WHEN verified THEN 1.18 ELSE 0.9 END::DOUBLE * least(1.0::DOUBLE, greatest(0.1::DOUBLE, confidence)) * CASE WHEN sale_type = 'auction' THEN 1.04 ELSE 1.0 END::DOUBLE
    * CASE WHEN quality_score > 0 THEN least(1.2::DOUBLE, greatest(0.45::DOUBLE, quality_score / 80.0::DOUBLE)) ELSE 1 END AS w_plain FROM judged
), aged_w AS (SELECT *, exp(-age / 45) * w_plain AS w_aged FROM weighed
), g AS (
  SELECT card_id, count(*) AS sales, count(*) FILTER (WHERE usable AND status = 'included') AS included, count(*) FILTER (WHERE status LIKE 'excluded%') AS excluded,
    count(*) FILTER (WHERE status = 'needs_review') AS in_review, count(DISTINCT provider) FILTER (WHERE usable AND status = 'included') AS providers,
    count(*) FILTER (WHERE is_outlier) AS outliers, count(*) FILTER (WHERE status = 'excluded_duplicate') AS duplicates, count(*) FILTER (WHERE usable AND status = 'included' AND verified) AS verified,
    coalesce(floor(avg(quality_score) + 0.5), 0)::BIGINT AS avg_quality, coalesce(floor(avg(trust_score) + 0.5), 0)::BIGINT AS avg_trust, coalesce(floor(avg(match_score) + 0.5), 0)::BIGINT AS avg_match,
    {", ".join(map(_window_sql, WINDOWS))},
    {_prior_sql(30, 60)} AS prior30, {_prior_sql(90, 180)} AS prior90,
    floor((quantile_cont(all_in, 0.5) FILTER (WHERE usable AND status = 'included')) * 100 + 0.5) / 100 AS med,
    quantile_cont(all_in, 0.75) FILTER (WHERE usable AND status = 'included') - quantile_cont(all_in, 0.25) FILTER (WHERE usable AND status = 'included') AS spread,
    max(sold_at) FILTER (WHERE usable AND status = 'included') AS last_sale_at, min(age) FILTER (WHERE usable AND status = 'included') AS last_age
  FROM aged_w GROUP BY card_id
), h AS (
  SELECT *, floor(least(99, greatest(4, 100 * (0.27::DOUBLE * least(1, log10(included + 1) / 1.7::DOUBLE) + 0.2::DOUBLE * least(1, providers / 4.0::DOUBLE)
      + 0.18::DOUBLE * CASE WHEN included > 0 THEN verified / included::DOUBLE ELSE 0 END + 0.2::DOUBLE * avg_quality / 100.0::DOUBLE + 0.15::DOUBLE * avg_trust / 100.0::DOUBLE
      - 0.22::DOUBLE * CASE WHEN included > 0 THEN outliers / (included + outliers)::DOUBLE WHEN outliers > 0 THEN 0.5 ELSE 0 END
      - 0.12::DOUBLE * CASE WHEN included > 0 THEN duplicates / (included + duplicates)::DOUBLE WHEN duplicates > 0 THEN 0.5 ELSE 0 END))) + 0.5)::BIGINT AS confidence,
    coalesce(d30_weighted, d90_weighted, d180_weighted, med) AS value,
    CASE WHEN d30_weighted <> 0 AND prior30 <> 0 THEN {_money("(d30_weighted - prior30) / prior30 * 100")} END AS trend30,
    CASE WHEN d90_weighted <> 0 AND prior90 <> 0 THEN {_money("(d90_weighted - prior90) / prior90 * 100")} END AS trend90,
    floor(least(100, greatest(0, log10(d90_count / 3.0::DOUBLE + 1) / 1.5::DOUBLE * 70 + providers / 4.0::DOUBLE * 30)) + 0.5)::BIGINT AS liquidity,
    {_money("d90_count / 3.0::DOUBLE")} AS velocity, {_money("last_age * 24")} AS freshness_hours FROM g
), p AS (
  SELECT *, greatest(value * CASE WHEN confidence >= 80 THEN 0.08 WHEN confidence >= 60 THEN 0.14 ELSE 0.24 END::DOUBLE, CASE WHEN included >= 2 THEN spread / 2 ELSE 0 END) AS padding FROM h
), valued AS (
  SELECT *, {_money("greatest(0, value - padding)")} AS range_low, {_money("value + padding")} AS range_high, d90_count AS volume90,
    CASE WHEN trend30 IS NULL THEN 'insufficient_data' WHEN trend30 > 3 THEN 'rising' WHEN trend30 < -3 THEN 'falling' ELSE 'steady' END AS direction FROM p
)"""
)

VALUE_COLUMNS = [
    "card_id", "sales", "included", "excluded", "in_review", "providers", "outliers", "duplicates", "verified", "avg_quality", "avg_trust", "avg_match",
    *[f"d{d}_{n}" for d in WINDOWS for n in ("count", "low", "p25", "median", "average", "p75", "high", "weighted")],
    "confidence", "value", "range_low", "range_high", "trend30", "trend90", "direction", "liquidity", "velocity", "freshness_hours", "volume90",
]


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_sales(sale_lines(spark, sf_dir), as_of(), made=as_sales)


def valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_sales(sale_lines(spark, sf_dir), as_of(), made=as_sales)


def comp_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores and status of every sale by itself."""
    scored = score_sales(sales(spark, sf_dir), as_of())
    return scored.select("card_id", "provider", "raw_id", "match_score", "trust_score", "freshness_score", "reliability_score", "completeness_score", "quality_score", "confidence_score", "status", F.array_join("reasons", ",").alias("reasons"))


def comp_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sale after repeats and outliers of its card."""
    return judged(spark, sf_dir).select("card_id", "provider", "raw_id", "status", "usable", "is_repeat", "is_outlier", money("all_in").alias("all_in"))


def card_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of each card with its windows, trends, liquidity and confidence."""
    return valued(spark, sf_dir).select(VALUE_COLUMNS)


def provider_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales of each provider by status, their worth, and the share that counts."""
    grouped = judged(spark, sf_dir).groupBy("provider").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "included").alias("included"), F.count_if(F.col("status") == "needs_review").alias("in_review"),
        F.count_if(F.col("status").startswith("excluded")).alias("excluded"), money(F.sum(F.when(F.col("status") == "included", F.col("all_in")))).alias("included_value"), half_up(F.avg("quality_score")).alias("avg_quality"),
    )
    return grouped.withColumn("inclusion_rate", money(F.col("included") / F.col("total") * 100))


def comp_quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales and mean scores by status."""
    mean = lambda c: half_up(F.avg(c)).alias(f"avg_{c}")
    return judged(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("sales"), *map(mean, ["quality_score", "trust_score", "match_score", "completeness_score"]))


def data_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards with thin, doubtful or outlier-ridden sales, counted."""
    v = valued(spark, sf_dir)
    outlier_rate = F.col("outliers") / F.col("sales")
    return v.groupBy().agg(
        F.count(F.lit(1)).alias("cards_with_sales"), F.count_if(F.col("included") == 0).alias("cards_without_comps"), F.count_if(F.col("confidence") < 55).alias("low_confidence"),
        F.count_if((F.col("sales") >= 5) & (outlier_rate >= 0.25)).alias("outlier_heavy"), F.sum("sales").alias("sales"), F.sum("included").alias("included"), F.sum("in_review").alias("in_review"),
        F.sum("duplicates").alias("duplicates"), F.sum("outliers").alias("outliers"), F.count_if(F.col("freshness_hours") > 24 * 30).alias("stale"),
    )


def card_coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of the catalog without an included sale in the last 30 days."""
    kept = judged(spark, sf_dir).filter("status = 'included' AND age_days <= 30").select("card_id").distinct()
    return cards(spark, sf_dir).join(kept, "card_id", "left_anti").select("card_id", "brand", "sport")


def market_pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight cards each: hot by liquidity and trend, rising, falling. A missing trend counts as 0 when hot."""
    v = valued(spark, sf_dir).filter("value is not null").select("card_id", "value", "trend30", "liquidity")
    top = lambda df, name, *order: df.orderBy(*order, "card_id").limit(8).withColumn("list", F.lit(name))
    hot = v.withColumn("_heat", F.col("liquidity") + F.coalesce("trend30", F.lit(0.0)))
    return (
        top(hot, "hot", F.desc("_heat")).drop("_heat").unionByName(top(v.filter("trend30 > 0"), "rising", F.desc("trend30"))).unionByName(top(v.filter("trend30 < 0"), "falling", F.asc("trend30")))
    )


def asking_price_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asking_context(asks(spark, sf_dir), valued(spark, sf_dir))


def robust_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers for each card from its verified prices."""
    return robust_prices(sales(spark, sf_dir).filter("verified"), "card_id", "price")


def lot_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a lot of its lines, valued by the cards' values and asked at its price."""
    v = valued(spark, sf_dir).select("card_id", F.col("value").alias("mid"), F.col("range_low").alias("low"), F.col("range_high").alias("high"), (F.col("confidence") / 100).alias("sure"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("lot"), F.col("l_partkey").alias("card_id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("_price"))
    priced = lines.join(v, "card_id", "left").join(lines.groupBy("lot").agg((F.sum("_price") * 0.7).alias("asked")), "lot")
    return lot_economics(priced, "lot")


def dealer_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealer_offers(valued(spark, sf_dir))


QUERIES = {
    "comp_scores": comp_scores, "comp_decisions": comp_decisions, "card_valuation": card_valuation, "provider_quality": provider_quality, "comp_quality_summary": comp_quality_summary,
    "data_health": data_health, "card_coverage_gaps": card_coverage_gaps, "market_pulse": market_pulse, "asking_price_context": asking_price_context, "robust_pricing": robust_pricing,
    "lot_decisions": lot_decisions, "dealer_decisions": dealer_decisions,
}

ORACLES = {
    "comp_scores": f"""WITH {JUDGED_SQL} SELECT card_id, provider, raw_id, match_score, trust_score, freshness_score, reliability_score, completeness_score, quality_score, confidence_score, status0 AS status,
      concat_ws(',', CASE WHEN NOT completed THEN 'excluded_active_listing' END, CASE WHEN basis = 'scraped' THEN 'excluded_unverified_source' END,
        CASE WHEN completed AND basis <> 'scraped' AND trust_score < 45 THEN 'low_trust' END, CASE WHEN completed AND basis <> 'scraped' AND match_score < 68 THEN 'low_match' END) AS reasons FROM firsts""",
    "comp_decisions": f"WITH {JUDGED_SQL} SELECT card_id, provider, raw_id, status, usable, is_repeat, is_outlier, {_money('all_in')} AS all_in FROM judged",
    "card_valuation": f"WITH {VALUED_SQL} SELECT {', '.join(VALUE_COLUMNS)} FROM valued",
    "provider_quality": f"""WITH {JUDGED_SQL} SELECT provider, count(*) AS total, count(*) FILTER (WHERE status = 'included') AS included, count(*) FILTER (WHERE status = 'needs_review') AS in_review,
      count(*) FILTER (WHERE status LIKE 'excluded%') AS excluded, {_money("sum(all_in) FILTER (WHERE status = 'included')")} AS included_value, floor(avg(quality_score) + 0.5)::BIGINT AS avg_quality,
      {_money("count(*) FILTER (WHERE status = 'included') / count(*)::DOUBLE * 100")} AS inclusion_rate FROM judged GROUP BY provider""",
    "comp_quality_summary": f"""WITH {JUDGED_SQL} SELECT status, count(*) AS sales, {", ".join(f"floor(avg({c}) + 0.5)::BIGINT AS avg_{c}" for c in ("quality_score", "trust_score", "match_score", "completeness_score"))}
      FROM judged GROUP BY status""",
    "data_health": f"""WITH {VALUED_SQL} SELECT count(*) AS cards_with_sales, count(*) FILTER (WHERE included = 0) AS cards_without_comps, count(*) FILTER (WHERE confidence < 55) AS low_confidence,
      count(*) FILTER (WHERE sales >= 5 AND outliers / sales::DOUBLE >= 0.25) AS outlier_heavy, sum(sales)::BIGINT AS sales, sum(included)::BIGINT AS included, sum(in_review)::BIGINT AS in_review,
      sum(duplicates)::BIGINT AS duplicates, sum(outliers)::BIGINT AS outliers, count(*) FILTER (WHERE freshness_hours > 720) AS stale FROM valued""",
    "card_coverage_gaps": f"""WITH {JUDGED_SQL} SELECT p_partkey AS card_id, p_brand AS brand, (['baseball','basketball','football','hockey','soccer'])[p_partkey % 5 + 1] AS sport FROM part
      WHERE p_partkey NOT IN (SELECT card_id FROM judged WHERE status = 'included' AND age <= 30)""",
    "market_pulse": f"""WITH {VALUED_SQL}, v AS (SELECT card_id, value, trend30, liquidity FROM valued WHERE value IS NOT NULL)
      SELECT card_id, value, trend30, liquidity, list FROM (
        SELECT *, 'hot' AS list, row_number() OVER (ORDER BY liquidity + coalesce(trend30, 0) DESC, card_id) AS r FROM v
        UNION ALL SELECT *, 'rising', row_number() OVER (ORDER BY trend30 DESC, card_id) FROM v WHERE trend30 > 0
        UNION ALL SELECT *, 'falling', row_number() OVER (ORDER BY trend30, card_id) FROM v WHERE trend30 < 0) WHERE r <= 8""",
    "asking_price_context": f"""WITH {VALUED_SQL}, {ASKS_SQL}, a1 AS (
        SELECT *, row_number() OVER (PARTITION BY card_id, provider, item, ask ORDER BY seen) = 1 AND fixed_price AND ask IS NOT NULL AS ok FROM asks
      ), b AS (SELECT card_id, count(*) AS n, quantile_cont(ask, 0.25) AS q1, quantile_cont(ask, 0.75) AS q3 FROM a1 WHERE ok GROUP BY card_id
      ), a2 AS (SELECT a1.*, ok AND NOT coalesce(n >= 5 AND (ask < greatest(0, q1 - 1.5 * (q3 - q1)) OR ask > q3 + 1.5 * (q3 - q1)), false) AS keep FROM a1 LEFT JOIN b USING (card_id)
      ), c AS (SELECT card_id, count(*) FILTER (WHERE keep) AS asks, count(*) FILTER (WHERE NOT keep) AS rejected, count(DISTINCT provider) FILTER (WHERE keep) AS sources,
        {_money("min(ask) FILTER (WHERE keep)")} AS low, {_money("(quantile_cont(ask, 0.25) FILTER (WHERE keep))")} AS p25, {_money("(quantile_cont(ask, 0.5) FILTER (WHERE keep))")} AS median_ask,
        {_money("(quantile_cont(ask, 0.75) FILTER (WHERE keep))")} AS p75, {_money("max(ask) FILTER (WHERE keep)")} AS high FROM a2 GROUP BY card_id
      ), d AS (SELECT c.*, v.value, v.confidence AS sure, CASE WHEN median_ask <> 0 THEN {_money("(p75 - p25) / median_ask * 100")} END AS spread_pct,
        CASE WHEN median_ask <> 0 AND v.value <> 0 THEN {_money("(median_ask - v.value) / v.value * 100")} END AS ask_vs_value_pct,
        CASE WHEN NOT coalesce(median_ask <> 0 AND v.value <> 0, false) THEN 'context_only' WHEN (median_ask - v.value) / v.value * 100 > 45 THEN 'asks_far_above_sales'
          WHEN (median_ask - v.value) / v.value * 100 > 18 THEN 'asks_above_sales' WHEN (median_ask - v.value) / v.value * 100 < -35 THEN 'asks_far_below_sales'
          WHEN (median_ask - v.value) / v.value * 100 < -15 THEN 'asks_below_sales' ELSE 'aligned_with_sales' END AS alignment FROM c LEFT JOIN valued v USING (card_id)
      ), e AS (SELECT *, floor(least(96, greatest(CASE WHEN asks > 0 THEN 12 ELSE 0 END, 100 * (least(1, log10(asks + 1) / 1.15::DOUBLE) * 0.4::DOUBLE
          + coalesce(least(1, greatest(0, 1 - spread_pct / 110)), 0) * 0.35::DOUBLE
          + CASE WHEN NOT coalesce(value <> 0, false) THEN 0.55 WHEN alignment = 'aligned_with_sales' THEN 1 WHEN alignment LIKE '%far%' THEN 0.32 ELSE 0.68 END::DOUBLE * 0.25::DOUBLE))) + 0.5)::BIGINT AS context_score,
        CASE WHEN asks = 0 THEN 'unavailable' WHEN asks < 3 THEN 'thin_context' WHEN spread_pct > 80 THEN 'noisy_asks' WHEN coalesce(value <> 0, false) AND alignment LIKE '%far%' THEN 'market_disagreement'
          WHEN asks >= 8 AND spread_pct <= 35 THEN 'strong_pricing_context' ELSE 'useful_pricing_context' END AS rating FROM d)
      SELECT card_id, asks, rejected, sources, low, p25, median_ask, p75, high, value, spread_pct, ask_vs_value_pct, alignment, context_score, rating,
        CASE WHEN median_ask <> 0 AND value <> 0 THEN {_money("value * 0.7::DOUBLE + median_ask * 0.3::DOUBLE")} WHEN median_ask IS NOT NULL THEN {_money("coalesce(nullif(p25, 0), median_ask) * 0.98::DOUBLE")} END AS list_anchor,
        CASE WHEN sure > 0 THEN floor(least(99, greatest(4, sure + (context_score - 60) * 0.18::DOUBLE)) + 0.5) WHEN asks > 0 THEN floor(least(68, greatest(8, context_score * 0.72::DOUBLE)) + 0.5) ELSE 0 END::BIGINT AS pricing_confidence FROM e""",
    "robust_pricing": f"""WITH {SALES_SQL}, r AS (SELECT card_id, (floor(price * 100 + 0.5) / 100)::DECIMAL(14,2) AS price FROM sales WHERE verified AND floor(price * 100 + 0.5) > 0
      ), b AS (SELECT card_id, count(*) AS n, quantile_cont(price::DOUBLE, 0.25) AS q1, quantile_cont(price::DOUBLE, 0.75) AS q3 FROM r GROUP BY card_id
      ), k AS (SELECT r.*, NOT (n >= 4 AND (price::DOUBLE < q1 - 1.5 * (q3 - q1) OR price::DOUBLE > q3 + 1.5 * (q3 - q1))) AS keep FROM r JOIN b USING (card_id)
      ), g AS (SELECT card_id, count(*) FILTER (WHERE keep) AS comps, count(*) FILTER (WHERE NOT keep) AS removed, quantile_cont(price::DOUBLE, 0.25) FILTER (WHERE keep) AS lo,
        quantile_cont(price::DOUBLE, 0.5) FILTER (WHERE keep) AS mid, quantile_cont(price::DOUBLE, 0.75) FILTER (WHERE keep) AS hi FROM k GROUP BY card_id)
      SELECT card_id, comps, removed, CASE WHEN comps >= 3 THEN 'priced' ELSE 'insufficient_comps' END AS status,
        CASE WHEN comps >= 3 THEN {_money("lo + 1e-7")} END AS value_low, CASE WHEN comps >= 3 THEN {_money("mid + 1e-7")} END AS value_mid, CASE WHEN comps >= 3 THEN {_money("hi + 1e-7")} END AS value_high,
        CASE WHEN comps >= 3 THEN {_money("mid * 0.60::DOUBLE + 1e-7")} END AS cash_low, CASE WHEN comps >= 3 THEN {_money("mid * 0.75::DOUBLE + 1e-7")} END AS cash_high, CASE WHEN comps >= 3 THEN {_money("mid * 1.10::DOUBLE + 1e-7")} END AS list_price,
        CASE WHEN comps >= 3 THEN floor((0.65::DOUBLE * least(comps / 12.0::DOUBLE, 1) + 0.35::DOUBLE * (1 - least(CASE WHEN mid > 0 THEN (hi - lo) / mid ELSE 1 END, 1))) * 10000 + 0.5) / 10000 ELSE 0 END AS confidence FROM g""",
    "lot_decisions": f"""WITH {VALUED_SQL}, l AS (SELECT l_orderkey AS lot, l_partkey AS card_id, l_extendedprice / l_quantity AS price FROM lineitem
      ), lg AS (SELECT lot, count(*) AS items, count(*) FILTER (WHERE v.confidence / 100.0::DOUBLE >= 0.7::DOUBLE) AS identified, count(*) FILTER (WHERE value > 0) AS priced,
        {_money("sum(coalesce(nullif(range_low, 0), value)) FILTER (WHERE value > 0)")} AS conservative, {_money("sum(value) FILTER (WHERE value > 0)")} AS expected,
        {_money("sum(coalesce(nullif(range_high, 0), value)) FILTER (WHERE value > 0)")} AS optimistic, {_money("sum(price) * 0.7::DOUBLE")} AS cost FROM l LEFT JOIN valued v USING (card_id) GROUP BY lot
       ), lf AS (SELECT *, {_money("expected * 0.1325::DOUBLE + priced * 0.30::DOUBLE")} AS fees FROM lg), ln AS (SELECT *, {_money("expected - fees")} AS net FROM lf), lq AS (SELECT *, {_money("net - cost")} AS profit FROM ln
      ), lr AS (SELECT *, CASE WHEN cost > 0 THEN floor(profit / cost * 10000 + 0.5) / 10000 END AS roi FROM lq)
      SELECT *, CASE WHEN priced > 0 THEN {_money("greatest(0, net / 1.25::DOUBLE)")} END AS max_purchase,
        CASE WHEN priced = 0 THEN 'NEEDS PRICING' WHEN profit > 0 AND coalesce(roi, 0) >= 0.25 THEN 'BUY TARGET' WHEN profit > 0 THEN 'MARGIN TOO THIN' ELSE 'PASS AT CURRENT PRICE' END AS decision,
        CASE WHEN priced = 0 THEN 'unpriced' WHEN priced / items::DOUBLE >= 0.9 THEN 'priced' ELSE 'partially_priced' END AS pricing_status FROM lr""",
    "dealer_decisions": f"""WITH {VALUED_SQL} SELECT card_id, {_money("nullif(value, 0) * 0.57::DOUBLE")} AS buy_low, {_money("nullif(value, 0) * 0.69::DOUBLE")} AS buy_high, {_money("nullif(value, 0) * 0.9::DOUBLE")} AS quick_price,
      {_money("nullif(value, 0) * 1.05::DOUBLE")} AS fair_price, {_money("nullif(value, 0) * 1.15::DOUBLE")} AS patient_price,
      CASE WHEN nullif(value, 0) IS NULL THEN 'research' WHEN confidence >= 75 AND liquidity >= 60 THEN 'buy_or_list' WHEN liquidity < 40 THEN 'consign' ELSE 'buy_low' END AS action,
      nullif(value, 0) IS NOT NULL AND confidence < 65 AS consignment_review FROM valued""",
}
