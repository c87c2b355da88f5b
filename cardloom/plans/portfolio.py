"""Queries on holdings: allocation, metrics, tax, scenario, inventory, trends, signals and shop actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions.expr import money
from cardloom.operators import portfolio as P
from cardloom.plans.market import VALUED_SQL, valued
from cardloom.plans.views import CARDS_SQL, HOLDINGS_SQL, SALES_SQL, as_of, cards, holdings, sales

_money = lambda x: f"floor(({x}) * 100 + 0.5) / 100"

HELD_SQL = f"""{VALUED_SQL}, {HOLDINGS_SQL}, {CARDS_SQL}, h0 AS (
  SELECT h.*, v.value, v.trend30, v.trend90, coalesce(v.liquidity, 28) AS liquidity, v.confidence, v.included, v.freshness_hours, v.avg_quality, v.avg_trust, v.avg_match, v.providers, v.in_review, v.outliers, v.duplicates,
    v.range_low, v.range_high, v.d7_weighted, v.d30_weighted, c.sport, c.player, c.year, c.brand, c.set_name, c.grader, c.grade,
    {_money("coalesce(v.value, 0)")} AS unit_value, {_money(_money("unit_cost") + " * quantity")} AS cost_basis
  FROM holdings h LEFT JOIN valued v USING (card_id) LEFT JOIN cards c USING (card_id)
), h1 AS (SELECT *, {_money("unit_value * quantity")} AS current_value FROM h0), h2 AS (SELECT *, {_money("current_value - cost_basis")} AS gain FROM h1), held AS (
  SELECT *, CASE WHEN cost_basis > 0 THEN {_money("gain / cost_basis * 100")} END AS gain_pct,
    CASE WHEN status = 'sold' THEN {_money(_money("sold_price") + " * quantity - cost_basis")} ELSE 0 END AS realized, CASE WHEN status = 'sold' THEN 0 ELSE gain END AS unrealized,
    {_money("current_value * least(0.98::DOUBLE, greatest(0.15::DOUBLE, liquidity / 100.0::DOUBLE))")} AS liquid_value,
    floor(greatest((epoch_us(TIMESTAMP '2001-11-05 00:00:00') - epoch_us(bought_at)) / 86400000000.0::DOUBLE, 0)) AS age_days, coalesce(confidence, 0) AS value_confidence,
    CASE WHEN grader = 'RAW' THEN 'Raw' WHEN grade >= 10 THEN grader || ' Gem Mint 10' WHEN grade >= 9 THEN grader || ' Mint 9' WHEN grade >= 8 THEN grader || ' NM-MT 8' ELSE grader || ' Graded <8' END AS tier,
    concat_ws(' ', year::VARCHAR, brand, set_name) AS set_label FROM h2
)"""

SIGNALS_SQL = f"""{HELD_SQL}, s0 AS (
  SELECT *, CASE WHEN included IS NOT NULL THEN coalesce(trend30, 0) END AS t30, CASE WHEN included IS NOT NULL THEN coalesce(trend90, 0) END AS t90,
    CASE WHEN d7_weighted <> 0 AND d30_weighted <> 0 THEN {_money("(d7_weighted - d30_weighted) / d30_weighted * 100")} END AS short FROM held WHERE status <> 'sold'
), s1 AS (SELECT *, {_money("avg(t30) OVER (PARTITION BY owner)")} AS mean30 FROM s0), s2 AS (SELECT *, {_money("t30 - mean30")} AS relative, coalesce(confidence, 0) AS base, coalesce(included, 0) AS comps FROM s1
), s3 AS (
  SELECT *, floor(least(99, greatest(0, 0.34::DOUBLE * base + 0.18::DOUBLE * coalesce(avg_quality, base) + 0.16::DOUBLE * coalesce(avg_trust, base) + 0.12::DOUBLE * coalesce(avg_match, base)
      + 0.1::DOUBLE * (least(1, coalesce(providers, 0) / 4.0::DOUBLE) * 100) + 0.07::DOUBLE * (least(1, log10(comps + 1) / 1.45::DOUBLE) * 100)
      + 0.03::DOUBLE * coalesce(CASE WHEN freshness_hours IS NOT NULL THEN least(100, greatest(0, 100 - freshness_hours / 24)) END, 0) - least(24, coalesce(in_review, 0) * 5 + coalesce(outliers, 0) * 2 + coalesce(duplicates, 0)))) + 0.5)::BIGINT AS sureness,
    floor(least(100, greatest(0, 0.42::DOUBLE * coalesce(CASE WHEN t30 IS NOT NULL THEN least(1, greatest(0, (t30 + 24) / 48)) * 100 END, 0) + 0.28::DOUBLE * coalesce(CASE WHEN t90 IS NOT NULL THEN least(1, greatest(0, (t90 + 30) / 60)) * 100 END, 0)
      + 0.2::DOUBLE * coalesce(CASE WHEN relative IS NOT NULL THEN least(1, greatest(0, (relative + 20) / 40)) * 100 END, 50) + 0.1::DOUBLE * coalesce(CASE WHEN short IS NOT NULL THEN least(1, greatest(0, (short + 18) / 36)) * 100 END, 50))) + 0.5)::BIGINT AS momentum FROM s2
), s4 AS (
  SELECT *, coalesce(value IS NULL OR value = 0, false) OR comps < 2 OR sureness < 45 AS thin, coalesce(t30 <= -8, false) AS falling,
    liquidity >= 55 AND sureness >= 64 AND (coalesce(t30 <= -8, false) OR coalesce(gain_pct >= 35, false) OR (coalesce(relative <= -12, false) AND coalesce(t90, 0) <= 0)) AS sell,
    sureness >= 70 AND liquidity >= 55 AND ((coalesce(t30 >= 8, false) AND coalesce(t90 IS NULL OR t90 >= 3, false)) OR coalesce(relative >= 6, false)) AND comps >= 3 AS buy FROM s3
), signals AS (
  SELECT *, CASE WHEN thin OR sureness < 58 THEN 'wait' WHEN sell THEN 'sell_now' WHEN buy THEN 'buy_more' WHEN liquidity < 35 THEN 'wait' ELSE 'hold' END AS action,
    CASE WHEN thin THEN greatest(20, floor(sureness / 2.0 + 0.5)) WHEN sureness < 58 THEN sureness
      WHEN sell THEN floor(least(100, (sureness + liquidity + CASE WHEN falling THEN 75 ELSE 55 END) / 3.0::DOUBLE) + 0.5) WHEN buy THEN floor(least(100, (sureness + liquidity + momentum) / 3.0::DOUBLE) + 0.5)
      WHEN liquidity < 35 THEN greatest(35, floor(sureness * 0.7::DOUBLE + 0.5)) ELSE floor(least(100, (sureness + liquidity + momentum) / 3.0::DOUBLE) + 0.5) END::BIGINT AS conviction,
    CASE WHEN t30 IS NULL AND t90 IS NULL THEN 'insufficient_data' WHEN momentum >= 70 THEN 'outperforming' WHEN momentum >= 48 THEN 'steady' ELSE 'weakening' END AS momentum_label,
    {_money("current_value - CASE WHEN value <> 0 AND t30 > -99 THEN " + _money("value / (1 + t30 / 100)") + " END * quantity")} AS change30 FROM s4
)"""


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.enrich(holdings(spark, sf_dir), valued(spark, sf_dir), cards(spark, sf_dir), as_of())


def holdings_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held(spark, sf_dir).select("owner", "item_id", "status", "quantity", "unit_value", "current_value", "cost_basis", "gain", "gain_pct", "realized", "unrealized", "liquidity", "liquid_value", F.col("age_days").cast("long").alias("age_days"), "tier")


def portfolio_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.allocation(held(spark, sf_dir))


def portfolio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.portfolio_metrics(held(spark, sf_dir))


def portfolio_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tax_estimate(held(spark, sf_dir), as_of())


def portfolio_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selling what trades well, and a fall of the market by a tenth."""
    return P.scenario(held(spark, sf_dir), F.col("liquidity") >= 55, -10.0)


def inventory_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.inventory_health(held(spark, sf_dir), sales(spark, sf_dir), as_of())


def portfolio_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.trends(held(spark, sf_dir))


def portfolio_trends_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.trends(held(spark, sf_dir), unit="year")


SIGNAL_COLUMNS = ["owner", "item_id", "card_id", "t30", "t90", "short", "relative", "sureness", "liquidity", "momentum", "momentum_label", "action", "conviction", "change30"]


def decision_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.signals(held(spark, sf_dir)).select(SIGNAL_COLUMNS)


def action_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings, value and mean scores of each action."""
    from cardloom.functions.expr import half_up

    mean = lambda c: half_up(F.avg(c)).alias(f"avg_{c}")
    return P.signals(held(spark, sf_dir)).groupBy("action").agg(F.count(F.lit(1)).alias("items"), money(F.sum("current_value")).alias("value"), money(F.sum("change30")).alias("change30"), mean("sureness"), mean("liquidity"), mean("momentum"))


def shop_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    acted = P.shop_actions(P.signals(held(spark, sf_dir)))
    return acted.select("item_id", "card_id", "status", "shop_action", "priority", money("suggested").alias("suggested"))


def portfolio_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five holdings each with the largest gain, the largest loss and the best liquidity."""
    rows = held(spark, sf_dir).filter("status <> 'sold'").select("item_id", "gain", "liquidity", "current_value")
    top = lambda name, *order: rows.orderBy(*order, "item_id").limit(5).withColumn("list", F.lit(name))
    return top("gainers", F.desc("gain")).unionByName(top("decliners", F.asc("gain"))).unionByName(top("liquid", F.desc("liquidity"), F.desc("current_value")))


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each owner should look at, by rule: thin values, profits to take, aging stock, and the count of each."""
    rows = held(spark, sf_dir).filter("status <> 'sold'")
    rules = [
        ((F.col("value_confidence") < 55) | (F.coalesce("included", F.lit(0)) < 2), "review_value", "high"),
        ((F.col("gain_pct") >= 40) & (F.col("liquidity") >= 65), "consider_sale", "medium"),
        ((F.col("age_days") > 180) & (F.col("liquidity") < 45), "aging_stock", "medium"),
    ]
    made = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(kind).alias("kind"), F.lit(priority).alias("priority"))) for c, kind, priority in rules]))
    return rows.select("owner", F.inline(made)).groupBy("owner", "kind", "priority").agg(F.count(F.lit(1)).alias("items"))


def collection_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings of an owner and card with one status put together."""
    rows = holdings(spark, sf_dir).withColumn("note", F.concat(F.lit("bought "), F.date_format("bought_at", "yyyy")))
    return P.merge_lots(rows, ["owner", "card_id", "status"])


QUERIES = {f.__name__: f for f in (holdings_enriched, portfolio_allocation, portfolio_metrics, portfolio_tax, portfolio_scenario, inventory_health, portfolio_trends, portfolio_trends_yearly, decision_signals, action_summary, shop_actions, portfolio_leaders, recommendations, collection_merge)}


def _trend_sql(form: str) -> str:
    return f"""WITH {HELD_SQL}, tr AS (SELECT owner, strftime(bought_at, '{form}') AS period, sum(quantity)::BIGINT AS quantity, sum(cost_basis) AS c, sum(current_value) AS v FROM held WHERE status <> 'sold' GROUP BY 1, 2
      ), rt AS (SELECT *, sum(c) OVER (PARTITION BY owner ORDER BY period ROWS UNBOUNDED PRECEDING) AS tc, sum(v) OVER (PARTITION BY owner ORDER BY period ROWS UNBOUNDED PRECEDING) AS tv FROM tr)
      SELECT owner, period, quantity, {_money("c")} AS cost_added, {_money("v")} AS value_added, {_money("tc")} AS cost_total, {_money("tv")} AS value_total, {_money("tv - tc")} AS gain_total FROM rt"""


_ACTIVE = "FILTER (WHERE status <> 'sold')"
_DIMENSIONS = " UNION ALL ".join(f"SELECT '{n}' AS dimension, {c}::VARCHAR AS label, * FROM held WHERE status <> 'sold'" for n, c in (("sport", "sport"), ("player", "player"), ("set", "set_label"), ("year", "year"), ("tier", "tier")))

ORACLES = {
    "holdings_enriched": f"WITH {HELD_SQL} SELECT owner, item_id, status, quantity, unit_value, current_value, cost_basis, gain, gain_pct, realized, unrealized, liquidity, liquid_value, age_days::BIGINT AS age_days, tier FROM held",
    "portfolio_allocation": f"""WITH {HELD_SQL}, d AS ({_DIMENSIONS}), ag AS (SELECT dimension, coalesce(label, 'Unknown') AS label, count(*) AS items, sum(quantity)::BIGINT AS quantity, sum(current_value) AS v, sum(cost_basis) AS c, sum(gain) AS gn,
        sum(liquid_value) AS lq, floor(avg(value_confidence) + 0.5)::BIGINT AS avg_confidence FROM d GROUP BY 1, 2)
      SELECT dimension, label, items, quantity, {_money("v")} AS value, {_money("c")} AS cost_basis, {_money("gn")} AS gain, CASE WHEN c > 0 THEN {_money("gn / c * 100")} END AS gain_pct,
        {_money("v / sum(v) OVER (PARTITION BY dimension) * 100")} AS pct_of_value, {_money("lq")} AS liquid_value, avg_confidence FROM ag""",
    "portfolio_metrics": f"""WITH {HELD_SQL}, mg AS (SELECT owner, count(*) {_ACTIVE} AS items, coalesce(sum(quantity) {_ACTIVE}, 0)::BIGINT AS quantity, coalesce(sum(current_value) {_ACTIVE}, 0) AS v, coalesce(sum(cost_basis) {_ACTIVE}, 0) AS c,
        sum(cost_basis) AS ac, coalesce(sum(liquid_value) {_ACTIVE}, 0) AS lq, coalesce(sum(unrealized) {_ACTIVE}, 0) AS u, coalesce(sum(realized) FILTER (WHERE status = 'sold'), 0) AS r,
        coalesce(floor(avg(value_confidence) {_ACTIVE} + 0.5), 0)::BIGINT AS avg_confidence, coalesce(floor(avg(liquidity) {_ACTIVE} + 0.5), 0)::BIGINT AS avg_liquidity, coalesce(floor(avg(avg_quality) {_ACTIVE} + 0.5), 0)::BIGINT AS avg_comp_quality,
        count(*) FILTER (WHERE status <> 'sold' AND (value_confidence < 55 OR coalesce(included, 0) < 2)) AS low_confidence, count(*) FILTER (WHERE status <> 'sold' AND coalesce(freshness_hours, 1e12) > 720) AS stale_values FROM held GROUP BY owner)
      SELECT owner, items, quantity, {_money("v")} AS current_value, {_money("c")} AS cost_basis, {_money("u")} AS unrealized_gain, CASE WHEN c > 0 THEN {_money("u / c * 100")} END AS unrealized_pct, {_money("r")} AS realized_gain,
        {_money("r + u")} AS total_gain, CASE WHEN ac > 0 THEN {_money("(r + u) / ac * 100")} END AS total_roi_pct, {_money("lq")} AS liquid_value, CASE WHEN v > 0 THEN {_money("(v - lq) / v * 100")} ELSE 0 END AS liquidity_discount,
        avg_confidence, avg_liquidity, avg_comp_quality, low_confidence, stale_values FROM mg""",
    "portfolio_tax": f"""WITH {HELD_SQL}, x AS (SELECT *, coalesce((epoch_us(TIMESTAMP '2001-11-05 00:00:00') - epoch_us(bought_at)) / 86400000000.0::DOUBLE >= 365, false) AS lt FROM held
      ), tx AS (SELECT owner, coalesce(sum(realized) FILTER (WHERE status = 'sold' AND NOT lt), 0) AS rs, coalesce(sum(realized) FILTER (WHERE status = 'sold' AND lt), 0) AS rl,
        coalesce(sum(unrealized) FILTER (WHERE status <> 'sold' AND NOT lt), 0) AS us, coalesce(sum(unrealized) FILTER (WHERE status <> 'sold' AND lt), 0) AS ul FROM x GROUP BY owner)
      SELECT owner, {_money("rs")} AS realized_short, {_money("rl")} AS realized_long, {_money("us")} AS unrealized_short, {_money("ul")} AS unrealized_long,
        {_money("greatest(0, rs) * 0.24::DOUBLE + greatest(0, rl) * 0.15::DOUBLE + 1e-7")} AS tax_realized,
        {_money("greatest(0, rs) * 0.24::DOUBLE + greatest(0, rl) * 0.15::DOUBLE + greatest(0, us) * 0.24::DOUBLE + greatest(0, ul) * 0.15::DOUBLE + 1e-7")} AS tax_if_sold FROM tx""",
    "portfolio_scenario": f"""WITH {HELD_SQL}, sc AS (SELECT owner, sum(current_value) AS v, coalesce(sum(current_value) FILTER (WHERE liquidity >= 55), 0) AS s, coalesce(sum(cost_basis) FILTER (WHERE liquidity >= 55), 0) AS c,
        count(*) FILTER (WHERE liquidity >= 55) AS selected FROM held WHERE status <> 'sold' GROUP BY owner)
      SELECT owner, selected, {_money("v")} AS current_value, {_money("s")} AS selected_value, {_money("s * 0.87::DOUBLE + 1e-7")} AS proceeds, {_money("s * 0.87::DOUBLE - c + 1e-7")} AS gain_if_sold,
        {_money("v * 0.9::DOUBLE + 1e-7")} AS value_after_move, {_money("v * 0.9::DOUBLE - v + 1e-7")} AS change, {_money("v - s")} AS remaining FROM sc""",
    "inventory_health": f"""WITH {HELD_SQL}, st AS (SELECT card_id, sum(quantity)::BIGINT AS quantity, {_money("sum(current_value)")} AS value, count(*) FILTER (WHERE age_days >= 120 AND liquidity < 55) AS aging FROM held WHERE status <> 'sold' GROUP BY card_id
      ), sr AS (SELECT card_id, count(*) AS n FROM sales WHERE greatest((epoch_us(TIMESTAMP '2001-11-05 00:00:00') - epoch_us(sold_at)) / 86400000000.0::DOUBLE, 0) <= 90 GROUP BY card_id
      ), sv AS (SELECT st.*, coalesce(n, 0) AS sales90, {_money("coalesce(n, 0) / 3.0::DOUBLE")} AS velocity FROM st LEFT JOIN sr USING (card_id))
      SELECT card_id, quantity, value, aging, sales90, velocity, CASE WHEN velocity > 0 THEN floor(quantity / velocity * 30 + 0.5)::BIGINT END AS days_of_supply,
        CASE WHEN velocity > 0 THEN greatest(1, ceil(velocity * 1.5))::BIGINT END AS reorder_point, velocity >= 1 AND quantity <= greatest(1, ceil(velocity)) AS low_stock FROM sv""",
    "portfolio_trends": _trend_sql("%Y-%m"),
    "portfolio_trends_yearly": _trend_sql("%Y"),
    "decision_signals": f"WITH {SIGNALS_SQL} SELECT {', '.join(SIGNAL_COLUMNS)} FROM signals",
    "action_summary": f"""WITH {SIGNALS_SQL} SELECT action, count(*) AS items, {_money("sum(current_value)")} AS value, {_money("sum(change30)")} AS change30, floor(avg(sureness) + 0.5)::BIGINT AS avg_sureness,
      floor(avg(liquidity) + 0.5)::BIGINT AS avg_liquidity, floor(avg(momentum) + 0.5)::BIGINT AS avg_momentum FROM signals GROUP BY action""",
    "shop_actions": f"""WITH {SIGNALS_SQL}, sa AS (SELECT *, coalesce(value IS NULL OR value = 0, false) OR sureness < 50 OR comps < 2 AS rv, status = 'listed' AND list_price IS NOT NULL AND coalesce(list_price > range_high * 1.12::DOUBLE, false) AS ov,
        status = 'listed' AND list_price IS NOT NULL AND coalesce(list_price < range_low * 0.9::DOUBLE, false) AND liquidity >= 55 AS un, status IN ('owned', 'hold') AND action IN ('sell_now', 'hold') AND liquidity >= 55 AS tl FROM signals)
      SELECT item_id, card_id, status, CASE WHEN rv THEN 'review' WHEN ov OR un THEN 'reprice' WHEN tl THEN 'list' ELSE 'hold' END AS shop_action,
        CASE WHEN rv OR ov THEN 'high' WHEN un THEN 'medium' WHEN tl THEN CASE WHEN action = 'sell_now' THEN 'high' ELSE 'medium' END WHEN action = 'buy_more' THEN 'medium' ELSE 'low' END AS priority,
        {_money("CASE WHEN rv THEN NULL WHEN ov THEN " + _money("value * 1.05::DOUBLE") + " WHEN un THEN " + _money("value * 1.03::DOUBLE") + " WHEN tl THEN " + _money("value * 1.05::DOUBLE") + " WHEN action = 'buy_more' THEN coalesce(list_price, " + _money("value * 1.12::DOUBLE") + ") ELSE coalesce(list_price, " + _money("value * 1.05::DOUBLE") + ") END")} AS suggested FROM sa""",
    "portfolio_leaders": f"""WITH {HELD_SQL}, r AS (SELECT item_id, gain, liquidity, current_value FROM held WHERE status <> 'sold') SELECT item_id, gain, liquidity, current_value, list FROM (
        SELECT *, 'gainers' AS list, row_number() OVER (ORDER BY gain DESC, item_id) AS n FROM r UNION ALL SELECT *, 'decliners', row_number() OVER (ORDER BY gain, item_id) FROM r
        UNION ALL SELECT *, 'liquid', row_number() OVER (ORDER BY liquidity DESC, current_value DESC, item_id) FROM r) WHERE n <= 5""",
    "recommendations": f"""WITH {HELD_SQL}, r AS (SELECT owner, 'review_value' AS kind, 'high' AS priority FROM held WHERE status <> 'sold' AND (value_confidence < 55 OR coalesce(included, 0) < 2)
        UNION ALL SELECT owner, 'consider_sale', 'medium' FROM held WHERE status <> 'sold' AND gain_pct >= 40 AND liquidity >= 65
        UNION ALL SELECT owner, 'aging_stock', 'medium' FROM held WHERE status <> 'sold' AND age_days > 180 AND liquidity < 45) SELECT owner, kind, priority, count(*) AS items FROM r GROUP BY ALL""",
    "collection_merge": f"""WITH {HOLDINGS_SQL} SELECT owner, card_id, status, sum(quantity)::BIGINT AS quantity, {_money("sum(quantity * unit_cost) / sum(quantity)")} AS unit_cost, count(*) AS merged,
      string_agg(DISTINCT 'bought ' || strftime(bought_at, '%Y'), '; ' ORDER BY 'bought ' || strftime(bought_at, '%Y')) AS notes FROM holdings GROUP BY owner, card_id, status""",
}
