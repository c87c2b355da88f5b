"""Holdings with their market value: allocation, returns, tax, scenarios, inventory, trends and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.expr import choose, clamp, days_before, half_up, money

MARKET = ["value", "trend30", "trend90", "liquidity", "confidence", "included", "freshness_hours", "volume90", "avg_quality", "avg_trust", "avg_match", "providers", "in_review", "outliers", "duplicates", "range_low", "range_high", "velocity", "direction", "d7_weighted", "d30_weighted"]


def grade_tier(grader: Column, grade: Column) -> Column:
    raw = grader.isNull() | (F.trim(grader) == "") | (F.upper(grader) == "RAW")
    name = F.upper(grader)
    return choose([(raw, "Raw"), (grade >= 10, F.concat(name, F.lit(" Gem Mint 10"))), (grade >= 9, F.concat(name, F.lit(" Mint 9"))), (grade >= 8, F.concat(name, F.lit(" NM-MT 8")))], F.concat(name, F.lit(" Graded <8")))


def enrich(holdings: DataFrame, values: DataFrame, cards: DataFrame, now: Column) -> DataFrame:
    """Holdings with card and market columns, current value, gain and liquid value; unmatched ones have value 0."""
    market = values.select("card_id", *MARKET)
    out = holdings.join(market, "card_id", "left").join(cards, "card_id", "left")
    unit = money(F.coalesce("value", F.lit(0.0)))
    out = out.withColumns({"unit_value": unit, "cost_basis": money(money("unit_cost") * F.col("quantity"))})
    out = out.withColumn("current_value", money(F.col("unit_value") * F.col("quantity")))
    out = out.withColumn("gain", money(F.col("current_value") - F.col("cost_basis")))
    sold = F.col("status") == "sold"
    liquidity = F.coalesce("liquidity", F.lit(28))
    return out.withColumns(
        {
            "gain_pct": F.when(F.col("cost_basis") > 0, money(F.col("gain") / F.col("cost_basis") * 100)),
            "realized": F.when(sold, money(money("sold_price") * F.col("quantity") - F.col("cost_basis"))).otherwise(F.lit(0.0)),
            "unrealized": F.when(sold, 0.0).otherwise(F.col("gain")),
            "liquidity": liquidity,
            "liquid_value": money(F.col("current_value") * clamp(liquidity / 100, 0.15, 0.98)),
            "age_days": F.floor(days_before("bought_at", now)),
            "value_confidence": F.coalesce("confidence", F.lit(0)),
            "tier": grade_tier(F.col("grader"), F.col("grade")),
            "set_label": F.concat_ws(" ", F.col("year").cast("string"), "brand", "set_name"),
        }
    )


def allocation(held: DataFrame) -> DataFrame:
    """Unsold value by sport, player, set, year and grade tier with shares, in one pass over grouping sets."""
    rows = held.filter("status <> 'sold'").select(
        F.inline(F.array(*[F.struct(F.lit(name).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias("label")) for name, c in (("sport", "sport"), ("player", "player"), ("set", "set_label"), ("year", "year"), ("tier", "tier"))])),
        "quantity", "current_value", "cost_basis", "gain", "liquid_value", "value_confidence",
    )
    grouped = rows.groupBy("dimension", "label").agg(
        F.count(F.lit(1)).alias("items"), F.sum("quantity").alias("quantity"), F.sum("current_value").alias("_value"), F.sum("cost_basis").alias("_cost"), F.sum("gain").alias("_gain"),
        F.sum("liquid_value").alias("_liquid"), half_up(F.avg("value_confidence")).alias("avg_confidence"),
    )
    total = F.sum("_value").over(Window.partitionBy("dimension"))
    return grouped.select(
        "dimension", "label", "items", "quantity", money("_value").alias("value"), money("_cost").alias("cost_basis"), money("_gain").alias("gain"),
        F.when(F.col("_cost") > 0, money(F.col("_gain") / F.col("_cost") * 100)).alias("gain_pct"), F.when(total > 0, money(F.col("_value") / total * 100)).otherwise(0.0).alias("pct_of_value"),
        money("_liquid").alias("liquid_value"), "avg_confidence",
    )


def portfolio_metrics(held: DataFrame, by: str = "owner") -> DataFrame:
    """Totals, returns, averages and counters of each owner, once for all owners."""
    active = F.col("status") != "sold"
    total = lambda c, when=active: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0.0))
    mean = lambda c: F.coalesce(half_up(F.avg(F.when(active, F.col(c)))), F.lit(0))
    g = held.groupBy(by).agg(
        F.count_if(active).alias("items"), F.coalesce(F.sum(F.when(active, F.col("quantity"))), F.lit(0)).alias("quantity"), total("current_value").alias("_value"), total("cost_basis").alias("_cost"),
        F.coalesce(F.sum("cost_basis"), F.lit(0.0)).alias("_all_cost"), total("liquid_value").alias("_liquid"), total("unrealized").alias("_unrealized"), total("realized", ~active).alias("_realized"),
        mean("value_confidence").alias("avg_confidence"), mean("liquidity").alias("avg_liquidity"), mean("avg_quality").alias("avg_comp_quality"),
        F.count_if(active & ((F.col("value_confidence") < 55) | (F.coalesce("included", F.lit(0)) < 2))).alias("low_confidence"),
        F.count_if(active & (F.coalesce("freshness_hours", F.lit(1e12)) > 720)).alias("stale_values"),
    )
    pct = lambda part, whole: F.when(F.col(whole) > 0, money(F.col(part) / F.col(whole) * 100))
    g = g.withColumn("_total", F.col("_realized") + F.col("_unrealized")).withColumn("_discount", F.col("_value") - F.col("_liquid"))
    return g.select(
        by, "items", "quantity", money("_value").alias("current_value"), money("_cost").alias("cost_basis"), money("_unrealized").alias("unrealized_gain"), pct("_unrealized", "_cost").alias("unrealized_pct"),
        money("_realized").alias("realized_gain"), money("_total").alias("total_gain"), pct("_total", "_all_cost").alias("total_roi_pct"), money("_liquid").alias("liquid_value"),
        F.coalesce(pct("_discount", "_value"), F.lit(0.0)).alias("liquidity_discount"), "avg_confidence", "avg_liquidity", "avg_comp_quality", "low_confidence", "stale_values",
    )


def tax_estimate(held: DataFrame, now: Column, by: str = "owner", short_rate: float = 0.24, long_rate: float = 0.15) -> DataFrame:
    """Gains of each owner by holding period, and the tax on what is sold and on all of it."""
    long_term, sold = F.coalesce(days_before("bought_at", now) >= 365, F.lit(False)), F.col("status") == "sold"
    part = lambda when, c, name: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0.0)).alias(name)
    g = held.groupBy(by).agg(part(sold & ~long_term, "realized", "_rs"), part(sold & long_term, "realized", "_rl"), part(~sold & ~long_term, "unrealized", "_us"), part(~sold & long_term, "unrealized", "_ul"))
    above = lambda c: F.greatest(F.lit(0.0), F.col(c))
    due = lambda c: money(c + F.lit(1e-7))  # noqa: E731  rates on sums of cents lie on rounding ties
    now_due = above("_rs") * short_rate + above("_rl") * long_rate
    return g.select(
        by, money("_rs").alias("realized_short"), money("_rl").alias("realized_long"), money("_us").alias("unrealized_short"), money("_ul").alias("unrealized_long"),
        due(now_due).alias("tax_realized"), due(now_due + above("_us") * short_rate + above("_ul") * long_rate).alias("tax_if_sold"),
    )


def scenario(held: DataFrame, selected: Column, move_pct: float, sell_fee: float = 0.13, by: str = "owner") -> DataFrame:
    """What selling the selected holdings brings each owner, and what a market move does to all."""
    rows = held.filter("status <> 'sold'").withColumn("_in", selected)
    total = lambda c, when=F.lit(True): F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0.0))
    g = rows.groupBy(by).agg(total("current_value").alias("_value"), total("current_value", F.col("_in")).alias("_sold"), total("cost_basis", F.col("_in")).alias("_cost"), F.count_if("_in").alias("selected"))
    tie = lambda c: money(c + F.lit(1e-7))  # noqa: E731  fees on sums of cents lie on rounding ties
    brings, moved = F.col("_sold") * (1 - sell_fee), F.col("_value") * (1 + move_pct / 100)
    return g.select(
        by, "selected", money("_value").alias("current_value"), money("_sold").alias("selected_value"), tie(brings).alias("proceeds"), tie(brings - F.col("_cost")).alias("gain_if_sold"),
        tie(moved).alias("value_after_move"), tie(moved - F.col("_value")).alias("change"), money(F.col("_value") - F.col("_sold")).alias("remaining"),
    )


def inventory_health(held: DataFrame, sales: DataFrame, now: Column) -> DataFrame:
    """For each card held: quantity, sales in 90 days, velocity, days of supply, reorder point and low stock."""
    stock = held.filter("status <> 'sold'").groupBy("card_id").agg(F.sum("quantity").alias("quantity"), money(F.sum("current_value")).alias("value"), F.count_if((F.col("age_days") >= 120) & (F.col("liquidity") < 55)).alias("aging"))
    recent = sales.filter(days_before("sold_at", now) <= 90).groupBy("card_id").agg(F.count(F.lit(1)).alias("sales90"))
    out = stock.join(recent, "card_id", "left").withColumn("sales90", F.coalesce("sales90", F.lit(0)))
    out = out.withColumn("velocity", money(F.col("sales90") / 3))
    moving = F.col("velocity") > 0
    return out.withColumns(
        {
            "days_of_supply": F.when(moving, half_up(F.col("quantity") / F.col("velocity") * 30)),
            "reorder_point": F.when(moving, F.greatest(F.lit(1), F.ceil(F.col("velocity") * 1.5))),
            "low_stock": (F.col("velocity") >= 1) & (F.col("quantity") <= F.greatest(F.lit(1), F.ceil("velocity"))),
        }
    )


def trends(held: DataFrame, by: str = "owner", unit: str = "month") -> DataFrame:
    """Cost, value and quantity added in each month or year, and their running totals."""
    form = "yyyy-MM" if unit == "month" else "yyyy"
    rows = held.filter("status <> 'sold'").withColumn("period", F.date_format("bought_at", form))
    g = rows.groupBy(by, "period").agg(F.sum("quantity").alias("quantity"), F.sum("cost_basis").alias("_cost"), F.sum("current_value").alias("_value"))
    upto = Window.partitionBy(by).orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cost, value = F.sum("_cost").over(upto), F.sum("_value").over(upto)
    return g.select(by, "period", "quantity", money("_cost").alias("cost_added"), money("_value").alias("value_added"), money(cost).alias("cost_total"), money(value).alias("value_total"), money(value - cost).alias("gain_total"))


def signals(held: DataFrame, by: str = "owner") -> DataFrame:
    """Movement, confidence, liquidity, momentum and the action for each unsold holding.

    A card without trend counts as one of 0 when it has a market, as does the owner's mean trend.
    """
    rows = held.filter("status <> 'sold'")
    matched = F.col("included").isNotNull()
    t30, t90 = F.when(matched, F.coalesce("trend30", F.lit(0.0))), F.when(matched, F.coalesce("trend90", F.lit(0.0)))
    short = F.when((F.col("d7_weighted") != 0) & (F.col("d30_weighted") != 0), money((F.col("d7_weighted") - F.col("d30_weighted")) / F.col("d30_weighted") * 100))
    zero = lambda c, d=0: F.coalesce(F.col(c), F.lit(d))
    base, n = zero("confidence"), zero("included")
    fresh = F.coalesce(clamp(100 - F.col("freshness_hours") / 24, 0.0, 100.0), F.lit(0.0))
    penalty = clamp(zero("in_review") * 5 + zero("outliers") * 2 + zero("duplicates"), 0, 24)
    sure = (
        0.34 * base + 0.18 * F.coalesce("avg_quality", base) + 0.16 * F.coalesce("avg_trust", base) + 0.12 * F.coalesce("avg_match", base) + 0.1 * (clamp(zero("providers") / 4, 0.0, 1.0) * 100)
        + 0.07 * (clamp(F.log10(n + 1) / 1.45, 0.0, 1.0) * 100) + 0.03 * fresh - penalty
    )
    # what one row tells comes before rows meet by owner, so that fewer columns are shuffled
    rows = rows.withColumns({"t30": t30, "t90": t90, "short": short, "sureness": half_up(clamp(sure, 0.0, 99.0)), "comps": n})
    rows = rows.withColumn("mean30", money(F.avg("t30").over(Window.partitionBy(by))))
    rows = rows.withColumn("relative", money(F.col("t30") - F.col("mean30")))
    n = F.col("comps")
    part = lambda c, shift, span, none: F.coalesce(clamp((F.col(c) + shift) / span, 0.0, 1.0) * 100, F.lit(none))
    speed = 0.42 * part("t30", 24, 48, 0.0) + 0.28 * part("t90", 30, 60, 0.0) + 0.2 * part("relative", 20, 40, 50.0) + 0.1 * part("short", 18, 36, 50.0)
    rows = rows.withColumn("momentum", half_up(clamp(speed, 0.0, 100.0)))
    s, liquid, move = F.col("sureness"), F.col("liquidity"), F.col("momentum")
    none = lambda c: F.coalesce(c, F.lit(False))
    falling, profit = none(F.col("t30") <= -8), none(F.col("gain_pct") >= 35) & (liquid >= 55)
    weak = none(F.col("relative") <= -12) & (zero("t90", 0.0) <= 0)
    rising, ahead = none(F.col("t30") >= 8) & none(F.col("t90").isNull() | (F.col("t90") >= 3)), none(F.col("relative") >= 6)
    thin = none(F.col("value").isNull() | (F.col("value") == 0)) | (n < 2) | (s < 45)
    sell = (liquid >= 55) & (s >= 64) & (falling | profit | weak)
    buy = (s >= 70) & (liquid >= 55) & (rising | ahead) & (n >= 3)
    action = choose([(thin | (s < 58), "wait"), (sell, "sell_now"), (buy, "buy_more"), (liquid < 35, "wait")], "hold")
    conviction = choose(
        [(thin, F.greatest(F.lit(20).cast("long"), half_up(s / 2))), (s < 58, s), (sell, half_up(clamp((s + liquid + F.when(falling, 75).otherwise(55)) / 3, 0.0, 100.0))), (buy, half_up(clamp((s + liquid + move) / 3, 0.0, 100.0))), (liquid < 35, F.greatest(F.lit(35).cast("long"), half_up(s * 0.7)))],
        half_up(clamp((s + liquid + move) / 3, 0.0, 100.0)),
    )
    label = choose([(F.col("t30").isNull() & F.col("t90").isNull(), "insufficient_data"), (move >= 70, "outperforming"), (move >= 48, "steady")], "weakening")
    before = F.when((F.col("value") != 0) & (F.col("t30") > -99), money(F.col("value") / (1 + F.col("t30") / 100)))
    return rows.withColumns({"action": action, "conviction": conviction, "momentum_label": label, "change30": money(F.col("current_value") - before * F.col("quantity"))})


def shop_actions(signalled: DataFrame) -> DataFrame:
    """Whether to review, reprice, list or hold each item, how urgently, and at which price."""
    v, liquid, listed_at = F.col("value"), F.col("liquidity"), F.col("list_price")
    none = lambda c: F.coalesce(c, F.lit(False))
    review = none(v.isNull() | (v == 0)) | (F.col("sureness") < 50) | (F.col("comps") < 2)
    on_list = (F.col("status") == "listed") & listed_at.isNotNull()
    over, under = on_list & none(listed_at > F.col("range_high") * 1.12), on_list & none(listed_at < F.col("range_low") * 0.9) & (liquid >= 55)
    sell = F.col("action") == "sell_now"
    to_list = F.col("status").isin("owned", "hold") & F.col("action").isin("sell_now", "hold") & (liquid >= 55)
    buy = F.col("action") == "buy_more"
    rules = [(review, "review"), (over | under, "reprice"), (to_list, "list")]
    return signalled.withColumns(
        {
            "shop_action": choose(rules, "hold"),
            "priority": choose([(review | over, "high"), (under, "medium"), (to_list, F.when(sell, "high").otherwise("medium")), (buy, "medium")], "low"),
            "suggested": choose([(review, F.lit(None).cast("double")), (over, money(v * 1.05)), (under, money(v * 1.03)), (to_list, money(v * 1.05)), (buy, F.coalesce(listed_at, money(v * 1.12)))], F.coalesce(listed_at, money(v * 1.05))),
        }
    )


def merge_lots(items: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each merge key: quantities add up, cost is the mean by quantity, distinct notes stay in order."""
    return items.groupBy(*keys).agg(
        F.sum("quantity").alias("quantity"), money(F.sum(F.col("quantity") * F.col("unit_cost")) / F.sum("quantity")).alias("unit_cost"), F.count(F.lit(1)).alias("merged"),
        F.array_join(F.array_sort(F.collect_set("note")), "; ").alias("notes"),
    )
