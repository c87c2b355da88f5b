"""Values of cards from their judged sales, asking context, robust prices, lots and dealer offers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.expr import choose, clamp, half_up, money
from cardloom.operators.quantiles import GATHERED, by_group_size, exact_quantiles, with_quantiles
from cardloom.operators.scoring import fence, judged_groups
from cardloom.session import written

WINDOWS = (7, 30, 90, 180, 365)


def sale_weight() -> Column:
    """Weight of a sale without its age: verification, confidence, kind and quality."""
    confidence = clamp(F.coalesce(F.nullif("confidence", F.lit(0.0)), F.col("match_score") / 100, F.lit(0.5)), 0.1, 1.0)
    quality = F.when(F.col("quality_score") > 0, clamp(F.col("quality_score") / 80, 0.45, 1.2)).otherwise(F.lit(1.0))
    return F.when(F.col("verified"), 1.18).otherwise(0.9) * confidence * F.when(F.col("sale_type") == "auction", 1.04).otherwise(1.0) * quality


def weighted_sums(name: str, inside: Column, weight: str) -> dict[str, Column]:
    """The sums that the weighted mean price of the sales inside is made of."""
    return {f"_{name}_sum": F.sum(F.when(inside, F.col("all_in") * F.col(weight))), f"_{name}_weight": F.sum(F.when(inside, F.col(weight)))}


def weighted(name: str) -> Column:
    """Weighted mean price from weighted_sums."""
    return money(F.col(f"_{name}_sum") / F.col(f"_{name}_weight"))


def within(days: int) -> Column:
    return F.col("valid") & (F.col("age_days") <= days)


def window_aggregates(days: int) -> dict[str, Column]:
    """Count, ends, mean and weighted sums of the sales of the last days."""
    price, name = F.when(within(days), F.col("all_in")), f"d{days}"
    return {f"{name}_count": F.count(price), f"_{name}_low": F.min(price), f"_{name}_average": F.avg(price), f"_{name}_high": F.max(price)} | weighted_sums(name, within(days), "w_aged")


def window_columns(days: int) -> list[Column]:
    """The figures of a window in order, its quartiles from exact_quantiles among them."""
    name = f"d{days}"
    quartile = lambda q, n: money(f"_d{days}_{q}").alias(f"{name}_{n}")
    figure = lambda n: money(f"_{name}_{n}").alias(f"{name}_{n}")
    return [F.col(f"{name}_count"), figure("low"), quartile("p25", "p25"), quartile("p50", "median"), figure("average"), quartile("p75", "p75"), figure("high"), weighted(name).alias(f"{name}_weighted")]


def change_pct(now: Column, before: Column) -> Column:
    return F.when((now != 0) & (before != 0), money((now - before) / before * 100))


def grouped_with_quantiles(rows: DataFrame, by: list[str], value: str, subsets: dict[str, Column], probs: dict[str, float], figures: dict[str, Column], order: list[str], whole: bool) -> DataFrame:
    """One row for each group with its figures (plain aggregates by name) and s_q, the quantiles of the subsets.

    Whole groups lie together, sorted by group; their figures are windows over them, of which the first row by order (any that puts rows of a group in a row) stays. So no
    group is hashed, and where rows were sorted by group and order before, they are not sorted anew.
    """
    if not whole:
        return with_quantiles(rows.groupBy(*by).agg(*[c.alias(n) for n, c in figures.items()]), by, exact_quantiles(rows, by, value, subsets, probs)).drop(*[f"{s}_n" for s in subsets])
    places, together = F.array(*map(F.lit, probs.values())), Window.partitionBy(*by)
    figures = figures | {f"_of_{s}": F.percentile(F.when(c, F.col(value).cast("double")), places) for s, c in subsets.items()}
    turned = rows.withColumn("_turn", F.row_number().over(together.orderBy(*order)))
    out = turned.select(*by, "_turn", *[c.over(together).alias(n) for n, c in figures.items()]).filter("_turn = 1").drop("_turn")
    return out.select("*", *[F.get(f"_of_{s}", F.lit(at)).alias(f"{s}_{q}") for s in subsets for at, q in enumerate(probs)]).drop(*[f"_of_{s}" for s in subsets])


def value_sales(sales: DataFrame, now: Column, most: int = GATHERED, made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """value_cards of judge_sales; sales meet by card once and are made (see judge_sales), judged and valued there, but for cards of more than most sales."""
    valued = lambda whole: lambda rows: valued_groups(judged_groups(rows, now, whole, made), ["card_id"], whole)
    return by_group_size(sales, ["card_id"], valued(True), valued(False), most)


def value_cards(judged: DataFrame, by: list[str] | None = None, most: int = GATHERED) -> DataFrame:
    """Value, range, windows, trends, liquidity and confidence of each card from its judged sales.

    One aggregation computes every window. Quartiles of groups of more than most rows come from exact_quantiles, so no such group is
    gathered; the earlier periods of the trends are weighted without age. The value is the weighted mean of 30, 90 or 180 days, or the median of all.
    """
    by = by or ["card_id"]
    return by_group_size(judged, by, lambda rows: valued_groups(rows, by, True), lambda rows: valued_groups(rows, by, False), most)


def valued_groups(judged: DataFrame, by: list[str], whole: bool) -> DataFrame:
    """value_cards over groups that are all whole, or all dealt to many tasks."""
    valid = F.col("usable") & (F.col("status") == "included") & F.col("all_in").isNotNull() & (F.col("all_in") >= 0)
    rows = judged.withColumn("valid", valid).withColumn("w_plain", sale_weight()).withColumn("w_aged", F.exp(-F.col("age_days") / 45) * F.col("w_plain"))
    used = ["status", "all_in", "provider", "verified", "is_outlier", "quality_score", "trust_score", "match_score", "valid", "w_plain", "w_aged", "age_days", "sold_at"]
    order = [c for c in ("provider", "raw_id", "seen") if c in rows.columns]  # that of mark_repeats
    rows = rows.select(*by, *dict.fromkeys([*used, *order] if whole else used))
    rows = rows if whole else written(rows)
    price, age, ok = F.when(F.col("valid"), F.col("all_in")), F.col("age_days"), F.col("valid")
    figures = {
        "sales": F.count(F.lit(1)), "included": F.count(price), "excluded": F.count_if(F.col("status").startswith("excluded")), "in_review": F.count_if(F.col("status") == "needs_review"),
        "_providers": F.collect_set(F.when(ok, F.col("provider"))), "outliers": F.count_if(F.col("is_outlier")), "duplicates": F.count_if(F.col("status") == "excluded_duplicate"),
        "verified": F.count_if(ok & F.col("verified")), "_quality": F.avg("quality_score"), "_trust": F.avg("trust_score"), "_match": F.avg("match_score"),
        **{n: c for days in WINDOWS for n, c in window_aggregates(days).items()},
        **weighted_sums("prior30", ok & (age > 30) & (age <= 60), "w_plain"), **weighted_sums("prior90", ok & (age > 90) & (age <= 180), "w_plain"),
        "last_sale_at": F.max(F.when(ok, F.col("sold_at"))), "_last_age": F.min(F.when(ok, age)),
    }
    grouped = grouped_with_quantiles(rows, by, "all_in", {"_all": ok} | {f"_d{d}": within(d) for d in WINDOWS}, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, figures, order, whole)
    mean = lambda c: F.coalesce(half_up(F.col(c)), F.lit(0))
    grouped = grouped.withColumns({"_median": money("_all_p50"), "_spread": F.col("_all_p75") - F.col("_all_p25"), "prior30": weighted("prior30"), "prior90": weighted("prior90")})
    grouped = grouped.withColumns({"providers": F.size("_providers").cast("long"), "avg_quality": mean("_quality"), "avg_trust": mean("_trust"), "avg_match": mean("_match")})
    plain = [*by, "sales", "included", "excluded", "in_review", "providers", "outliers", "duplicates", "verified", "avg_quality", "avg_trust", "avg_match", "prior30", "prior90", "last_sale_at", "_last_age", "_median", "_spread"]
    grouped = grouped.select(*plain, *[c for days in WINDOWS for c in window_columns(days)])
    n, share = F.col("included"), lambda c: F.when(F.col("included") > 0, F.col(c) / (F.col("included") + F.col(c))).otherwise(F.when(F.col(c) > 0, 0.5).otherwise(0.0))
    sure = (
        0.27 * clamp(F.log10(n + 1) / 1.7, 0.0, 1.0) + 0.2 * clamp(F.col("providers") / 4, 0.0, 1.0) + 0.18 * F.when(n > 0, F.col("verified") / n).otherwise(0.0)
        + 0.2 * clamp(F.col("avg_quality") / 100, 0.0, 1.0) + 0.15 * clamp(F.col("avg_trust") / 100, 0.0, 1.0) - 0.22 * share("outliers") - 0.12 * share("duplicates")
    )
    out = grouped.withColumns(
        {
            "confidence": half_up(clamp(sure * 100, 4.0, 99.0)),
            "value": F.coalesce("d30_weighted", "d90_weighted", "d180_weighted", "_median"),
            "trend30": change_pct(F.col("d30_weighted"), F.col("prior30")),
            "trend90": change_pct(F.col("d90_weighted"), F.col("prior90")),
            "liquidity": half_up(clamp(F.log10(F.col("d90_count") / 3 + 1) / 1.5 * 70 + F.col("providers") / 4 * 30, 0.0, 100.0)),
            "velocity": money(F.col("d90_count") / 3),
            "freshness_hours": money(F.col("_last_age") * 24),
        }
    )
    wide = F.when(F.col("confidence") >= 80, 0.08).when(F.col("confidence") >= 60, 0.14).otherwise(0.24)
    padding = F.greatest(F.col("value") * wide, F.when(n >= 2, F.col("_spread") / 2).otherwise(0.0))
    direction = choose([(F.col("trend30").isNull(), "insufficient_data"), (F.col("trend30") > 3, "rising"), (F.col("trend30") < -3, "falling")], "steady")
    return out.withColumns(
        {"range_low": money(F.greatest(F.lit(0.0), F.col("value") - padding)), "range_high": money(F.col("value") + padding), "direction": direction, "volume90": F.col("d90_count")}
    ).drop("_median", "_spread", "_last_age", "prior30", "prior90")


def asks_of_cards(asks: DataFrame, whole: bool) -> DataFrame:
    """A robust summary of each card's active fixed-price listings, over cards that are all whole, or all dealt to many tasks."""
    turn = F.row_number().over(Window.partitionBy("card_id", "provider", "item", "ask").orderBy("seen"))
    kept = asks.repartition("card_id").withColumn("_first", turn == 1).withColumn("usable", F.col("_first") & F.col("fixed_price") & F.col("ask").isNotNull())
    kept = kept.withColumn("status", F.lit("included")).withColumn("reasons", F.array().cast("array<string>"))
    order = ["provider", "item", "ask", "seen"]
    trimmed = fence(kept, ["card_id"], "ask", whole).select("card_id", "usable", *(order if whole else ["ask", "provider"]))
    trimmed = trimmed if whole else written(trimmed)
    ask = F.when(F.col("usable"), F.col("ask"))
    figures = {"asks": F.count(ask), "rejected": F.count_if(~F.col("usable")), "_sources": F.collect_set(F.when(F.col("usable"), F.col("provider"))), "_low": F.min(ask), "_high": F.max(ask)}
    grouped = grouped_with_quantiles(trimmed, ["card_id"], "ask", {"_u": F.col("usable")}, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, figures, order, whole)
    cents = lambda c, name: money(c).alias(name)
    return grouped.select("card_id", "asks", "rejected", F.size("_sources").cast("long").alias("sources"), cents("_low", "low"), cents("_u_p25", "p25"), cents("_u_p50", "median_ask"), cents("_u_p75", "p75"), cents("_high", "high"))


def asking_context(asks: DataFrame, values: DataFrame, most: int = GATHERED) -> DataFrame:
    """A robust summary of each card's active fixed-price listings, beside the value of its sales."""
    grouped = by_group_size(asks, ["card_id"], lambda rows: asks_of_cards(rows, True), lambda rows: asks_of_cards(rows, False), most)
    joined = grouped.join(values.select("card_id", "value", "confidence", "volume90"), "card_id", "left")
    m, v, n = F.col("median_ask"), F.col("value"), F.col("asks")
    gap = (m - v) / v * 100
    compared = (m != 0) & (v != 0)
    out = joined.withColumn("spread_pct", F.when(m != 0, money((F.col("p75") - F.col("p25")) / m * 100))).withColumn("ask_vs_value_pct", F.when(compared, money(gap)))
    out = out.withColumn(
        "alignment",
        choose(
            [(~F.coalesce(compared, F.lit(False)), "context_only"), (gap > 45, "asks_far_above_sales"), (gap > 18, "asks_above_sales"), (gap < -35, "asks_far_below_sales"), (gap < -15, "asks_below_sales")],
            "aligned_with_sales",
        ),
    )
    far, spread = F.col("alignment").contains("far"), F.col("spread_pct")
    fit = F.when(~F.coalesce(v != 0, F.lit(False)), 0.55).when(F.col("alignment") == "aligned_with_sales", 1.0).when(far, 0.32).otherwise(0.68)
    score = clamp(F.log10(n + 1) / 1.15, 0.0, 1.0) * 0.4 + F.coalesce(clamp(1 - spread / 110, 0.0, 1.0), F.lit(0.0)) * 0.35 + fit * 0.25
    rating = choose(
        [(n == 0, "unavailable"), (n < 3, "thin_context"), (F.coalesce(spread > 80, F.lit(False)), "noisy_asks"), (F.coalesce(v != 0, F.lit(False)) & far, "market_disagreement"), (F.coalesce((n >= 8) & (spread <= 35), F.lit(False)), "strong_pricing_context")],
        "useful_pricing_context",
    )
    out = out.withColumn("context_score", half_up(clamp(score * 100, F.when(n > 0, 12.0).otherwise(0.0), 96.0))).withColumn("rating", rating)
    blended = F.when(compared, money(v * 0.7 + m * 0.3)).when(m.isNotNull(), money(F.coalesce(F.nullif("p25", F.lit(0.0)), m) * 0.98))
    sure = F.when(F.col("confidence") > 0, half_up(clamp(F.col("confidence") + (F.col("context_score") - 60) * 0.18, 4.0, 99.0)))
    sure = sure.when(n > 0, half_up(clamp(F.col("context_score") * 0.72, 8.0, 68.0))).otherwise(F.lit(0))
    return out.withColumn("list_anchor", blended).withColumn("pricing_confidence", sure).drop("confidence", "volume90")


def fair_prices(rows: DataFrame, by: str, whole: bool) -> DataFrame:
    """Counts and quartiles of prices without outliers, over groups that are all whole, or all dealt to many tasks."""
    trimmed = fence(rows.repartition(by), [by], "price", whole, least=4, floor_zero=False).select(by, "usable", "is_outlier", "price")
    trimmed = trimmed if whole else written(trimmed)
    figures = {"comps": F.count(F.when(F.col("usable"), F.col("price"))), "removed": F.count_if(F.col("is_outlier"))}
    grouped = grouped_with_quantiles(trimmed, [by], "price", {"_u": F.col("usable")}, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, figures, ["price"], whole)
    return grouped.withColumnsRenamed({"_u_p25": "_low", "_u_p50": "_mid", "_u_p75": "_high"})


def robust_prices(prices: DataFrame, by: str, price: str, least: int = 3, most: int = GATHERED) -> DataFrame:
    """Quartile prices, offers and confidence from positive prices without outliers, in decimals."""
    amount = money(price).cast("decimal(14,2)")
    rows = prices.select(by, amount.alias("price")).filter("price > 0").withColumn("usable", F.lit(True)).withColumn("status", F.lit("included")).withColumn("reasons", F.array().cast("array<string>"))
    grouped = by_group_size(rows, [by], lambda some: fair_prices(some, by, True), lambda some: fair_prices(some, by, False), most)
    enough = F.col("comps") >= least
    spread = F.when(F.col("_mid") > 0, (F.col("_high") - F.col("_low")) / F.col("_mid")).otherwise(F.lit(1.0))
    sure = 0.65 * F.least(F.col("comps") / 12, F.lit(1.0)) + 0.35 * (1 - F.least(spread, F.lit(1.0)))
    value = lambda c: F.when(enough, money(c + F.lit(1e-7)))  # noqa: E731  quartiles of cents lie on rounding ties
    return grouped.select(
        by, "comps", "removed", F.when(enough, "priced").otherwise("insufficient_comps").alias("status"),
        value(F.col("_low")).alias("value_low"), value(F.col("_mid")).alias("value_mid"), value(F.col("_high")).alias("value_high"),
        value(F.col("_mid") * 0.60).alias("cash_low"), value(F.col("_mid") * 0.75).alias("cash_high"), value(F.col("_mid") * 1.10).alias("list_price"),
        F.when(enough, F.floor(sure * 10000 + 0.5) / 10000).otherwise(F.lit(0.0)).alias("confidence"),
    )


def lot_economics(items: DataFrame, lot: str, fee_rate: float = 0.1325, fee_each: float = 0.30, target_roi: float = 0.25) -> DataFrame:
    """What a lot of items (lot, low, mid, high, sure, asked) brings after fees, and whether to buy it at its asked price.

    Items without a positive middle value are not priced; a missing low or high is the middle.
    """
    priced = F.col("mid") > 0
    total = lambda c: money(F.sum(F.when(priced, F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.col("mid")))))
    grouped = items.groupBy(lot).agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("sure") >= 0.70).alias("identified"), F.count_if(priced).alias("priced"),
        total("low").alias("conservative"), total("mid").alias("expected"), total("high").alias("optimistic"), money(F.max("asked")).alias("cost"),
    )
    out = grouped.withColumn("fees", money(F.col("expected") * fee_rate + F.col("priced") * F.lit(fee_each)))
    out = out.withColumn("net", money(F.col("expected") - F.col("fees")))
    out = out.withColumn("profit", money(F.col("net") - F.col("cost")))
    roi = F.when(F.col("cost") > 0, F.floor(F.col("profit") / F.col("cost") * 10000 + 0.5) / 10000)
    profit = F.col("profit")
    decision = choose([(F.col("priced") == 0, "NEEDS PRICING"), ((profit > 0) & (F.coalesce(roi, F.lit(0.0)) >= target_roi), "BUY TARGET"), (profit > 0, "MARGIN TOO THIN")], "PASS AT CURRENT PRICE")
    status = choose([(F.col("priced") == 0, "unpriced"), (F.col("priced") / F.col("items") >= 0.9, "priced")], "partially_priced")
    most = F.when(F.col("priced") > 0, money(F.greatest(F.lit(0.0), F.col("net") / (1 + target_roi))))
    return out.withColumns({"roi": roi, "max_purchase": most, "decision": decision, "pricing_status": status})


def dealer_offers(values: DataFrame, margin: float = 0.35, quick: float = 0.10, patient: float = 0.15) -> DataFrame:
    """Buying range and three selling prices for each valued card, with the action they suggest."""
    v, sure, liquid = F.nullif("value", F.lit(0.0)), F.col("confidence"), F.col("liquidity")
    low, high = money(v * round(min(max(1 - margin - 0.08, 0.35), 0.95), 6)), money(v * round(min(max(1 - margin + 0.04, 0.45), 0.98), 6))
    action = choose([(v.isNull(), "research"), ((sure >= 75) & (liquid >= 60), "buy_or_list"), (liquid < 40, "consign")], "buy_low")
    return values.select(
        "card_id", low.alias("buy_low"), high.alias("buy_high"), money(v * (1 - quick)).alias("quick_price"), money(v * 1.05).alias("fair_price"), money(v * (1 + patient)).alias("patient_price"),
        action.alias("action"), (v.isNotNull() & (sure < 65)).alias("consignment_review"),
    )
