"""Scores for completed sales, and which of them may carry a value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.expr import choose, clamp, days_before, half_up, listed
from cardloom.operators.quantiles import GATHERED, by_group_size, exact_quantiles, with_quantiles
from cardloom.session import written

#: Trust in a source by its authorization; the last two depend on verification.
TRUST = {"official_api": 96, "ebay_api": 96, "written_license": 92, "commercial_partner": 88, "user_authorized_export": 80}
APPROVED = [*TRUST, "user_csv"]
#: Statuses that no review can lift.
HARD = ["excluded_active_listing", "excluded_missing_price", "excluded_missing_sale_date", "excluded_future_sale", "excluded_data_rights"]


def trust_score(basis: Column, verified: Column) -> Column:
    known = [(basis == name, score) for name, score in TRUST.items()]
    return choose([*known, (basis == "user_csv", F.when(verified, 76).otherwise(68))], F.when(verified, 60).otherwise(28))


def freshness_score(age: Column) -> Column:
    return F.coalesce(half_up(clamp(100 * F.exp(-age / 180), 8.0, 100.0)), F.lit(0))


def price_reliability(price: Column, shipping: Column, premium: Column, sale_type: Column) -> Column:
    """72, and points for known shipping and premium and by kind of sale; 0 without a price."""
    points = F.lit(72) + F.when(shipping.isNotNull(), 8).otherwise(0) + F.when(premium.isNotNull(), 6).otherwise(0)
    points = points + F.when(sale_type == "auction", 6).when(sale_type == "private", -8).otherwise(0)
    return F.when(price.isNull() | (price < 0), 0).otherwise(clamp(points, 0, 100)).cast("long")


def completeness(texts: list[Column], others: list[Column], shipping: Column, premium: Column, slots: int = 14) -> Column:
    """Share of filled fields among slots, in points, with two for each known extra cost; texts of blanks are not filled, others are unless null."""
    filled = sum((F.when(f.isNotNull() & (F.trim(f) != ""), 1).otherwise(0) for f in texts), F.lit(0)) + sum((F.when(f.isNotNull(), 1).otherwise(0) for f in others), F.lit(0))
    extra = F.when(shipping.isNotNull(), 2).otherwise(0) + F.when(premium.isNotNull(), 2).otherwise(0)
    return clamp(half_up(filled / slots * 100) + extra, 0, 100).cast("long")


def score_sales(sales: DataFrame, now: Column, reviews: DataFrame | None = None) -> DataFrame:
    """The sales with scores, status, usable and reasons; each row by itself.

    The first exclusion that holds names the status; a review status only replaces included. reviews
    (sale_id, decision), joined on raw_id, can reject any sale or approve one that is not excluded
    for good. A missing number counts as absent, not as zero.
    """
    out = with_scores(with_status(sales, now))
    return out if reviews is None else apply_reviews(out, reviews)


def with_status(sales: DataFrame, now: Column) -> DataFrame:
    """The sales with age, match and trust, and the status, usable and reasons that follow from these."""
    age = days_before("sold_at", now)
    has_date, price = F.col("sold_at").isNotNull(), F.col("all_in")
    match = half_up(clamp(F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.7)) * 100, 1.0, 100.0))
    scored = sales.withColumns({"age_days": age, "match_score": match, "trust_score": trust_score(F.col("basis"), F.col("verified")).cast("long")})
    refused = [
        (price.isNull() | (price < 0), "excluded_missing_price"),
        (~has_date, "excluded_missing_sale_date"),
        (F.col("sold_at") > now, "excluded_future_sale"),
        (~F.coalesce("completed", has_date), "excluded_active_listing"),
        (~F.coalesce(F.col("basis").isin(APPROVED), F.lit(False)), "excluded_unverified_source"),
    ]
    doubtful = [(F.col("trust_score") < 45, "needs_review"), (F.col("match_score") < 68, "needs_review")]
    out = scored.withColumn("status", choose([*refused, *doubtful], "included")).withColumn("usable", F.col("status") == "included")
    excluded = F.col("status").startswith("excluded")
    reasons = listed(*refused, (~excluded & (F.col("trust_score") < 45), "low_trust"), (~excluded & (F.col("match_score") < 68), "low_match"))
    return out.withColumn("reasons", reasons)


def with_scores(rows: DataFrame) -> DataFrame:
    """Rows of with_status with the scores that no status needs."""
    texts, others = [F.col(c) for c in ("provider", "raw_id", "basis")], [F.col(c) for c in ("sold_at", "all_in", "card_id")]
    scored = rows.withColumns(
        {
            "freshness_score": F.when(F.col("sold_at").isNotNull(), freshness_score(F.col("age_days"))).otherwise(0).cast("long"),
            "reliability_score": price_reliability(F.col("all_in"), F.col("shipping"), F.col("premium"), F.col("sale_type")),
            # production is the mode of every sale here
            "completeness_score": completeness([*texts, F.lit("production")], others, F.col("shipping"), F.col("premium")),
        }
    )
    quality = F.col("match_score") * 0.30 + F.col("trust_score") * 0.25 + F.col("freshness_score") * 0.16 + F.col("reliability_score") * 0.18 + F.col("completeness_score") * 0.11
    sure = F.col("match_score") * 0.42 + F.col("trust_score") * 0.26 + F.col("reliability_score") * 0.18 + F.col("completeness_score") * 0.14
    return scored.withColumns({"quality_score": half_up(clamp(quality, 0.0, 100.0)), "confidence_score": half_up(clamp(sure, 0.0, 100.0))})


def apply_reviews(scored: DataFrame, reviews: DataFrame) -> DataFrame:
    """Rejections always hold; approvals lift every status that is not final."""
    joined = scored.join(reviews.select(F.col("sale_id").alias("raw_id"), "decision"), "raw_id", "left")
    rejected, approved = F.col("decision") == "rejected", (F.col("decision") == "approved") & ~F.col("status").isin(HARD)
    status = F.when(rejected, "excluded_wrong_card").when(approved, "included").otherwise(F.col("status"))
    return joined.withColumn("status", status).withColumn("usable", F.when(rejected, False).when(approved, True).otherwise(F.col("usable"))).drop("decision")


def mark_repeats(scored: DataFrame, keys: list[str], order: str = "seen") -> DataFrame:
    """The first row of a key in order stays; later ones are duplicates, also of an excluded first."""
    return without_repeats(with_repeats(scored, keys, order))


def with_repeats(rows: DataFrame, keys: list[str], order: str = "seen") -> DataFrame:
    """rows with is_repeat: whether a row with the same keys comes before in order."""
    return rows.withColumn("is_repeat", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) > 1)


def without_repeats(marked: DataFrame) -> DataFrame:
    """Rows with a status and is_repeat; repeats are not usable."""
    repeat = F.col("is_repeat")
    return marked.withColumns(
        {
            "status": F.when(repeat & (F.col("status") == "included"), "excluded_duplicate").otherwise(F.col("status")),
            "usable": F.col("usable") & ~repeat,
            "reasons": F.when(repeat, F.array_append("reasons", F.lit("excluded_duplicate"))).otherwise(F.col("reasons")),
        }
    )


def with_fences(scored: DataFrame, group: list[str], value: str, whole: bool) -> DataFrame:
    """scored with _n, _q1 and _q3: count and quartiles of the usable values of the group.

    Whole groups are windows over rows that lie together. Else the rows are written once, as they are read for the quartiles and again beside them.
    """
    if whole:
        usable, together = F.when(F.col("usable"), F.col(value).cast("double")), Window.partitionBy(*group)
        out = scored.withColumns({"_n": F.count(usable).over(together), "_q": F.percentile(usable, F.array(F.lit(0.25), F.lit(0.75))).over(together)})
        return out.withColumns({"_q1": F.get("_q", F.lit(0)), "_q3": F.get("_q", F.lit(1))}).drop("_q")
    scored = written(scored)
    quartiles = exact_quantiles(scored, group, value, {"_u": F.col("usable")}, {"q1": 0.25, "q3": 0.75})
    return with_quantiles(scored, group, quartiles).withColumnsRenamed({"_u_q1": "_q1", "_u_q3": "_q3", "_u_n": "_n"})


def fence(scored: DataFrame, group: list[str], value: str, whole: bool, least: int = 5, floor_zero: bool = True) -> DataFrame:
    """Rows outside the fences of their group become outliers; whole as in with_fences."""
    marked = with_fences(scored, group, value, whole)
    spread = F.col("_q3") - F.col("_q1")
    low = F.col("_q1") - 1.5 * spread
    low = F.greatest(F.lit(0.0), low) if floor_zero else low
    outside = F.coalesce(F.col("usable") & (F.col("_n") >= least) & ((F.col(value) < low) | (F.col(value) > F.col("_q3") + 1.5 * spread)), F.lit(False))
    return marked.withColumn("is_outlier", outside).drop("_q1", "_q3", "_n").withColumns(
        {
            "status": F.when(F.col("is_outlier") & (F.col("status") == "included"), "excluded_outlier").otherwise(F.col("status")),
            "usable": F.col("usable") & ~F.col("is_outlier"),
            "reasons": F.when(F.col("is_outlier"), F.array_append("reasons", F.lit("excluded_outlier"))).otherwise(F.col("reasons")),
        }
    )


def mark_outliers(scored: DataFrame, group: list[str], value: str = "all_in", least: int = 5, floor_zero: bool = True, most: int = GATHERED) -> DataFrame:
    """Rows outside 1.5 interquartile ranges of the usable values of their group, if it has least of them.

    Groups of more than most rows are dealt to many tasks.
    """
    return by_group_size(scored, group, lambda rows: fence(rows, group, value, True, least, floor_zero), lambda rows: fence(rows, group, value, False, least, floor_zero), most)


def judged_groups(sales: DataFrame, now: Column, whole: bool, made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """judge_sales over groups that are all whole, or all dealt to many tasks.

    Sales are made after the shuffle, as they are wider than what they are made of. Each window gets only what it needs: all scores in one step before the first
    window are a method too long to be compiled by the JVM.
    """
    dealt = sales.repartition("card_id")
    marked = with_repeats(made(dealt) if made else dealt, ["card_id", "provider", "raw_id"])
    return with_scores(fence(without_repeats(with_status(marked, now)), ["card_id"], "all_in", whole))


def judge_sales(sales: DataFrame, now: Column, most: int = GATHERED, made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Scores, repeats and outliers of each card's sales, in one shuffle by card; cards of more than most sales are dealt to many tasks for their quartiles.

    sales may be rows with card_id that made turns into sales, row by row; then only what these hold is shuffled.
    """
    return by_group_size(sales, ["card_id"], lambda rows: judged_groups(rows, now, True, made), lambda rows: judged_groups(rows, now, False, made), most)
