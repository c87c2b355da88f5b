import datetime as dt

from pyspark.sql import functions as F

from cardloom.operators.scoring import apply_reviews, judge_sales, mark_outliers, score_sales
from cardloom.operators.valuation import asking_context, lot_economics, robust_prices, value_cards, value_sales
from cardloom.plans.market import valued

SALE = "card_id bigint, provider string, raw_id string, basis string, sale_type string, completed boolean, sold_at timestamp, price double, shipping double, premium double, verified boolean, confidence double, all_in double, seen struct<n:int>"


def now():
    return F.lit("2024-06-30 00:00:00").cast("timestamp")


def sale(n, price=100.0, days=5, raw=None, basis="official_api", completed=True, confidence=0.95, provider="P1", card=1):
    at = None if days is None else dt.datetime(2024, 6, 30) - dt.timedelta(days=days)
    return (card, provider, raw or f"r{n}", basis, "auction", completed, at, price, 0.0, 0.0, True, confidence, price, (n,))


def table(spark, rows):
    return spark.createDataFrame(rows, SALE)


def test_first_exclusion_names_the_status(spark):
    rows = [sale(1, completed=False, days=None), sale(2, price=None), sale(3, days=-3), sale(4, basis="scraped"), sale(5, confidence=0.5), sale(6)]
    got = {r["raw_id"]: (r["status"], r["usable"]) for r in score_sales(table(spark, rows), now()).collect()}
    assert got == {"r1": ("excluded_missing_sale_date", False), "r2": ("excluded_missing_price", False), "r3": ("excluded_future_sale", False), "r4": ("excluded_unverified_source", False), "r5": ("needs_review", False), "r6": ("included", True)}


def test_an_excluded_first_row_still_claims_its_key(spark):
    rows = [sale(1, raw="same", completed=False), sale(2, raw="same"), sale(3, raw="same", confidence=0.5)]
    got = [(r["seen"]["n"], r["status"], r["usable"]) for r in judge_sales(table(spark, rows), now()).orderBy("seen").collect()]
    assert got == [(1, "excluded_active_listing", False), (2, "excluded_duplicate", False), (3, "needs_review", False)]


def test_outliers_need_five_usable_values(spark):
    four, five = [sale(i, p) for i, p in enumerate([10.0, 11.0, 12.0, 999.0])], [sale(i, p, card=2) for i, p in enumerate([10.0, 11.0, 12.0, 13.0, 999.0])]
    got = judge_sales(table(spark, four + five), now()).filter("is_outlier").collect()
    assert [(r["card_id"], r["all_in"]) for r in got] == [(2, 999.0)]
    again = mark_outliers(score_sales(table(spark, five), now()), ["card_id"])
    assert again.filter("status = 'excluded_outlier'").count() == 1


def test_reviews_lift_only_what_is_not_final(spark):
    rows = score_sales(table(spark, [sale(1, confidence=0.5), sale(2, days=None), sale(3)]), now())
    reviews = spark.createDataFrame([("r1", "approved"), ("r2", "approved"), ("r3", "rejected")], "sale_id string, decision string")
    got = {r["raw_id"]: (r["status"], r["usable"]) for r in apply_reviews(rows, reviews).collect()}
    assert got == {"r1": ("included", True), "r2": ("excluded_missing_sale_date", False), "r3": ("excluded_wrong_card", False)}


def test_values_follow_recent_sales_and_ignore_the_outlier(spark):
    rows = [sale(i, 80.0 + i, days=40 + i) for i in range(5)] + [sale(10 + i, 110.0 + i, days=2 + i, provider=f"P{i % 3}") for i in range(6)] + [sale(99, 5000.0, days=1)]
    v = value_cards(judge_sales(table(spark, rows), now())).first()
    assert v["outliers"] == 1 and 100 < v["value"] < 120 and v["trend30"] > 30 and v["direction"] == "rising" and v["d7_count"] == 6
    assert v["range_low"] < v["value"] < v["range_high"] and 4 <= v["confidence"] <= 99


def test_metamorphic_row_order_does_not_matter(spark):
    rows = [sale(i, 50.0 + i % 7, days=i % 90, raw=f"r{i % 25}") for i in range(60)]
    one, two = (value_cards(judge_sales(table(spark, r).repartition(n), now())).first() for r, n in ((rows, 1), (rows[::-1], 5)))
    assert one == two


def test_asking_context_of_six_listings(spark):
    asks = [(1, "P1", f"i{n}", p, fixed, (n,)) for n, (p, fixed) in enumerate([(110.0, True), (120.0, True), (125.0, True), (130.0, True), (140.0, True), (90.0, False), (110.0, True)])]
    asks[6] = (1, "P1", "i0", 110.0, True, (6,))
    values = spark.createDataFrame([(1, 100.0, 80, 5)], "card_id bigint, value double, confidence bigint, volume90 bigint")
    got = asking_context(spark.createDataFrame(asks, "card_id bigint, provider string, item string, ask double, fixed_price boolean, seen struct<n:int>"), values).first()
    assert (got["asks"], got["rejected"], got["median_ask"], got["alignment"], got["rating"]) == (5, 2, 125.0, "asks_above_sales", "useful_pricing_context")


def test_robust_prices_and_lots(spark):
    prices = spark.createDataFrame([("a", p) for p in (10.0, 11.0, 12.0, 13.0, 500.0, -1.0)] + [("b", 5.0)], "k string, p double")
    got = {r["k"]: r for r in robust_prices(prices, "k", "p").collect()}
    assert (got["a"]["status"], got["a"]["comps"], got["a"]["removed"], got["a"]["value_mid"]) == ("priced", 4, 1, 11.5)
    assert (got["b"]["status"], got["b"]["value_mid"]) == ("insufficient_comps", None)
    items = [("x", 90.0, 100.0, 110.0, 0.9, 60.0), ("x", None, 100.0, None, 0.5, 60.0), ("y", None, None, None, 0.1, 9.0), ("z", 1.0, 10.0, 12.0, 0.9, 50.0)]
    lots = {r["lot"]: r for r in lot_economics(spark.createDataFrame(items, "lot string, low double, mid double, high double, sure double, asked double"), "lot").collect()}
    assert (lots["x"]["decision"], lots["x"]["conservative"], lots["x"]["fees"], lots["x"]["net"]) == ("BUY TARGET", 190.0, 27.1, 172.9)
    assert (lots["y"]["decision"], lots["z"]["decision"]) == ("NEEDS PRICING", "PASS AT CURRENT PRICE")


def some_sales():
    return [sale(n, 50.0 + n * 7 % 31 + (900 if n % 29 == 0 else 0), days=n % 200, raw=f"r{n % 70}", provider=f"P{n % 3}", card=None if n % 11 == 0 else n % 5, completed=n % 13 != 0) for n in range(240)]


def test_sales_are_shuffled_once_and_not_written(spark):
    plan = value_sales(table(spark, some_sales()), now())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange rangepartitioning" not in plan


def test_lines_are_shuffled_before_sales_are_made_of_them(spark):
    plan = valued(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange hashpartitioning")
    assert "concat_ws" in above and "concat_ws" not in below and "HashAggregate" not in plan
    # a sale without blanks in its texts is complete whatever its numbers look like
    first = score_sales(table(spark, [sale(1), sale(2, provider=" ")]), now()).orderBy("seen").collect()
    assert [r["completeness_score"] for r in first] == [54, 47]


def test_large_cards_are_dealt_to_many_tasks_with_the_same_values(spark):
    sales = table(spark, some_sales())
    whole, mixed, dealt = ({r["card_id"]: r for r in value_sales(sales, now(), most).collect()} for most in (1000, 40, 0))
    assert len(whole) == 6 and whole == mixed == dealt
    key = ["card_id", "seen", "status", "usable", "is_outlier"]
    one, two, three = (sorted(map(repr, judge_sales(sales, now(), most).select(key).collect())) for most in (1000, 40, 0))
    assert len(one) == 240 and one == two == three and any("excluded_outlier" in r for r in one)
    asks = sales.select("card_id", "provider", F.col("raw_id").alias("item"), F.col("all_in").alias("ask"), F.lit(True).alias("fixed_price"), "seen")
    values = value_sales(sales, now())
    assert len({repr(sorted(map(repr, asking_context(asks, values, most).collect()))) for most in (1000, 40, 0)}) == 1
    assert len({repr(sorted(map(repr, robust_prices(sales, "card_id", "all_in", most=most).collect()))) for most in (1000, 40, 0)}) == 1
