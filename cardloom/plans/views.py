"""Domain tables made from the star schema of a directory: sales, cards, holdings, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.session import table

AS_OF = "2001-11-05 00:00:00"

#: Columns that order sales and listings totally: all of lineitem's.
RAW_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sale for each line: provider, basis, price and card by rule, ordered by the raw columns."""
    return as_sales(sale_lines(spark, sf_dir))


def sale_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that sales are made of, with card_id."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("card_id"), *[c for c in RAW_ORDER if c != "l_partkey"])


def as_sales(lines: DataFrame) -> DataFrame:
    """The sales of sale_lines, row by row."""
    basis = F.element_at(
        F.array(*map(F.lit, ["official_api", "written_license", "commercial_partner", "user_authorized_export", "user_csv", "ebay_api", "scraped"])), (F.pmod("l_suppkey", F.lit(7)) + 1).cast("int")
    )
    return lines.select(
        "card_id",
        F.concat(F.lit("P"), F.pmod("l_suppkey", F.lit(4)).cast("string")).alias("provider"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("raw_id"),
        basis.alias("basis"),
        F.when(F.col("l_returnflag") == "A", "auction").when(F.col("l_returnflag") == "N", "fixed_price").otherwise("private").alias("sale_type"),
        (F.col("l_linestatus") == "F").alias("completed"),
        F.col("l_shipdate").cast("timestamp").alias("sold_at"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_tax") * 10).alias("shipping"),
        (F.col("l_discount") * 10).alias("premium"),
        (F.pmod("l_suppkey", F.lit(3)) != 0).alias("verified"),
        (F.lit(0.6) + F.pmod("l_linenumber", F.lit(4)) * F.lit(0.1)).alias("confidence"),
        F.struct(*[F.col("card_id").alias(c) if c == "l_partkey" else F.col(c) for c in RAW_ORDER]).alias("seen"),
    ).withColumn("all_in", F.col("price") + F.col("shipping") + F.col("premium"))


SALES_SQL = r"""
sales AS (
  SELECT l_partkey AS card_id, 'P' || (l_suppkey % 4)::VARCHAR AS provider, l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS raw_id,
    (['official_api','written_license','commercial_partner','user_authorized_export','user_csv','ebay_api','scraped'])[(l_suppkey % 7) + 1] AS basis,
    CASE l_returnflag WHEN 'A' THEN 'auction' WHEN 'N' THEN 'fixed_price' ELSE 'private' END AS sale_type,
    l_linestatus = 'F' AS completed, l_shipdate AS sold_at,
    l_extendedprice / l_quantity AS price, l_tax * 10 AS shipping, l_discount * 10 AS premium, l_suppkey % 3 <> 0 AS verified,
    0.6::DOUBLE + (l_linenumber % 4) * 0.1::DOUBLE AS confidence,
    l_extendedprice / l_quantity + l_tax * 10 + l_discount * 10 AS all_in,
    (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS seen
  FROM lineitem
)"""


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One holding for each line of an order, its customer the owner; F orders are sold."""
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "sold").when(F.col("o_orderstatus") == "P", "listed").otherwise("owned")
    joined = line.join(order, line["l_orderkey"] == order["o_orderkey"])
    return joined.select(
        F.col("o_custkey").alias("owner"),
        F.col("l_partkey").alias("card_id"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("item_id"),
        F.greatest(F.lit(1), F.floor(F.col("l_quantity") / 10)).cast("long").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity") * (1 - F.col("l_discount"))).alias("unit_cost"),
        F.col("o_orderdate").cast("timestamp").alias("bought_at"),
        status.alias("status"),
        (F.col("l_extendedprice") / F.col("l_quantity") * (1 + F.col("l_tax"))).alias("sold_price"),
        (F.col("l_extendedprice") / F.col("l_quantity") * F.lit(1.3)).alias("list_price"),
    )


HOLDINGS_SQL = r"""
holdings AS (
  SELECT o_custkey AS owner, l_partkey AS card_id, l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || '-' || l_partkey::VARCHAR || '-' || l_suppkey::VARCHAR AS item_id,
    greatest(1, floor(l_quantity / 10))::BIGINT AS quantity, l_extendedprice / l_quantity * (1 - l_discount) AS unit_cost, o_orderdate AS bought_at,
    CASE o_orderstatus WHEN 'F' THEN 'sold' WHEN 'P' THEN 'listed' ELSE 'owned' END AS status,
    l_extendedprice / l_quantity * (1 + l_tax) AS sold_price, l_extendedprice / l_quantity * 1.3::DOUBLE AS list_price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("card_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("set_name"), F.col("p_name").alias("player"), F.col("p_size").cast("string").alias("card_number"),
        (F.lit(1990) + F.pmod("p_partkey", F.lit(30))).cast("int").alias("year"),
        F.element_at(F.array(*map(F.lit, ["baseball", "basketball", "football", "hockey", "soccer"])), (F.pmod("p_partkey", F.lit(5)) + 1).cast("int")).alias("sport"),
        F.element_at(F.array(*map(F.lit, ["RAW", "PSA", "BGS", "SGC"])), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int")).alias("grader"),
        (F.lit(7) + F.pmod("p_partkey", F.lit(7)) * F.lit(0.5)).alias("grade"),
    )


CARDS_SQL = r"""
cards AS (
  SELECT p_partkey AS card_id, p_brand AS brand, p_type AS set_name, p_name AS player, p_size::VARCHAR AS card_number, (1990 + p_partkey % 30)::INT AS year,
    (['baseball','basketball','football','hockey','soccer'])[p_partkey % 5 + 1] AS sport, (['RAW','PSA','BGS','SGC'])[p_partkey % 4 + 1] AS grader,
    7 + (p_partkey % 7) * 0.5::DOUBLE AS grade
  FROM part
)"""


def asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One active listing for each open line."""
    line = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'")
    return line.select(
        F.col("l_partkey").alias("card_id"),
        F.concat(F.lit("P"), F.pmod("l_suppkey", F.lit(4)).cast("string")).alias("provider"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("item"),
        (F.col("l_extendedprice") / F.col("l_quantity") * F.lit(1.1) + F.col("l_tax") * 10).alias("ask"),
        (F.col("l_returnflag") != "R").alias("fixed_price"),
        F.struct(*RAW_ORDER).alias("seen"),
    )


ASKS_SQL = r"""
asks AS (
  SELECT l_partkey AS card_id, 'P' || (l_suppkey % 4)::VARCHAR AS provider, l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS item,
    l_extendedprice / l_quantity * 1.1::DOUBLE + l_tax * 10 AS ask, l_returnflag <> 'R' AS fixed_price,
    (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS seen
  FROM lineitem WHERE l_linestatus = 'O'
)"""
