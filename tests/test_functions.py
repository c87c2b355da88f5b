import datetime as dt
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardloom.functions.expr import clamp, days_before, half_up, jaccard, listed, money, natural_key, normalize_text, window_days


def test_halves_round_up_on_both_sides_of_zero(spark):
    rows = spark.createDataFrame([(-0.125, -2.5), (0.125, 2.5), (None, None)], "x double, y double")
    got = rows.select(money("x").alias("m"), half_up("y").alias("h")).collect()
    assert [tuple(r) for r in got] == [(-0.12, -2), (0.13, 3), (None, None)]


def test_days_and_windows(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1), "90d"), (dt.datetime(2024, 2, 1), "7"), (None, "x"), (None, "99999d")], "t timestamp, w string")
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    got = rows.select(days_before("t", now).alias("d"), window_days("w").alias("w")).collect()
    assert [tuple(r) for r in got] == [(1.5, 90), (0.0, 7), (None, 90), (None, 3650)]


def plain(text):
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not "̀" <= c <= "ͯ").lower()
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text).split())


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="abcXYZ019 -#éÉüñçÅøß&", max_size=20), min_size=1, max_size=20))
def test_normalized_text_matches_unicode_decomposition(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["n"] for r in rows.select("i", normalize_text("t").alias("n")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_natural_order_jaccard_and_lists(spark):
    rows = spark.createDataFrame([("Card 10",), ("card 9",), ("Card 009b",)], "t string")
    assert [r["t"] for r in rows.orderBy(natural_key("t")).collect()] == ["card 9", "Card 009b", "Card 10"]
    one = spark.range(1)
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))
    none = F.array().cast("array<string>")
    got = one.select(jaccard(a, b).alias("j"), jaccard(none, none).alias("k"), clamp(F.lit(5), 0, 3).alias("c"), listed((F.lit(True), "p"), (F.lit(False), "q")).alias("l")).first()
    assert (round(got["j"], 4), got["k"], got["c"], got["l"]) == (0.3333, 0.0, 3, ["p"])
