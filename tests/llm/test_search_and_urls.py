import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.llm.topk import Group, top_k
from cardloom.llm.url_filter import as_of, filter_urls, validity


def top_by_hand(rows, k, every):
    valid = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({i: v for i, v in sorted(valid, reverse=True)}.items()):
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in valid if i != q)[:k]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored)]
    return out


@pytest.mark.parametrize("group", [16, 4096])
def test_top_k_matches_brute_force(spark, group):
    drawn = np.random.default_rng(5)
    rows = [(int(i), drawn.normal(size=8).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, [0.5] * 8) for i in range(40)]  # one very common vector
    rows += [(50, rows[50][1]), (7, rows[7][1]), (None, [1.0] * 8), (300, None), (301, [float("nan")] * 8), (302, [float("inf")] + [0.0] * 7), (303, [None] * 8), (304, []), (305, [2.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = top_k(table.repartition(3), F.col("vec_id") % 25 == 0, k=5, group_size=group, block=8, query_block=4)
    assert sorted(map(tuple, found.collect())) == top_by_hand(rows, 5, 25)


def test_top_k_with_few_or_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in top_k(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert top_k(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_bounds_hold_and_large_values_are_exact():
    drawn = np.random.default_rng(2)
    vectors = drawn.integers(-(1 << 29), 1 << 29, (64, 5))
    group = Group(np.arange(64), vectors, 8)
    queries = drawn.integers(-(1 << 29), 1 << 29, (6, 5))
    scores = np.array([[sum(int(x) * int(y) for x, y in zip(q, v, strict=True)) for v in vectors] for q in queries])
    assert (group.bounds(queries) >= scores.reshape(6, 8, 8).max(axis=2)).all()
    found = group.search(np.full(6, -1), queries, 3, np.full(6, np.iinfo(np.int64).min))
    assert [[-s for s, _ in best] for best in found] == (-np.sort(-scores, axis=1)[:, :3]).tolist()


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_urls_meet_the_entries_active_when_they_were_fetched(spark):
    entries = [("Example.com", "block", day(10)), ("example.com", "remove", day(20)), ("shop.example.com", "allow", day(12)), ("shop.example.com/a/b", "block", day(14)), (None, "block", day(1)), ("x.org", None, day(1)), ("tie.org", "allow", day(1)), ("tie.org", "block", day(1))]
    captures = [
        ("http://example.com/", day(9), None), ("http://example.com/", day(10), "block"), ("https://u:p@WWW.Example.com.:80/x?q#f", day(19), "block"), ("http://example.com/", day(20), None),
        ("http://shop.example.com/a", day(15), "allow"), ("http://shop.example.com/a/b/c", day(15), "block"), ("http://shop.example.com/a/bc", day(15), "allow"), ("http://shop.example.com//a//b", day(15), "block"),
        ("http://notexample.com/", day(15), None), (None, day(15), None), ("no url", day(15), None), ("http://example.com/", None, None), ("http://tie.org/", day(2), "block"), ("http://tie.org/", day(2), "block"),
    ]
    table = spark.createDataFrame([(i, *c, "clash") for i, c in enumerate(captures)], "page_id int, url string, fetched_at timestamp, expected string, action string")
    listed = spark.createDataFrame(entries, "pattern string, action string, listed_at timestamp")
    rows = filter_urls(table, listed).collect()
    assert len(rows) == len(captures)
    assert [(r["page_id"], r["action"], r["expected"]) for r in rows if r["action"] != r["expected"]] == []
    assert filter_urls(table, listed.limit(0)).filter("blocked").count() == 0
    assert filter_urls(table.limit(0), listed).count() == 0
    assert validity(listed).filter("pattern = 'example.com'").count() == 1


def test_paths_of_entries_keep_their_case(spark):
    entries = [("Example.com/Private/A", "block", day(1)), ("example.com/private", "allow", day(1)), ("EXAMPLE.com/Private/A", "allow", day(5)), ("Other.ORG", "block", day(1))]
    captures = [("http://EXAMPLE.com/Private/A/x", day(2), "block"), ("http://example.com/Private/A", day(6), "allow"), ("http://example.com/private/a", day(2), "allow"), ("http://example.com/Private", day(2), None), ("http://a.other.org/X", day(2), "block")]
    table = spark.createDataFrame([(i, *c) for i, c in enumerate(captures)], "page_id int, url string, fetched_at timestamp, expected string")
    rows = filter_urls(table, spark.createDataFrame(entries, "pattern string, action string, listed_at timestamp")).collect()
    assert [(r["page_id"], r["action"], r["expected"]) for r in rows if r["action"] != r["expected"]] == [] and len(rows) == len(captures)


def test_as_of_join_carries_entries_over_ranges(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keep several ranges
    try:
        entries = [("hot.org", day(d), "block" if d % 2 else "remove") for d in range(1, 30, 4)] + [("cold.org", day(3), "allow")]
        asked = [("hot.org", day(d % 40), i) for i, d in enumerate(range(400))] + [("cold.org", day(2), 900), ("cold.org", day(3), 901), ("cold.org", day(9), 902)]
        found = as_of(spark.createDataFrame(asked, "pattern string, at timestamp, n int"), spark.createDataFrame(entries, "pattern string, at timestamp, action string")).collect()
        assert len(found) == len(asked)
        for r in found:
            before = [(at, action) for pattern, at, action in entries if pattern == r["pattern"] and at <= r["at"]]
            assert r["action"] == (max(before)[1] if before else None)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_very_long_urls_count_as_a_whole(spark):
    long = "http://long.org/" + "/".join(f"s{i}" for i in range(3000))
    table = spark.createDataFrame([(0, long, day(2)), (1, long + "x", day(2))], "page_id int, url string, fetched_at timestamp")
    listed = spark.createDataFrame([(long.removeprefix("http://"), "block", day(1))], "pattern string, action string, listed_at timestamp")
    assert [r["blocked"] for r in filter_urls(table, listed).orderBy("page_id").collect()] == [True, False]


def test_top_k_keeps_to_its_columns(spark):
    rows = [(i, [float(i), 1.0], i, None) for i in range(6)]
    clash = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score bigint, rank string")
    assert top_k(clash, F.col("vec_id") == 0, k=2).columns == ["query_id", "rank", "vec_id", "score"]
    assert top_k(clash, F.col("vec_id") == 0, k=2).count() == 2
