import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from cardloom.operators import events as Q
from cardloom.operators import vectors as V

from .test_registry import SF, TABLES, same


@pytest.mark.parametrize("name", ["split_assignment", "split_leakage", "rate_limit"])
def test_folded_queries_match_sql_and_gather_no_group(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert same(map(tuple, frame.select(columns).collect()), expected)
    assert "collect_list" not in frame._jdf.queryExecution().toString()


def test_group_hashes_of_a_hot_group(spark):
    drawn = np.random.default_rng(3)
    rows = [(int(g), f"{h:03d}") for g, h in drawn.integers(0, 40, (2000, 2))] + [(7, "copy")] * 10_000 + [(50, None), (None, "x")]
    held = defaultdict(list)
    for g, h in rows:
        held[g] += [h] * (h is not None)
    expected = {g: hashlib.sha256("|".join(sorted(h)).encode()).hexdigest() for g, h in held.items() if g is not None}
    found = V.group_splits(spark.createDataFrame(rows, "g int, h string").repartition(5), "g", "h")
    assert {(r["g"], r["group_hash"]) for r in found.select("g", "group_hash").distinct().collect()} == set(expected.items())
    assert found.count() == len(rows) - 1


def test_windows_of_a_hot_key(spark):
    drawn = np.random.default_rng(4)
    rows = [(int(k), int(t)) for k, t in zip(drawn.integers(0, 5, 500), drawn.integers(0, 5000, 500), strict=True)] + [(9, int(t)) for t in drawn.integers(0, 100_000, 25_000)] + [(None, 5), (None, 6), (1, None)]
    expected, state = [], {}
    for k, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1])):
        start, used = state.get(k, (None, 0))
        start, used = (t, 1) if start is None or t - start >= 50 else (start, used + 1)
        state[k] = start, used
        expected.append((k, t, used, used <= 3))
    found = Q.first_hit_windows(spark.createDataFrame(rows, "k int, t bigint").repartition(5), "k", "t", 50, 3)
    assert found.columns == ["k", "at", "used", "allowed"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
