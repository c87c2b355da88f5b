import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cardloom.operators import hashes as H
from cardloom.operators import order as O
from cardloom.operators.components import linked_groups

from .test_registry import SF, TABLES, same


def longs(bits, words):
    return [x - (1 << 64) if x >> 63 else x for x in ((bits >> 64 * w) & (2**64 - 1) for w in range(words))]


def near_hashes(words, n, seed):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        base = draw.choice(out)[0] if out and draw.random() < 0.7 else draw.getrandbits(64 * words)
        for _ in range(draw.randrange(9)):
            base ^= 1 << draw.randrange(64 * words)
        out.append((base, draw.random()))
    return [(i, x) for i, (x, _) in enumerate(out)]


@pytest.mark.parametrize(("words", "most", "bands"), [(1, 3, None), (1, 16, 8), (4, 6, None), (4, 6, 5), (2, 9, 4)])
def test_probing_finds_all_pairs_within_the_distance(spark, words, most, bands):
    hashes = near_hashes(words, 70, words * 100 + most)
    rows = spark.createDataFrame([(i, longs(x, words)) for i, x in hashes] + [(1000, None)], "id bigint, hash array<bigint>")
    found = sorted(map(tuple, H.neighbours(rows, rows, most, words, bands).filter("a < b").collect()))
    wanted = sorted((i, j, (x ^ y).bit_count()) for i, x in hashes for j, y in hashes if i < j and (x ^ y).bit_count() <= most)
    assert found == wanted and wanted


def test_plans_need_fewer_bands_where_rows_are_many():
    assert H.band_plan(256, 6, 10_000)[1] in (0, 1)
    few, many = H.band_plan(64, 16, 1_000), H.band_plan(64, 16, 10**9)
    assert many[0] < few[0] and all(r == 16 // b for b, r in (few, many))


def test_difference_hash_covers_all_numbers(spark):
    drawn = np.random.default_rng(1).normal(size=(20, 64))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(drawn)] + [(98, [1.0, None]), (99, None)], "id int, v array<double>")
    found = dict(map(tuple, rows.select("id", H.difference_hash(F.col("v"), 64, 4)).collect()))
    for i, v in enumerate(drawn):
        bits = np.concatenate([v > np.roll(v, -turn) for turn in range(1, 5)])
        assert found[i] == H.pack_bits(bits)
    assert found[98] is None and found[99] is None


def test_groups_of_a_long_path_and_copies(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 400)] + [(5, 5), (None, 1), (7, 3), (3, 7)], "a bigint, b bigint")
    nodes = spark.createDataFrame([(i,) for i in [3, 5, 7, 1000, *range(100, 401)]], "id bigint")
    assert dict(map(tuple, linked_groups(nodes, edges).collect())) == {3: 3, 7: 3, 5: 5, 1000: 1000} | {i: 100 for i in range(100, 401)}
    rows = spark.createDataFrame([(i, [7]) for i in range(1, 2000)] + [(5000, [6]), (6000, [-1]), (7000, None)], "id bigint, hash array<bigint>")
    assert dict((r["id"], (r["group"], r["links"])) for r in H.near_groups(rows, 3, 1).collect()) == {**{i: (1, 1) for i in range(1, 2000)}, 5000: (1, 1), 6000: (6000, 0), 7000: (7000, 0)}
    assert H.near_links(rows, 3, 1).count() == 1998 + 1
    assert H.near_groups(rows.limit(0), 3, 1).count() == 0


def test_best_verified_match(spark):
    schema = "id bigint, content string, hash array<bigint>, plain_hash array<bigint>, evidence int"
    queries = spark.createDataFrame([(1, "x", [0], [0], 10), (2, "y", [0], [0], 10), (3, None, [-1], [0], 10), (4, None, None, None, 10), (5, "q", [255], [255], 0)], schema)
    references = spark.createDataFrame([(9, "x", [0], None, 1), (8, "x", [-1], None, 1), (7, None, [1], None, 9), (6, None, [3], None, 9), (5, None, [0], None, 2)], schema)
    score = 1 - F.abs(F.col("left") - F.col("right")) / 10
    found = {r["query_id"]: (r["id"], r["method"], r["score"]) for r in H.verified_matches(queries, references, 2, 1, score, score >= 0.5).collect()}
    assert found == {1: (8, "exact_content", 1.0), 2: (6, "verified", 0.9), 3: (6, "verified", 0.9)}


def test_pages_and_capped_rules(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice("abc"), draw.randrange(5) if i % 7 else None) for i in range(500)]
    frame = spark.createDataFrame(rows, "id int, g string, v int")
    wanted = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    got = O.page(frame, [F.col("v"), F.col("id")], 37, 20).orderBy("position").collect()
    assert [(r["position"], r["id"]) for r in got] == [(37 + i, r[0]) for i, r in enumerate(wanted[37:57])]
    assert O.page(frame, [F.col("id")], 495, 20).count() == 5 and O.page(frame.limit(0), [F.col("id")], 0, 5).count() == 0
    placed = O.numbered(O.in_order(frame, [F.col("g"), F.col("v"), F.col("id")]), ["g"], "n")
    for g in "abc":
        own = [r for r in wanted if r[1] == g]
        assert [r["id"] for r in placed.filter(F.col("g") == g).orderBy("n").collect()] == [r[0] for r in own]
    shown, counts = O.capped([frame.filter("v = 1"), frame.filter("v > 2"), frame.filter("v = 99")], [F.col("id")], 150)
    ones, more = [r[0] for r in rows if r[2] == 1], [r[0] for r in rows if (r[2] or 0) > 2]
    assert [r["id"] for r in shown.orderBy("position").collect()] == (ones + more)[:150]
    assert {r["rule"]: (r["found"], r["shown"]) for r in counts.collect()} == {0: (len(ones), len(ones)), 1: (len(more), 150 - len(ones))}


@pytest.mark.parametrize("name", ["duplicate_groups", "reference_matches"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    assert same(map(tuple, frame.select(columns).collect()), con.execute(f"SELECT {listed} FROM ({entry.oracle_sql()[name]})").fetchall())


def test_probe_patterns_are_rows_and_no_part_of_the_plan(spark):
    from cardloom.operators.hashes import banded, flips

    rows = spark.createDataFrame([(1, [0x0123_4567_89AB_CDEF]), (2, [-1])], "id bigint, hash array<bigint>")
    probes = banded(rows, 64, 4, 4, True)
    assert "Join" in probes._jdf.queryExecution().analyzed().toString()
    found = {(r["id"], r["at"], r["key"]) for r in probes.collect()}
    words = {1: 0x0123_4567_89AB_CDEF, 2: (1 << 64) - 1}
    assert found == {(i, at, (w >> 16 * at & 0xFFFF) ^ x) for i, w in words.items() for at in range(4) for x in flips(16, 4)}


def test_links_are_made_from_hashes_that_are_taken_once(spark):
    from cardloom.plans.likeness import hamming_neighbours

    plan = hamming_neighbours(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_matches_move_only_pairs_that_may_win(spark, monkeypatch):
    draw = random.Random(11)
    number = lambda: draw.getrandbits(63)
    bases = [[number() for _ in range(n)] for n in (3, 40, 250, 300, 900, 2500)]
    sets = [[x if draw.random() < part else number() for x in draw.choice(bases)] for part in (1.0, 0.97, 0.9, 0.8, 0.6, 0.2) for _ in range(40)]
    rows = [(i, None, [0], [draw.choice([0, 7])], len(set(s)), H.pack_bits(H.parity_bits(np.unique(np.array(s, np.uint64)))), s) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "id bigint, content string, hash array<bigint>, plain_hash array<bigint>, size int, parities array<bigint>, evidence array<bigint>")
    shared = F.size(F.array_intersect("left", "right"))
    score = shared / (F.size("left") + F.size("right") - shared)
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    wanted = {}
    for i, s in enumerate(sets):
        best = max(((jaccard(s, t), -k) for k, t in enumerate(sets) if i % 4 == 0 and k % 4), default=(0, 0))
        if best[0] >= 0.5:
            wanted[i] = (-best[1], best[0])
    moved = []
    monkeypatch.setattr(H, "written", lambda df, write=H.written: (moved.append(df.count()) if df.columns == ["a", "b", "score"] else None, write(df))[1])
    monkeypatch.setattr(H, "FEW", 2)
    found = H.verified_matches(frame.filter("id % 4 = 0"), frame.filter("id % 4 <> 0"), 2, 1, score, score >= 0.5, 0.5)
    assert {r["query_id"]: (r["id"], r["score"]) for r in found.collect()} == wanted
    assert sum(moved) < 60 * 180 / 20, "all 10,800 pairs are within the distance"
    # the bound holds for sets of any two sizes
    near = H.near_pairs(frame.select("id", "hash", F.col("hash").alias("plain"), "size", "parities", F.lit(0.0).alias("floor"), F.lit(0).cast("long").alias("floor_id")), frame, 2, 0.5, None).collect()
    bounds = {(r["a"], r["b"]): r["bound"] for r in near}
    for i, s in enumerate(sets):
        for k, t in enumerate(sets):
            assert jaccard(s, t) < 0.5 or bounds[i, k] >= jaccard(s, t)
