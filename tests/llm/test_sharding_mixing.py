import zlib
from collections import defaultdict

import numpy as np
import pytest

from cardloom.llm.mixing import mix, mixed_texts
from cardloom.llm.sharding import jump_buckets, shard

from .helpers import documents, empty, words


def jump(key, n):
    """The published loop, one key at a time."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_buckets_follow_the_published_loop():
    keys = np.random.default_rng(3).integers(0, 1 << 63, 500, np.int64).astype(np.uint64)
    for n in (1, 2, 8, 9, 100):
        assert jump_buckets(keys, n).tolist() == [jump(int(k), n) for k in keys]


def test_one_more_shard_only_takes_rows_into_itself():
    keys = np.arange(20_000, dtype=np.uint64)
    old, new = jump_buckets(keys, 8), jump_buckets(keys, 9)
    moved = old != new
    assert set(new[moved]) == {8}
    assert 0.09 < moved.mean() < 0.13


def test_shard_numbers_rows_without_gaps(spark):
    docs = documents(spark)
    rows = shard(docs, shards=3).collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[7]["size"] == 1 and by_id[7]["text_crc32"] == 0
    assert by_id[14]["text_crc32"] == zlib.crc32("Élan ÉLAN élan été déjà vu".encode())
    assert len({(r["shard"], r["grown_shard"]) for r in rows if r["doc_id"] == 2}) == 1
    assert shard(empty(spark)).count() == 0


def filled(sizes, weights, cap):
    """Redistribution round by round."""
    target, clamped, total = {}, set(), sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in clamped]
        left = total - sum(cap * sizes[s] for s in clamped)
        target = {s: cap * sizes[s] if s in clamped else left * weights[s] / sum(weights[x] for x in free) for s in sizes}
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            return target
        clamped |= over


def test_mix_meets_water_filled_targets(spark):
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), "s" + str(i % 5)) for i in range(300)] + [(1000 + i, "one two", "tiny") for i in range(2)] + [(2000, None, None), (2001, "x y z", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mix(docs).collect()
    sizes, seen = defaultdict(int), {}
    for _, text, source in rows:
        sizes[source] += len(words(text))
    order = sorted((s for s in sizes if s is not None)) + [None]
    expected = filled({s: n for s, n in sizes.items() if n}, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}, 3)
    taken = defaultdict(int)
    for r in found:
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] + r["part"]
        taken[r["source"]] += r["taken"]
        seen[r["source"]] = r["target"]
    for s, t in expected.items():
        assert seen[s] == pytest.approx(t)
        assert abs(taken[s] - t) <= 1
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mix(docs).collect()), key=str)


def test_mixed_texts_repeat_and_cut(spark):
    docs = spark.createDataFrame([(1, "a b c d", "s"), (2, "e f", "t"), (3, None, "u"), (3, None, "u")], "doc_id bigint, text string, source string")
    plan = {r["doc_id"]: r["taken"] for r in mix(docs).collect() if r["size"]}
    out = mixed_texts(docs)
    assert out.columns == docs.columns
    taken = defaultdict(int)
    for r in out.collect():
        taken[r["doc_id"]] += len(words(r["text"]))
    assert dict(taken) == {k: v for k, v in plan.items() if v}


def test_mix_of_hard_rows(spark):
    assert mix(documents(spark)).count() == documents(spark).count()
    assert mix(empty(spark)).count() == 0
    assert mixed_texts(empty(spark)).count() == 0
