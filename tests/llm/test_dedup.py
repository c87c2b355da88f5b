import hashlib
from collections import Counter
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest

from cardloom.llm.components import components
from cardloom.llm.line_dedup import dedup_lines, line_bitmaps, op5_line_dedup
from cardloom.llm.near_dedup import near_duplicates, shared_counts
from cardloom.llm.shingles import Bands, Shingler

from .helpers import documents, empty, shingles

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_dedup_by_hand(rows, min_chars=20, min_docs=3):
    held, first = Counter(), {}
    key = lambda line: line.strip(SPACE).translate(LOWER)
    for doc, text in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            held[k] += 1
            first[k] = max(first.get(k, -1), -1 if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        drop = [len(k) >= min_chars and held[k] >= min_docs and (-1 if doc is None else doc) != first[k] for k in map(key, lines)]
        kept = "\n".join(line for line, d in zip(lines, drop, strict=True) if not d)
        out.append((doc, len(lines), sum(drop), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup_matches_plain_python(spark):
    docs = documents(spark)
    many = spark.createDataFrame([(100 + i, "\n".join([f"line number {i} {j} of a long text" for j in range(130)] + ["a line that all of these documents share"]), None, None, None, None, None, None, None, None) for i in range(5)], docs.schema)
    both = docs.union(many)
    found = dedup_lines(both)
    assert "size" in found.columns
    got = sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in found.collect()], key=str)
    assert got == line_dedup_by_hand([(r["doc_id"], r["text"]) for r in both.collect()])
    assert dedup_lines(empty(spark)).count() == 0


def test_bitmaps_are_the_lines_that_stay(spark):
    shared = "a line that all of these documents share"
    rows = [(i, "\n".join([f"own line {i} {j} of a text" for j in range(i * 70)] + [shared, "end"])) for i in range(4)]
    found = {r["doc_id"]: r for r in line_bitmaps(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[3]["keep"] is None and found[3]["n_dropped"] == 0
    for i in range(3):
        word, bit = divmod(i * 70, 64)
        assert found[i]["keep"] == {word: ~(1 << bit) if bit < 63 else (1 << 63) - 1} and found[i]["n_dropped"] == 1


def test_a_hot_line_fills_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [(i, f"the very same line in every document\nown line number {i} of this document") for i in range(500)]
        found = line_bitmaps(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
        assert sorted(r["doc_id"] for r in found if not r["n_dropped"]) == [499] and sum(r["n_dropped"] for r in found) == 499
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_line_dedup_query_plan_is_native(spark):
    plan = op5_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def by_hand(rows, width, threshold):
    """Components from all pairs; rows that share an id are one node."""
    sets, parent = {}, {}
    for at, (doc, text) in enumerate(rows):
        sets[at] = shingles(text, width)
        parent[at] = at

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        (x, y), (s, t) = (rows[a][0], rows[b][0]), (sets[a], sets[b])
        if None in (x, y):
            continue
        if (x == y and s and t) or (s and t and threshold.denominator * len(s & t) >= threshold.numerator * len(s | t)):
            parent[find(a)] = find(b)
    least = {}
    for at, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(at)] = min(least.get(find(at), doc), doc)
    return sorted(((doc, len(sets[at]), None if doc is None else least[find(at)]) for at, (doc, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("width", "threshold"), [(3, Fraction(85, 100)), (5, Fraction(4, 5))])
def test_near_duplicates_match_all_pairs(spark, width, threshold):
    drawn = np.random.default_rng(width)
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).select("doc_id", "text").collect()]
    base = [f"t{i}" for i in range(90)]
    for i in range(60):  # a family with few to many changed words, so that chains and near misses occur
        copy = list(base)
        for at in drawn.integers(0, len(copy), drawn.integers(0, 12)):
            copy[at] = f"new{drawn.integers(0, 4)}"
        rows.append((200 + i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_duplicates(docs, width, threshold).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == by_hand(rows, width, threshold)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_an_empty_table(spark):
    assert near_duplicates(empty(spark)).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500), (None, 3), (7, None), (900, 901), (901, 900)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 900: 900, 901: 900}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_shared_counts_are_exact():
    drawn = np.random.default_rng(1)
    sets = [np.unique(drawn.integers(0, 9000, n).astype(np.uint64)) for n in (1, 5, 3000, 7000, 40)]
    found = shared_counts(sets[:3], sets)
    assert found.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:3]]


def test_signatures_estimate_the_similarity():
    bands, words = Bands.for_threshold(0.8), [f"w{i}".encode() for i in range(2000)]
    shingler, functions = Shingler(1), None
    functions = bands.functions()
    a, b = shingler.shingles(b" ".join(words[:1500])), shingler.shingles(b" ".join(words[500:]))
    same = (bands.signature(a, functions) == bands.signature(b, functions)).mean()
    assert abs(same - 0.5) < 0.15
    assert (1 - 0.8**bands.rows) ** bands.count <= 1e-6
