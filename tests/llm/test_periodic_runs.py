import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cardloom.llm.periodic_runs import Extensions, find_runs, op13_periodic_runs, periodic_runs

from .helpers import documents, empty, words


def runs_by_hand(w, least=12):
    """Every period over every place; a stretch counts if no smaller period holds for the whole of it."""
    found = []
    for q in range(1, len(w) // 2 + 1):
        at = 0
        while at + q < len(w):
            end = at
            while end + q < len(w) and w[end] == w[end + q]:
                end += 1
            if end > at:
                stretch = w[at : end + q]
                if len(stretch) >= max(least, 2 * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                    found.append((at, len(stretch), q))
            at = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def codes(w):
    known = {}
    return np.array([known.setdefault(x, len(known)) for x in w], np.int64)


def agree(texts, least=12):
    known = {}
    coded = [np.array([known.setdefault(x, len(known)) for x in w], np.int64) for w in texts]
    for w, rows in zip(texts, find_runs(coded, least), strict=True):
        assert [tuple(r) for r in rows.tolist()] == runs_by_hand(list(w), least), w


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_of_known_words():
    agree(["", "a", "a" * 11, "a" * 12, "ab" * 6, "ab" * 6 + "a", "abc" * 4, "abcd" * 3 + "e" + "abcd" * 3, fibonacci(200), "a" * 300, "aab" * 40 + "aac" * 40])


def test_runs_of_drawn_words():
    draw = random.Random(5)
    texts = []
    for _ in range(60):
        size = draw.randrange(2, 5)
        w = [draw.randrange(size) for _ in range(draw.randrange(0, 160))]
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(w) + 1)
            p = draw.randrange(1, 30)
            w[at:at] = [draw.randrange(9) for _ in range(p)] * draw.randrange(2, 6)
        texts.append(tuple(w))
    agree(texts)
    agree(texts, least=2)
    agree([texts[3]] * 5 + texts[:10])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=4), st.sampled_from([2, 5, 12]))
def test_runs_of_any_words(texts, least):
    agree([tuple(t) for t in texts], least)


def test_extensions_against_comparison():
    draw = random.Random(1)
    for size in (1, 2, 3, 50):
        w = [draw.randrange(size) for _ in range(120)] * 2 + [99]
        a, b = np.array([(x, y) for x in range(len(w)) for y in range(len(w)) if x != y]).T
        wanted = []
        for x, y in zip(a, b, strict=True):
            n = 0
            while max(x, y) + n < len(w) and w[x + n] == w[y + n]:
                n += 1
            wanted.append(n)
        assert Extensions(np.array(w)).common(a, b).tolist() == wanted


def test_only_suffixes_of_the_cover_are_sorted():
    found = Extensions(codes("abcabcabdabc" * 30 + "e"))
    assert len(found.places) == sum(x % 7 in (1, 2, 4) for x in range(361)) and len(found.rank) == len(found.places)


def test_hard_rows(spark):
    docs = documents(spark)
    rows = periodic_runs(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect())
    by_id = {r["doc_id"]: r for r in rows}
    assert (by_id[7]["n_words"], by_id[7]["runs"], by_id[7]["collapsed"]) == (0, [], "")
    assert by_id[9]["collapsed"] == "" and by_id[14]["collapsed"] == "Élan ÉLAN élan été déjà vu"
    assert by_id[10]["n_words"] == 30_000 and by_id[10]["runs"] == []
    assert periodic_runs(empty(spark)).count() == 0
    same = spark.createDataFrame([(1, "w " * 20_000), (2, "a b c " * 7 + "a x")], "runs int, collapsed string")
    found = {r["runs"]: r for r in same.select("runs", same.collapsed.alias("text")).transform(lambda d: periodic_runs(d.withColumnRenamed("runs", "id"), key="id").withColumnRenamed("runs", "found").withColumnRenamed("id", "runs")).collect()}
    assert [tuple(r) for r in found[1]["found"]] == [(0, 20_000, 1)] and found[1]["collapsed"] == "w"
    assert [tuple(r) for r in found[2]["found"]] == [(0, 22, 3)] and found[2]["collapsed"] == "a b c x"


def digests_by_hand(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(w)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    digest = lambda body: hashlib.sha256(body).hexdigest()
    return (
        doc_id, len(runs),
        *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
        digest("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()),
        digest(b" ".join(x for i, x in enumerate(w) if i not in dropped)),
    )


def test_query_against_brute_force(spark, tmp_path):
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choice(["uno", "due", "tre", "é\x1c", "x"]) for _ in range(draw.randrange(120)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (None, "a b " * 30), (1003, "a b " * 30), (1003, "a b " * 30), (1004, "\n".join(["line of five words here"] * 9)), (-7, "w " * 50)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert found == sorted((digests_by_hand(*row) for row in rows), key=str)


@pytest.mark.parametrize("name", ["start", "length", "period"])
def test_schema(spark, name):
    assert f"{name}:bigint" in periodic_runs(empty(spark)).schema["runs"].dataType.simpleString()
