import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.operators import vector_index as X
from cardloom.operators import vectors as V
from cardloom.operators.vectors import cosine_search, packed
from cardloom.plans.systems import indexed_vector_search, vector_search


def unit_rows(spark, n, dim, seed, centers=0):
    draw = np.random.default_rng(seed)
    v = draw.normal(size=(n, dim))
    if centers:
        v = draw.normal(size=(centers, dim))[draw.integers(0, centers, n)] + 0.3 * v
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "id bigint, v array<double>")


def exact(v, queries, k):
    out = set()
    for q in queries:
        near = (v @ v[q]).round(6)
        out |= {(q, rank, int(i)) for rank, i in enumerate(np.lexsort((np.arange(len(v)), -near))[:k], 1)}
    return out


def test_exact_search_and_whole_probe(spark):
    v, rows = unit_rows(spark, 700, 16, 1)
    queries = rows.filter("id % 20 = 0")
    wanted = exact(v, range(0, 700, 20), 5)
    assert {tuple(r)[:3] for r in cosine_search(queries, rows, 5).collect()} == wanted
    index = X.build_index(rows, 5, cells=9)
    assert {tuple(r)[:3] for r in X.indexed_search(queries, index, 5, probes=9).collect()} == wanted
    held = [np.frombuffer(r["ids"], np.int64) for r in index.postings.collect()]
    assert sorted(np.concatenate(held)) == list(range(700))


@pytest.mark.parametrize("centers", [0, 40])
def test_recall_with_few_probes(spark, centers):
    v, rows = unit_rows(spark, 3000, 32, 2, centers)
    index = X.build_index(rows, 10, max_train=1500)
    assert centers == 0 or index.probes < len(index.cells) / 2
    queries = rows.filter("id % 20 = 0")
    hits = X.recall_of(X.indexed_search(queries, index, 10), cosine_search(queries, rows, 10)).selectExpr("sum(hits) / sum(wanted) AS r").first()["r"]
    assert hits >= 0.9


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    share = X.recall_of(indexed_vector_search(spark, sf), vector_search(spark, sf)).selectExpr("sum(hits) / sum(wanted) AS r").first()["r"]
    assert share >= 0.9


def test_blocks_hold_one_cell_and_few_rows(spark):
    _, rows = unit_rows(spark, 300, 4, 3)
    placed = rows.selectExpr("id", "v", "id % 3 AS cell").repartition(2)
    blocks = packed(placed, 20, ["cell"]).collect()
    ids = [(r["cell"], np.frombuffer(r["ids"], np.int64)) for r in blocks]
    assert all(len(i) <= 20 and (i % 3 == c).all() for c, i in ids) and sum(len(i) for _, i in ids) == 300
    none = rows.limit(0)
    assert X.indexed_search(rows, X.build_index(none), 5).count() == 0 and cosine_search(rows, none, 5).count() == 0 and cosine_search(none, rows, 5).count() == 0


def test_python_steps_stay_small_whatever_the_probes(spark):
    v, _ = unit_rows(spark, 2000, 8, 3)
    batch = X.pa.RecordBatch.from_pylist([{"id": i, "v": x.tolist()} for i, x in enumerate(v)])

    class Rows:
        """A table whose mapInArrow runs here, on one batch of all rows."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return list(run(iter([batch])))

    made = X.to_cells(Rows(), v[:300], 250)
    assert max(b.num_rows for b in made) <= X.MOST and sum(b.num_rows for b in made) == 2000 * 250
    first = {(i, c) for b in made for i, c in zip(b["id"].to_pylist(), b["cell"].to_pylist(), strict=True)}
    assert first == {(i, int(c)) for i, cells in enumerate(np.argsort(-(v @ v[:300].T), axis=1, kind="stable")[:, :250]) for c in cells}


def test_products_are_taken_a_few_lines_at_a_time(spark, monkeypatch):
    v, rows = unit_rows(spark, 900, 8, 4)
    monkeypatch.setattr(V, "LINES", 7)
    found = {tuple(r)[:3] for r in cosine_search(rows.filter("id % 20 = 0"), rows, 5).collect()}
    assert found == exact(v, range(0, 900, 20), 5)


def test_norm_is_summed_once_for_a_vector(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,), ([float("inf"), 1.0],), ([None, 1.0],)], "v array<double>")
    unit = rows.select(V.unit(F.col("v"), 2).alias("u"))
    assert [r["u"] for r in unit.collect()] == [[0.6, 0.8], None, None, None, None, None, None]
    plan = unit._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") == 1, plan
