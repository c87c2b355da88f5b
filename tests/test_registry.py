import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def same(a, b):
    plain = lambda x: "~" if x is None or x != x else f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(map(lambda r: tuple(map(plain, r)), a)) == sorted(map(lambda r: tuple(map(plain, r)), b))


@pytest.mark.parametrize("name", ["card_valuation", "portfolio_metrics", "decision_signals", "catalog_search", "sale_upsert", "event_intake", "task_readiness", "vector_search", "hamming_neighbours", "normalized_sales", "parsed_certificates", "survey_summaries", "scan_pairs", "visual_rerank", "evidence_ledger", "recognition_decisions", "card_aware_sales"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert same(map(tuple, frame.select(columns).collect()), expected)
