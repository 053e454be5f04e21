import duckdb
import pytest

import __spark_entry__ as entry_point
from tools.check import TABLES, norm

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "PF1_position_valuation", "AG1_portfolio_totals", "SC15_position_analysis", "SC24_deployment_orders",
    "SC37_run_verdicts", "AG10_run_set_reports", "SC40_amount_stability", "SC41_set_stability", "WN10_annual_series",
    "SJ4_fact_as_of", "TK2_screening_rank", "SC30_addition_review", "TX2_reply_parsing", "TX5_privacy_scan",
    "IO10_company_facts", "ST12_interleaved_order",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_registry():
    queries, oracles = entry_point.queries(), entry_point.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 150 and len(oracles) > 130


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    df = entry_point.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert rows == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_entry_runs(spark):
    assert entry_point.entry(spark).count() > 0
