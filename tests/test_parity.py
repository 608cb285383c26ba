"""Every registered query against its DuckDB oracle on the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.compare import digest
from tests.conftest import SMALL
from washline.plans.registry import QUERIES
from washline.sources.tables import TABLE_NAMES

KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(KEYS) <= set(E.queries())
    assert set(KEYS) <= set(E.oracle_sql())


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert df.columns[:6] == ["finished_count", "total_sales", "active_count", "unclaimed_count",
                              "unpaid_count", "voided_count"]


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[key])
    orows = res.fetchall()
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    hs, ls = digest(srows, df.columns)
    ho, lo = digest(orows, ocols)
    assert hs == ho, (sorted(set(ls) - set(lo))[:3], sorted(set(lo) - set(ls))[:3])
