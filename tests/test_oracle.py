"""Every registered query against its DuckDB oracle on the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as se
from tests.conftest import SF_SMALL
from ticketlake import registry
from tools.check_oracle import RAW, rows_of

ORACLES = se.oracle_sql()
# iterative loop rule: checked against a brute-force model in test_admin.py
NO_ORACLE = {"category_changes"}
# the training-data queries have their own tests
NAMES = sorted(set(registry.QUERIES) - NO_ORACLE)


@pytest.fixture(scope="module")
def con():
    import os
    c = duckdb.connect()
    for t in RAW:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) - NO_ORACLE <= set(ORACLES)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = se.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLES[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert rows_of(df.columns, srows) == rows_of(ocols, orows)


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.count() > 0 and "agent_name" in df.columns
