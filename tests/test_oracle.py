"""Driver-contract gate: every query with oracle SQL matches DuckDB on the
same Parquet tables (row count, column names, order-insensitive values)."""

import duckdb
import pytest

import __spark_entry__ as E
from corpusloom.plans import registry
from tools.check_oracle import digest
from corpusloom.sources.tables import TABLES, table_path
from tests.conftest import SF_SMALL

ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    return c


def test_every_query_has_a_callable():
    qs = registry.queries()
    assert set(qs) <= set(E.queries())
    assert set(ORACLE) <= set(qs)
    assert len(qs) >= 60


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = registry.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLE[name])
    ocols = [d[0] for d in cur.description]
    orows = [tuple(r) for r in cur.fetchall()]
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "density_per_1k" in df.columns
