"""Every registered query: against its checking SQL, or that it runs, on the smallest tables."""
import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402
from formscribe.plans.views import TABLES  # noqa: E402
from tools.check import canonical  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    yield connection
    connection.close()


#: These need keys of ten values or more, which the smallest tables do not have.
LARGE_KEYS = {"search_density", "search_kmeans", "trainer_examples", "training_pairs"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql(spark, name):
    """Gives rows; what they have to be is checked by the tests of its operator."""
    df = QUERIES[name](spark, SF_DIR)
    rows = df.collect()
    assert df.columns and (rows or name in LARGE_KEYS) and all(len(r) == len(df.columns) for r in rows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    rows = [r.asDict() for r in df.collect()]
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = [dict(zip(columns, r)) for r in cursor.fetchall()]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(rows, sorted(columns)) == canonical(want, sorted(columns))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
