"""Every registered query against its SQL on the smallest tables."""

import pytest

from pagemill.plans import all_queries
from tests.oracle_check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES = all_queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    q = QUERIES[name]
    df = q.build(spark, SF_DIR)
    assert len(set(df.columns)) == len(df.columns)
    if q.sql is None:
        df.count()
        return
    assert [p for p in compare(df, duck, q.sql) if not p.startswith("note")] == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
