"""Every registered query against its SQL twin on the smallest sample."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    twin = entry.oracle_sql().get(name)
    if twin is None:
        assert len(got) > 0
    else:
        assert differences(got, con.execute(twin).df()) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "chunk_key", "score", "rerank_rank"]
