"""Every query against its SQL on the smallest scale."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert len(got) > 0
    assert difference(got, con.execute(SQL[name]).df()) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())
    plain = {q for q in entry.queries() if q != "pipeline" and not q.startswith("op")}
    assert plain - SQL.keys() == {"train_models"}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "userid" and df.count() > 0
