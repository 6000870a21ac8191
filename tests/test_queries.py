import pytest
from compare import connect, difference

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    folder = FOLDER
    if name.startswith("fitted_"):  # a floor on F1 says little about the 30 test rows there
        folder = "/root/testdata/sf0.01"
        con = connect(folder)
    assert difference(spark, con, entry.queries()[name], SQL[name], folder) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r.split for r in rows} == {"validation", "test"}
    assert all(r.automatic + r.human_review == r.total for r in rows)
