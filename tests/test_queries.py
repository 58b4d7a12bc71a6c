import pytest

import __spark_entry__ as entry_point
from ticketlake.registry.oracle import ORACLE as LIBRARY_SQL
from ticketlake.registry.queries import QUERIES as LIBRARY
from compare import connect, spark_rows, sql_rows
from ticketlake.storage import staged_run

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = {n: q for n, q in entry_point.queries().items() if n in LIBRARY}, LIBRARY_SQL


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    with staged_run(spark):
        assert spark_rows(QUERIES[name](spark, SF_DIR)) == sql_rows(con, ORACLE[name])
