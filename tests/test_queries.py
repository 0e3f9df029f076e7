import pytest

from citeloom.plans import queries
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], FOLDER)


def test_flagship(spark):
    rows = queries.flagship(spark, FOLDER).collect()
    assert len(rows) == 4 and all(0 <= r.F1 <= 1 for r in rows)
