import os

import pytest

from furrow import queries
from tests.oracle import DATA, connect, normal

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    if name in queries.ORACLES:
        assert normal(got) == normal(connect(DATA).execute(queries.ORACLES[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(e.queries()) and set(queries.ORACLES) <= set(e.oracle_sql())
