"""Every registered query against its SQL twin."""

import pytest

from strideframe.plans import QUERIES, SQL
from tests.compare import SF, connection, duck_rows, spark_rows


@pytest.fixture(scope="module")
def duck():
    return connection()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    names, got = spark_rows(QUERIES[name](spark, SF))
    if name not in SQL:
        assert got
        return
    want_names, want = duck_rows(duck, SQL[name])
    assert names == want_names
    assert len(got) == len(want)
    assert got == want
