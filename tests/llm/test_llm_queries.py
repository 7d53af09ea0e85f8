"""Registered training-data queries against their SQL on the smallest tables."""

import os

import pytest
from test_queries import DATA, ORACLES, duck, normal  # noqa: F401

import __spark_entry__


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n.startswith("op")))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    df = __spark_entry__.queries()[name](spark, DATA)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(ORACLES[name])
    assert got == normal([d[0] for d in cursor.description], cursor.fetchall())
