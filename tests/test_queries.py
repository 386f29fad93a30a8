"""Every registered query against its SQL."""

import pytest
from compare import difference, duck

import __spark_entry__ as entry_module
from dispatchlake.queries import ALL


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[:3] == ["metric_us", "channel", "send_method_code"]
    assert df.count() > 0


def test_every_query_is_registered_with_sql():
    assert set(ALL) <= set(entry_module.queries())
    assert set(ALL) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", list(ALL))
def test_query_equals_sql(spark, con, sf, name):
    run, sql = ALL[name]
    assert difference(run(spark, sf), con, sql) == ""
