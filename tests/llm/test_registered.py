"""Registered queries of the subpackage against their SQL, and the guard of the entry."""

import pytest
from compare import difference, duck

import __spark_entry__ as entry_module
from dispatchlake.llm.queries import QUERIES


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(entry_module.queries())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_sql(spark, sf, name):
    run, sql = QUERIES[name]
    assert difference(run(spark, sf), duck(sf), sql) == ""
