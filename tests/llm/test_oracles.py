"""Queries with SQL against DuckDB on whole tables, and the registry."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from cohortline.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), duck, queries.ORACLES[name]) == []


def test_every_operator_has_one_query():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names


def test_near_copies_are_found_on_the_next_size(spark):
    folder = "/root/testdata/sf0.01"
    name = "op3_jaccard_join"
    assert compare(queries.QUERIES[name](spark, folder), connect(folder), queries.ORACLES[name]) == []
