import pytest

from proselake.plans import samples
from proselake.plans.registry import CATALOGUE, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_same_rows_as_sql(spark, against_duckdb, name):
    against_duckdb(queries()[name](spark, FOLDER), oracle_sql()[name], FOLDER)


@pytest.mark.parametrize("name", sorted(samples.GOLDEN))
def test_samples(spark, against_duckdb, name):
    against_duckdb(queries()[name](spark, FOLDER), oracle_sql()[name], FOLDER)


def test_every_rule_is_a_query():
    assert {f"rule_{r}" for r in samples.RULES} <= set(queries()) and set(queries()) == set(oracle_sql())
