import pytest

from proselake import llm

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_rows_as_sql(spark, against_duckdb, name):
    against_duckdb(llm.queries()[name](spark, FOLDER), llm.oracle_sql()[name], FOLDER)
