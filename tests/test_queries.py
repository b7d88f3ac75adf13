"""Every registered query against its SQL on the smallest tables."""

import re

import pytest

import __spark_entry__ as entry
from queries.compare import check, duck

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
# queries of the subpackage that may be left out are tested beside it
QUERIES = {n: q for n, q in entry.queries().items() if n != "pipeline" and not re.match(r"op\d+_", n)}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_all_queries_have_sql():
    assert set(QUERIES) <= set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert check(spark, con, SF, QUERIES[name], SQL[name]) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["FechaAumento", "Aumento_Campania", "N"] and len(df.columns) == 43
    months = [r.FechaAumento for r in df.collect()]
    assert months and months == sorted(months)
