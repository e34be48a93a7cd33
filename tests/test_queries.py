"""Driver contract: every registered query against its SQL twin (sf0.001), entry smoke."""

import pytest

import __spark_entry__ as entry
from cachescope.plans.crosscheck import compare, duckdb_with_tables
from cachescope.plans.oracle import SQL
from cachescope.plans.queries import REGISTRY

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def con():
    return duckdb_with_tables(SF_SMALL)


def test_every_query_has_sql_or_is_marked():
    rows_only = set(REGISTRY) - set(SQL)
    assert set(REGISTRY) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert rows_only <= {"gateway_flow", "cache_lookup", "neighbor_pairs_lsh"}
    assert set(SQL) <= set(REGISTRY)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    assert compare(df, con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(SQL)))
def test_rows_only_queries_run(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    assert df.count() > 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["vec_id", "match_id", "distance", "outcome"]
