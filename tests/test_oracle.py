"""Every registered query against its DuckDB oracle on sf0.001 (the driver
runs the same comparison on sf0.01)."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from tidemark.plans.queries import registry
from tidemark.testing.compare import compare, duck_connection
from tidemark.testing.oracle import SQL as ORACLE

# The engine's own keys; the optional text operators have tests of their own.
QUERIES = registry()


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE",
              "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "double": "DOUBLE",
              "decimal(18,2)": "DECIMAL(18,2)"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(utc, duck, name):
    df = QUERIES[name](utc, SF_SMALL)
    rel = duck.sql(ORACLE[name])
    spark_types = {f.name: DUCK_TYPES.get(f.dataType.simpleString()) for f in df.schema.fields}
    assert spark_types == dict(zip(rel.columns, [str(t) for t in rel.types]))
    result = compare(df, ORACLE[name], SF_SMALL, duck)
    assert result["columns_match"], result
    assert result["rows_spark"] == result["rows_oracle"], result
    assert result["values_match"], result


def test_entry_smoke(utc):
    df = entry.entry(utc)
    assert df.count() > 0
    assert "user_id" in df.columns
