"""Every oracle-backed query equals its DuckDB SQL on sf0.001 (the driver checks sf0.01)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_callable_and_entry_runs(spark):
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 32
    df = E.entry(spark)
    assert len(df.collect()) > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = con.sql(ORACLE[name]).df()
    verdict = compare(got, want)
    assert verdict.startswith("OK"), verdict


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


TYPE_NAMES = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE", "StringType()": "VARCHAR",
              "DateType()": "DATE", "BooleanType()": "BOOLEAN", "TimestampNTZType()": "TIMESTAMP",
              "DecimalType(18,2)": "DECIMAL(18,2)"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_column_types_match_oracle(spark, con, name):
    got = {f.name: TYPE_NAMES.get(repr(f.dataType), repr(f.dataType))
           for f in QUERIES[name](spark, SF).schema.fields}
    want = {r[0]: r[1] for r in con.sql(f"DESCRIBE {ORACLE[name]}").fetchall()}
    assert got == want
