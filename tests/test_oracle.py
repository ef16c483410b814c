"""Every registered query against its DuckDB twin at sf0.01 (the driver's correctness gate)."""

import pytest
from pyspark.sql import functions as F

from tessera.plans.catalog import QUERIES
from tessera.plans.oracle import SQL
from oracle_compare import SF_SMALL, compare

WITH_SQL = sorted(k for k in QUERIES if SQL.get(k))
WITHOUT_SQL = sorted(k for k in QUERIES if not SQL.get(k))


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_duckdb(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF_SMALL), con, SQL[name])
    assert ok, msg


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_has_rows_and_values(spark, name):
    """Queries without a twin (their values are tested beside their operators): rows, and a value in every column that is not optional."""
    df = QUERIES[name](spark, SF_SMALL).cache()
    rows = df.count()
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first().asDict()
    empty = {c for c, n in filled.items() if n == 0}
    assert rows > 0 and len(empty) < len(df.columns) / 2, (rows, filled)
