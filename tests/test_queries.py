"""Every registered query against its SQL on DuckDB, at the smallest scale factor."""

import pytest
from oracle import compare, duck

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()
#: The operators over training data have tests of their own.
QUERIES = {name: q for name, q in queries().items() if not name.startswith("op") and name != "pipeline"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name in SQL:
        problems = compare(df, con, SQL[name], rows)
        if problems == ["no rows"]:  # a rare case that the smallest tables do not hold
            wide = "/root/testdata/sf0.01"
            problems = compare(QUERIES[name](spark, wide), duck(wide), SQL[name])
        assert problems == []
    else:
        assert rows


def test_entry_runs(spark):
    df = entry(spark)
    assert df.columns == ["station", "d", "bucket", "hour", "yes_price", "won_no", "pnl"]
    df.collect()
