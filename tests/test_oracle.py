"""Every registered query with an oracle equals its DuckDB SQL on sf0.001
(the driver repeats this at sf0.01)."""

import pytest

import __spark_entry__ as E
from oracle.compare import compare
from tests.conftest import SF_SMALL

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = duck.execute(ORACLE[name]).fetchdf()
    assert compare(got, want) == []


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(["route_id", "trip_date", "on_time_rate", "meets_ltfrb_target"]) <= set(df.columns)
    assert df.count() > 0
