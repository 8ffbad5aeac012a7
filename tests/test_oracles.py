"""Every registered query with an oracle equals its DuckDB SQL (sf0.001)."""

import pytest

import panelkit.plans  # noqa: F401
from panelkit.plans.registry import ORACLES, QUERIES
from tools.oracle_check import duck, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, srows) == rows_of(dcols, drows)


def test_every_query_has_callable_and_entry_runs(spark):
    import __spark_entry__ as E
    assert set(ORACLES) <= set(QUERIES)
    out = E.entry(spark)
    assert out.count() >= 0
    assert out.columns == ["event_id", "user_id", "date", "value", "high_consumption", "log_value"]
