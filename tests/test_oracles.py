"""Every treasury query against its DuckDB oracle, on the smallest tables."""

import datetime
import math

import pytest

from florin.plans import arrears_queries, audit_queries, backtest_queries, cash_queries, census_queries, coverage_queries, episode_queries, feature_queries, fx_risk_queries, ledger_queries, score_queries, signal_queries, source_queries  # noqa: F401  they register their queries
from florin.plans import queries as Q

SMALL = "/root/testdata/sf0.001"


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 4) + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(columns, rows, wanted):
    at = [columns.index(c) for c in wanted]
    return sorted(str([normal(r[k]) for k in at]) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    found = Q.queries()[name](spark, SMALL)
    wanted = duck.sql(Q.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    assert rows_of(found.columns, found.collect(), columns) == rows_of(wanted.columns, wanted.fetchall(), columns)


def test_flagship_has_a_row_per_company_and_month(spark):
    out = Q.flagship(spark, SMALL)
    assert out.count() == out.select("company_id", "month").distinct().count() > 0
