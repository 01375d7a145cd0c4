"""Queries of the library against their SQL in DuckDB, at the smallest size."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from stylecast import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = [
    "min_month_category", "p9_sku_key", "p16_unify_case", "p21_sales_base", "t4_report_week_ordinal", "t9_week_status", "j3_primary_sku", "j5_tier_at_sale", "j7_week_events", "a6_trailing_windows",
    "a15_tier_at_sale_months", "f4_day_factors", "f5_week_signals", "m7_rolling_folds", "w1_w6_lag_features", "w11_split_by_share", "q1_run_rate", "k2_weighted_jaccard", "n1_reconciliation", "g16_settled_log", "s7_calendar_csv", "s9_csv_snapshot", "s10_forecast_snapshot", "s13_daily_stock", "k2_similar_over_half", "j10_category_pairs", "j9_alike_materials", "e2_accuracy_by_step", "x2_weekly_units",
]


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)[:10]
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    res = con.execute(registry.ORACLES[name])
    cols = [c[0] for c in res.description]
    want = sorted((tuple(plain(v) for v in r) for r in res.fetchall()), key=str)
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*(f"`{c}`" for c in cols)).collect()), key=str)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
