"""The base frames: lines joined for large tables against the view, repeats among them."""

import os

import pytest
from pyspark.sql import functions as F

from stylecast.functions import keys
from stylecast.plans import base, fixtures
from stylecast.sources import orders

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The small tables with a tenth of the lines, some orders and a nation listed twice."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    out = str(tmp_path_factory.mktemp("tables"))
    for name in fixtures.TABLES:
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        again = {"lineitem": "l_orderkey % 10 = 0", "orders": "o_orderkey % 50 = 0", "nation": "n_nationkey = 3"}.get(name, "false")
        rows.unionByName(rows.where(again)).write.parquet(f"{out}/{name}.parquet")
    return out


def test_lines_are_those_of_the_view(spark, tables):
    want = fixtures.view(spark, tables, "orders_v")
    got = fixtures.order_lines(spark, tables).drop("l_orderkey")
    assert got.dtypes == want.dtypes
    assert got.count() == want.count() and not got.exceptAll(want).count()
    want = orders.clean(want, fixtures.TODAY)
    got = base.cleaned(spark, tables)
    assert got.columns == want.columns and got.count() == want.count() and not got.exceptAll(want).count()


def test_lines_move_once_for_orders_and_once_for_parts(spark, tables):
    """No other exchange of lines, none of the wide rows to drop repeats, even where nothing is broadcast by its size."""
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = orders.clean(fixtures.order_lines(spark, tables), fixtures.TODAY, by="l_orderkey")
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    above = plan[: plan.index("SortMergeJoin")]
    assert "Exchange hashpartitioning" not in above and above.count("Sort [") == 1
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1


@pytest.mark.parametrize("code,want", [("6302-L", "6302"), ("001-04-XL", "001-04"), ("A-XL_B", "A"), ("A-XLB-S", "A-XLB"), ("X-FREE SIZE", "X-FREE"), ("x-freesize", "X"), ("NODASH", None), ("-A-B", None), ("", None), (None, None)])
def test_design_key(spark, code, want):
    assert spark.range(1).select(keys.design_key(F.lit(code).cast("string")).alias("x")).first().x == want


@pytest.mark.parametrize("status,want", [("Delivered", True), (" in \t transit ", True), ("Cancelled", False), ("", False), (None, False)])
def test_gross(spark, status, want):
    assert spark.range(1).select(keys.is_gross(F.lit(status).cast("string")).alias("x")).first().x is want
