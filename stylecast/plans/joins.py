"""Queries: joins and their aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import keys
from ..operators import joins
from ..registry import query
from ..sources import orders
from .base import cleaned, design_sql, sales
from .fixtures import VIEWS, view

_KEY = design_sql("product_sku_code")
VIEWS["integrated_v"] = f"""SELECT c.*, CASE WHEN norm IS NOT NULL AND norm <> upper(trim(dn)) THEN norm ELSE dn END AS DESIGN_NO, DESIGN_GROUP, LAUNCH_DATE FROM (
 SELECT o.*, coalesce(m.DESIGN_NO, o.design_key) AS dn, {design_sql('coalesce(m.DESIGN_NO, o.design_key)')} AS norm, DESIGN_GROUP, LAUNCH_DATE FROM (SELECT *, {_KEY} AS design_key FROM clean_v) o
 LEFT JOIN (SELECT * FROM (SELECT *, {design_sql('DESIGN_NO')} AS design_key, row_number() OVER (PARTITION BY {design_sql('DESIGN_NO')} ORDER BY DESIGN_NO) AS r FROM design_master_v) WHERE r = 1) m ON o.design_key = m.design_key) c"""
VIEWS["wip_v"] = f"SELECT {design_sql('DESIGN_NAME')} AS design, upper(trim(SIZE)) AS size, sum(IN_HOUSE_QTY_WIP + JOB_WORK_QTY_WIP + ALLOCATION_QTY) AS wip, sum(PENDING_QTY_PIECES) AS stock FROM planning_v GROUP BY 1, 2"
VIEWS["stocked_v"] = """SELECT c.*, split_part(upper(product_sku_code), '-', 1) || CASE WHEN contains(product_sku_code, '-') THEN '-' || split_part(upper(product_sku_code), '-', 2) ELSE '' END AS design, trim(split_part(upper(product_sku_code), '-', 3)) AS size FROM clean_v c"""


def wip_stock(spark, sf):
    plan = view(spark, sf, "planning_v")
    return joins.wip_by_size(plan), joins.stock_by_size(plan.withColumnRenamed("DESIGN_NAME", "DESIGN_NO"))


@query("a1_wip_by_size", "SELECT design, size, wip FROM wip_v")
def a1(spark, sf):
    return wip_stock(spark, sf)[0]


@query("a2_stock_by_size", "SELECT design, size, stock FROM wip_v")
def a2(spark, sf):
    return wip_stock(spark, sf)[1]


@query("j1_design_master", "SELECT DESIGN_NO, DESIGN_GROUP, LAUNCH_DATE, count(*) AS n_lines, CAST(sum(qty) AS BIGINT) AS units FROM integrated_v GROUP BY ALL")
def j1(spark, sf):
    rows = joins.with_design(cleaned(spark, sf), view(spark, sf, "design_master_v"))
    return rows.groupBy("DESIGN_NO", "DESIGN_GROUP", "LAUNCH_DATE").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("qty").alias("units"))


_STOCKED = "SELECT design, size, product_sku_code, count(*) AS n_lines, max(coalesce(wip, 0)) AS wip, max(coalesce(stock, 0)) AS stock FROM stocked_v LEFT JOIN wip_v USING (design, size) GROUP BY ALL"


@query("j2_stock_and_wip", _STOCKED)
def j2(spark, sf):
    rows = joins.with_stock(cleaned(spark, sf), *wip_stock(spark, sf))
    return rows.groupBy("design", "size", "product_sku_code").agg(F.count(F.lit(1)).alias("n_lines"), F.max("wip").alias("wip"), F.max("stock").alias("stock"))


@query("j3_primary_sku", f"WITH x AS ({_STOCKED}), r AS (SELECT *, row_number() OVER (PARTITION BY design, size ORDER BY n_lines DESC, product_sku_code) AS r FROM x) SELECT product_sku_code, design, size, CASE WHEN r = 1 THEN wip ELSE 0 END AS wip, CASE WHEN r = 1 THEN stock ELSE 0 END AS stock FROM r")
def j3(spark, sf):
    rows = joins.primary_sku_only(joins.with_stock(cleaned(spark, sf), *wip_stock(spark, sf)))
    return rows.groupBy("product_sku_code", "design", "size").agg(F.max("wip").alias("wip"), F.max("stock").alias("stock"))


_ASOF = "SELECT style, month, week, coalesce(tier, '{unknown}') AS tier, units FROM (SELECT style, month, CAST(date_trunc('week', day) AS DATE) AS week, CAST(sum(qty) AS BIGINT) AS units FROM sales_v GROUP BY ALL) s ASOF LEFT JOIN tier_history_v t ON s.style = t.name AND s.week >= t.effective_from"


def _weekly(spark, sf):
    return sales(spark, sf).groupBy("style", "month", cal.monday(F.col("day")).alias("week")).agg(F.sum("qty").alias("units"))


@query("j4_tier_as_of", _ASOF.format(unknown="Unknown"))
def j4(spark, sf):
    return joins.tier_as_of(_weekly(spark, sf), view(spark, sf, "tier_history_v"), "style", "week").select("style", "month", "week", "tier", "units")


@query(
    "j5_tier_at_sale",
    """WITH now AS (SELECT name, max_by(tier, effective_from) AS now FROM tier_history_v GROUP BY name)
SELECT style, month, week, coalesce(t.tier, now.now, 'Unclassified') AS tier, units FROM (SELECT style, month, CAST(date_trunc('week', day) AS DATE) AS week, CAST(sum(qty) AS BIGINT) AS units FROM sales_v GROUP BY ALL) s
ASOF LEFT JOIN tier_history_v t ON s.style = t.name AND s.week >= t.effective_from LEFT JOIN now ON s.style = now.name""",
)
def j5(spark, sf):
    return joins.tier_at_sale(_weekly(spark, sf), view(spark, sf, "tier_history_v"), "style", "week").select("style", "month", "week", "tier", "units")


@query("j6_event_days", "SELECT day, e.name, CAST(sum(qty) AS BIGINT) AS units FROM sales_v s JOIN events_calendar_v e ON s.day BETWEEN e.start_date AND e.end_date GROUP BY ALL")
def j6(spark, sf):
    daily = sales(spark, sf).groupBy("day").agg(F.sum("qty").alias("units"))
    return daily.join(joins.event_days(view(spark, sf, "events_calendar_v")), "day").select("day", "name", "units")


@query(
    "j7_week_events",
    """WITH w AS (SELECT DISTINCT CAST(date_trunc('week', day) AS DATE) AS week FROM sales_v),
m AS (SELECT week, string_agg(DISTINCT name, ' + ' ORDER BY name) AS event, bool_or(category = 'festival') AS f, bool_or(category = 'sale') AS s FROM w JOIN events_calendar_v ON start_date <= week + 6 AND end_date >= week GROUP BY week)
SELECT w.week, event, CASE WHEN f AND s THEN 'both' WHEN f THEN 'festival' WHEN s THEN 'sale' END AS event_kind FROM w LEFT JOIN m USING (week)""",
)
def j7(spark, sf):
    weeks = sales(spark, sf).select(cal.monday(F.col("day")).alias("week")).distinct().withColumn("week_end", F.date_add("week", 6))
    return joins.with_events(weeks, view(spark, sf, "events_calendar_v"), "week", "week_end").drop("week_end")


@query("j13_style_dimensions", "SELECT category, sub_category, CAST(sum(qty) AS BIGINT) AS units FROM sales_v GROUP BY ALL")
def j13(spark, sf):
    rows = joins.with_styles(orders.sales_base(cleaned(spark, sf)), view(spark, sf, "attributes_v"), ("category", "sub_category"))
    return rows.groupBy("category", "sub_category").agg(F.sum("qty").alias("units"))


@query("j15_current_tier", "SELECT name AS style, max_by(tier, effective_from) AS tier FROM tier_history_v GROUP BY name")
def j15(spark, sf):
    return joins.current_tier(view(spark, sf, "tier_history_v"))
