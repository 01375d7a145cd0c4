"""Queries: sales analysis (A3-A27, J11, J12, W11) and the flagship month by category table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import keys
from ..operators import analysis, joins
from ..registry import query
from ..sources import orders
from .base import GROSS_SQL, NET_SQL, NOW, cleaned, net, sales
from .fixtures import TODAY, VIEWS, view

_M = "strftime(CAST(month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m')"


def months_sql(group: str, frame: str = "sales_v", tag: str = "") -> str:
    """Common table expressions that end in r (month, g, styles, orders, units, prev_units, partial, change_pct)."""
    return f"""b AS (SELECT month, {group} AS g, count(DISTINCT style) AS styles, count(*) AS orders, CAST(sum(qty) AS BIGINT) AS units, CAST(sum(CASE WHEN day(day) <= day({NOW}) THEN qty ELSE 0 END) AS BIGINT) AS early FROM {frame} GROUP BY ALL),
p AS (SELECT {_M} AS month, g, units AS whole, early AS part FROM b),
q AS (SELECT month, g, styles, orders, units, month = '2001-08' AS partial, coalesce(CASE WHEN month = '2001-08' THEN part ELSE whole END, 0) AS prev_units FROM b LEFT JOIN p USING (month, g)),
r AS (SELECT *, CASE WHEN prev_units > 0 THEN round_even((units - prev_units) / prev_units * 100, 1) END AS change_pct FROM q)"""


def same_sql(group: str, frame: str = "sales_v") -> str:
    """Common table expressions that end in same."""
    return f"""u AS (SELECT month, {group} AS g, style, CAST(sum(qty) AS BIGINT) AS units, CAST(sum(CASE WHEN day(day) <= day({NOW}) THEN qty ELSE 0 END) AS BIGINT) AS early FROM {frame} GROUP BY ALL),
v AS (SELECT {_M} AS month, g, style, units AS whole, early AS part FROM u),
w AS (SELECT month, g, units AS sold, coalesce(units, 0) AS now, coalesce(whole, 0) AS whole, CASE WHEN month = '2001-08' THEN coalesce(part, 0) ELSE coalesce(whole, 0) END AS prev FROM u FULL JOIN v USING (month, g, style)),
x AS (SELECT month, g, count(*) FILTER (WHERE now > 0 AND prev > 0) AS styles_both, CAST(sum(CASE WHEN now > 0 AND prev > 0 THEN now ELSE 0 END) AS BIGINT) AS same_units, CAST(sum(CASE WHEN now > 0 AND prev > 0 THEN prev ELSE 0 END) AS BIGINT) AS same_prev_units,
 count(*) FILTER (WHERE now > 0 AND whole <= 0) AS new_styles, CAST(sum(CASE WHEN now > 0 AND whole <= 0 THEN now ELSE 0 END) AS BIGINT) AS new_units, count(*) FILTER (WHERE sold IS NULL) AS stopped_styles FROM w GROUP BY ALL HAVING count(sold) > 0),
same AS (SELECT *, CASE WHEN same_prev_units > 0 THEN round_even((same_units - same_prev_units) / same_prev_units * 100, 1) END AS same_change_pct FROM x)"""


@query("min_month_category", f"WITH {months_sql('category')}, {same_sql('category')} SELECT r.month, r.g AS category, styles, orders, units, prev_units, change_pct, partial, styles_both, same_units, same_prev_units, same_change_pct, new_styles, new_units, stopped_styles FROM r JOIN same ON r.month = same.month AND r.g = same.g")
def min_month_category(spark, sf):
    frame = sales(spark, sf)
    rows = analysis.months_by_group(frame, TODAY, "category")
    return rows.join(analysis.same_styles(frame, TODAY, "category"), ["month", "category"])


@query("a3_weekly_units", f"SELECT product_sku_code AS sku, CAST(date_trunc('week', order_date) AS DATE) AS week, CAST(sum(qty) AS BIGINT) AS units FROM clean_v WHERE {GROSS_SQL} GROUP BY ALL")
def a3(spark, sf):
    rows = orders.labelled(cleaned(spark, sf)).where("gross")
    return rows.groupBy(F.col("product_sku_code").alias("sku"), cal.monday(F.col("order_date")).alias("week")).agg(F.sum("qty").alias("units"))


@query("a4_actuals", f"SELECT product_sku_code AS sku, CAST(date_trunc('week', order_date) AS DATE) AS week, order_date AS day, CAST(sum(CASE WHEN {GROSS_SQL} THEN qty ELSE 0 END) AS BIGINT) AS gross_units, CAST(sum(CASE WHEN {NET_SQL} THEN qty ELSE 0 END) AS BIGINT) AS net_units FROM clean_v WHERE order_date >= DATE '1995-04-03' GROUP BY ALL")
def a4(spark, sf):
    return analysis.actuals(orders.labelled(cleaned(spark, sf)), date(1995, 4, 3))


@query("a5_daily_units", "SELECT day, CAST(sum(qty) AS BIGINT) AS units FROM sales_v GROUP BY day")
def a5(spark, sf):
    return sales(spark, sf).groupBy("day").agg(F.sum("qty").alias("units"))


_SUM = "CAST(sum(CASE WHEN order_date >= DATE '2001-08-01' - {d} THEN qty ELSE 0 END) AS BIGINT) AS units{n}"


@query(
    "a6_trailing_windows",
    f"""SELECT product_sku_code, {", ".join(_SUM.format(d=n - 1, n=n) for n in (10, 35, 90))},
CASE WHEN sum(CASE WHEN order_date >= DATE '2001-08-01' - 89 THEN qty ELSE 0 END) > 0 THEN round_even(CAST(sum(CASE WHEN order_date >= DATE '2001-08-01' - 89 THEN CAST(total AS DECIMAL(18,2)) END) AS DOUBLE) / sum(CASE WHEN order_date >= DATE '2001-08-01' - 89 THEN qty ELSE 0 END), 2) ELSE 0 END AS price FROM net_v GROUP BY ALL""",
)
def a6(spark, sf):
    return analysis.window_sums(net(spark, sf), TODAY)


@query(
    "a7_top_states",
    f"""WITH x AS (SELECT upper(substr(buyer_state, 1, 1)) || lower(substr(buyer_state, 2)) AS name, {", ".join(_SUM.format(d=n - 1, n=n) for n in (10, 30, 90))},
{", ".join(f"CAST(round_even(coalesce(sum(CASE WHEN order_date >= DATE '2001-08-01' - {n - 1} THEN CAST(total AS DECIMAL(18,2)) END), 0), 0) AS BIGINT) AS revenue{n}" for n in (10, 30, 90))} FROM net_v WHERE order_date >= DATE '2001-08-01' - 89 GROUP BY 1)
SELECT * FROM x ORDER BY units30 DESC, name LIMIT 100""",
)
def a7(spark, sf):
    return analysis.top_places(net(spark, sf), keys.norm_place(F.col("buyer_state")), TODAY)


@query("a8_mode_attribute", "SELECT style, min(channel) AS channel FROM (SELECT style, channel, rank() OVER (PARTITION BY style ORDER BY n DESC) AS r FROM (SELECT style, marketplace AS channel, count(*) AS n FROM sales_v GROUP BY ALL)) WHERE r = 1 GROUP BY style")
def a8(spark, sf):
    return sales(spark, sf).groupBy("style").agg(F.mode("marketplace", True).alias("channel"))


@query("a12_month_group", f"WITH {months_sql('sub_category')} SELECT month, g AS sub_category, styles, orders, units, prev_units, change_pct, partial FROM r")
def a12(spark, sf):
    return analysis.months_by_group(sales(spark, sf), TODAY, "sub_category")


@query("a13_partial_month", f"WITH {months_sql('sub_category')} SELECT month, g AS sub_category, units, prev_units, change_pct FROM r WHERE partial")
def a13(spark, sf):
    return analysis.months_by_group(sales(spark, sf), TODAY, "sub_category").where("partial").select("month", "sub_category", "units", "prev_units", "change_pct")


@query("a14_same_styles", f"WITH {same_sql('sub_category')} SELECT * RENAME (g AS sub_category) FROM same")
def a14(spark, sf):
    return analysis.same_styles(sales(spark, sf), TODAY, "sub_category")


VIEWS["tiered_v"] = """SELECT s.*, coalesce(t.tier, n.now, 'Unclassified') AS tier, coalesce(n.now, 'Unclassified') AS tier_now FROM sales_v s ASOF LEFT JOIN tier_history_v t ON s.style = t.name AND s.day >= t.effective_from
 LEFT JOIN (SELECT name AS n_, max_by(tier, effective_from) AS now FROM tier_history_v GROUP BY name) n ON s.style = n.n_"""


@query("a15_tier_at_sale_months", f"WITH {months_sql('tier', 'tiered_v')}, t AS (SELECT month, 'TOTAL' AS g, CAST(sum(styles) AS BIGINT) AS styles, CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(units) AS BIGINT) AS units, bool_or(partial) AS partial, CAST(sum(prev_units) AS BIGINT) AS prev_units FROM r GROUP BY month) SELECT month, g AS tier, styles, orders, units, prev_units, change_pct, partial FROM r UNION ALL SELECT month, g, styles, orders, units, prev_units, CASE WHEN prev_units > 0 THEN round_even((units - prev_units) / prev_units * 100, 1) END, partial FROM t")
def a15(spark, sf):
    frame = joins.tier_at_sale(sales(spark, sf), view(spark, sf, "tier_history_v"), "style", "day")
    return analysis.with_total(analysis.months_by_group(frame, TODAY, "tier"), "tier")


@query("a16_marketplace_drill_down", f"WITH f AS (SELECT * FROM sales_v WHERE sub_category = 'PROMO'), {months_sql('marketplace', 'f')} SELECT month, g AS marketplace, styles, orders, units, prev_units, change_pct, partial FROM r")
def a16(spark, sf):
    return analysis.months_by_group(sales(spark, sf).where("sub_category = 'PROMO'"), TODAY, "marketplace")


@query(
    "a17_styles_of_cell",
    """WITH f AS (SELECT * FROM sales_v WHERE category = 'Ethnic'), a AS (SELECT style, CAST(sum(qty) AS BIGINT) AS units, count(*) AS orders FROM f WHERE month = '2001-06' GROUP BY style), b AS (SELECT style, CAST(sum(qty) AS BIGINT) AS prev_units FROM f WHERE month = '2001-05' GROUP BY style)
SELECT style, coalesce(units, 0) AS units, coalesce(orders, 0) AS orders, coalesce(prev_units, 0) AS prev_units, CASE WHEN prev_units IS NULL THEN 'new' WHEN units IS NULL THEN 'stopped' ELSE 'both' END AS state FROM a FULL JOIN b USING (style)""",
)
def a17(spark, sf):
    return analysis.styles_of_month(sales(spark, sf).where("category = 'Ethnic'"), "2001-06")


@query("a18_filtered_totals", f"WITH f AS (SELECT * FROM tiered_v WHERE tier_now = 'T1' AND category = 'Western'), {months_sql(chr(39) + 'all' + chr(39), 'f')} SELECT month, styles, orders, units, prev_units, change_pct FROM r")
def a18(spark, sf):
    from ..operators import report

    tiers = joins.current_tier(view(spark, sf, "tier_history_v"))
    styles = view(spark, sf, "attributes_v").join(tiers, "style", "left").fillna("Unclassified", ["tier"])
    frame = report.style_filter(sales(spark, sf), styles, tier="T1", category="Western").withColumn("all", F.lit("all"))
    return analysis.months_by_group(frame, TODAY, "all").select("month", "styles", "orders", "units", "prev_units", "change_pct")


@query("a19_brand_of_style", "WITH b AS (SELECT style, upper(substr(brand_name, 1, 1)) || lower(substr(brand_name, 2)) AS brand, count(*) AS n FROM (SELECT coalesce(CASE WHEN split_part(k, '-', 2) IN ('S', 'M', 'L', 'XL', 'XXL', '2XL') THEN split_part(k, '-', 1) ELSE k END, '') AS style, brand_name FROM (SELECT nullif(regexp_extract(upper(product_sku_code), '^([A-Z0-9]+-[A-Z0-9]+)', 1), '') AS k, brand_name FROM clean_v)) GROUP BY ALL) SELECT style, brand FROM b QUALIFY row_number() OVER (PARTITION BY style ORDER BY n DESC, brand) = 1")
def a19(spark, sf):
    lines = cleaned(spark, sf).select(F.coalesce(keys.design_key(F.col("product_sku_code")), F.lit("")).alias("style"), "brand_name")
    return analysis.brand_of_style(lines)


@query("a21_channel_weeks", "SELECT *, CAST(sum(units) OVER (PARTITION BY marketplace, source) AS BIGINT) AS total FROM (SELECT marketplace, source, chunk_start, CAST(sum(qty) AS BIGINT) AS units FROM sales_v GROUP BY ALL)")
def a21(spark, sf):
    return analysis.channel_weeks(sales(spark, sf))


_LAUNCH = "SELECT DISTINCT CASE WHEN split_part(k, '-', 2) IN ('S') THEN split_part(k, '-', 1) ELSE k END AS style, LAUNCH_DATE AS launch FROM (SELECT regexp_extract(DESIGN_NO, '^([A-Z0-9]+-[A-Z0-9]+)', 1) AS k, LAUNCH_DATE FROM design_master_v)"


@query(
    "a22_style_years",
    f"""WITH l AS (SELECT l.*, coalesce(sub_category, 'Unclassified') AS sub_category FROM ({_LAUNCH}) l LEFT JOIN attributes_v USING (style)), s AS (SELECT DISTINCT sub_category, style, 1 AS sold FROM sales_v WHERE year(day) = 1999), n AS (SELECT DISTINCT sub_category, style, 1 AS new FROM l WHERE year(launch) = 2000)
SELECT sub_category, count(sold) AS sold_last_year, count(new) AS launched, count(*) AS styles FROM s FULL JOIN n USING (sub_category, style) GROUP BY sub_category""",
)
def a22(spark, sf):
    launches = view(spark, sf, "design_master_v").select(keys.design_key(F.col("DESIGN_NO")).alias("style"), F.col("LAUNCH_DATE").alias("launch"))
    launches = joins.with_styles(launches, view(spark, sf, "attributes_v"), ("sub_category",))
    return analysis.style_years(sales(spark, sf), launches, 2000)


@query("a23_styles_by_tier", "SELECT tier, count(*) AS n_styles, string_agg(style, ',' ORDER BY style) AS styles FROM (SELECT name AS style, max_by(tier, effective_from) AS tier FROM tier_history_v GROUP BY name) GROUP BY tier")
def a23(spark, sf):
    return analysis.styles_by_tier(joins.current_tier(view(spark, sf, "tier_history_v")))


@query("a24_month_total", f"SELECT source, order_status, CAST(sum(CASE WHEN {GROSS_SQL} THEN qty ELSE 0 END) AS BIGINT) AS gross, CAST(sum(CASE WHEN {NET_SQL} THEN qty ELSE 0 END) AS BIGINT) AS net, CAST(sum(qty) AS BIGINT) AS all_units FROM clean_v WHERE strftime(order_date, '%Y-%m') = '2001-06' GROUP BY GROUPING SETS ((), (source), (order_status))")
def a24(spark, sf):
    return analysis.month_total(orders.labelled(cleaned(spark, sf)), "2001-06")


@query("a25_distinct_orders", f"SELECT order_status, count(DISTINCT channel_order_id) AS n_orders FROM clean_v WHERE order_date BETWEEN DATE '2001-01-01' AND DATE '2001-06-30' AND product_sku_code LIKE '01%' GROUP BY order_status")
def a25(spark, sf):
    rows = cleaned(spark, sf).where(F.col("order_date").between(F.lit(date(2001, 1, 1)), F.lit(date(2001, 6, 30))) & F.col("product_sku_code").startswith("01"))
    return rows.groupBy("order_status").agg(F.countDistinct("channel_order_id").alias("n_orders"))


@query("a26_filter_options", "SELECT category, string_agg(DISTINCT sub_category, ',' ORDER BY sub_category) AS sub_categories FROM attributes_v GROUP BY category")
def a26(spark, sf):
    return analysis.filter_options(view(spark, sf, "attributes_v"))


@query("j11_previous_period", f"WITH {months_sql('marketplace')} SELECT month, g AS marketplace, units, prev_units FROM r")
def j11(spark, sf):
    return analysis.months_by_group(sales(spark, sf), TODAY, "marketplace").select("month", "marketplace", "units", "prev_units")


@query("j12_stopped_styles", "SELECT DISTINCT style FROM sales_v WHERE month = '2001-05' AND style NOT IN (SELECT style FROM sales_v WHERE month = '2001-06')")
def j12(spark, sf):
    frame = sales(spark, sf)
    return frame.where("month = '2001-05'").select("style").distinct().join(frame.where("month = '2001-06'").select("style").distinct(), "style", "left_anti")


@query(
    "w11_split_by_share",
    """WITH s AS (SELECT style, sku, CAST(sum(qty) AS BIGINT) AS w FROM sales_v GROUP BY ALL), r AS (SELECT *, 1000 * w / sum(w) OVER (PARTITION BY style) AS raw FROM s), f AS (SELECT *, floor(raw) AS fl FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY style ORDER BY round_even(raw - fl, 9) DESC, sku) AS rk, 1000 - sum(fl) OVER (PARTITION BY style) AS rest FROM f)
SELECT style, sku, CAST(fl + CASE WHEN rk <= rest THEN 1 ELSE 0 END AS BIGINT) AS units FROM k""",
)
def w11(spark, sf):
    rows = sales(spark, sf).groupBy("style", "sku").agg(F.sum("qty").alias("w")).withColumn("total", F.lit(1000))
    return analysis.split_by_share(rows, ["style"], "total", "w", "sku").select("style", "sku", "units")


@query("u2_style_sets", "(SELECT style FROM sales_v WHERE month = '2001-05' UNION SELECT style FROM sales_v WHERE month = '2001-04') INTERSECT SELECT style FROM sales_v WHERE month = '2001-07'")
def u2(spark, sf):
    frame = sales(spark, sf)
    of = lambda m: frame.where(F.col("month") == m).select("style")
    return of("2001-05").union(of("2001-04")).intersect(of("2001-07"))
