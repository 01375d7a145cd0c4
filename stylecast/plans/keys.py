"""Queries: scans, filters and column functions on codes and names."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import keys
from ..registry import query
from ..sources import orders
from .base import GROSS_SQL, MARKET_SQL, NET_SQL, cleaned, design_sql, sales
from .fixtures import TODAY, view

_RAW_AGG = "count(*) AS n_lines, CAST(sum(qty) AS BIGINT) AS units"


def _size(df):
    return df.agg(F.count(F.lit(1)).alias("n_lines"), F.sum("qty").alias("units"))


@query("s1_sales_scan", "SELECT product_sku_code, order_date, qty, order_status FROM orders_v WHERE order_date BETWEEN DATE '2000-01-01' AND DATE '2001-08-01'")
def s1(spark, sf):
    rows = view(spark, sf, "orders_v")
    return orders.scan(rows, date(2000, 1, 1), TODAY, ("product_sku_code", "order_date", "qty", "order_status"))


@query("s2_scan_completeness", "SELECT (SELECT count(*) FROM orders_v) AS n_read, (SELECT count(*) FROM lineitem) AS n_source, abs((SELECT count(*) FROM orders_v) - (SELECT count(*) FROM lineitem)) <= 0.005 * (SELECT count(*) FROM lineitem) AS complete")
def s2(spark, sf):
    expected = spark.read.parquet(f"{sf}/lineitem.parquet").agg(F.count(F.lit(1)).alias("n"))
    return orders.complete(view(spark, sf, "orders_v"), expected)


@query("s3_erp_views", "SELECT DESIGN_NAME, SIZE, IN_HOUSE_QTY_WIP, JOB_WORK_QTY_WIP, ALLOCATION_QTY FROM planning_v")
def s3(spark, sf):
    return view(spark, sf, "planning_v").select("DESIGN_NAME", "SIZE", "IN_HOUSE_QTY_WIP", "JOB_WORK_QTY_WIP", "ALLOCATION_QTY")


@query("s4_prefix_columns", "SELECT DESIGN_NO AS DESIGN_NO, DESIGN_GROUP AS MASTER_DESIGN_GROUP, LAUNCH_DATE AS MASTER_LAUNCH_DATE FROM design_master_v")
def s4(spark, sf):
    return orders.prefixed(view(spark, sf, "design_master_v"), "MASTER_", keep=("DESIGN_NO",))


@query("s6_tier_tables", "SELECT h.name AS style, h.tier, h.effective_from FROM tier_history_v h JOIN (SELECT DISTINCT style FROM attributes_v) a ON h.name = a.style")
def s6(spark, sf):
    return orders.tier_tables(view(spark, sf, "attributes_v").withColumnRenamed("style", "name"), view(spark, sf, "tier_history_v"))


@query("s8_attribute_sheet", "SELECT upper(trim(style)) AS style, category, colour FROM attributes_v QUALIFY row_number() OVER (PARTITION BY upper(trim(style)) ORDER BY colour, category) = 1")
def s8(spark, sf):
    rows = view(spark, sf, "attributes_v").withColumn("o", F.concat_ws("|", "colour", "category"))
    return orders.attribute_sheet(rows, "style", "o", ("category", "colour"))


@query("s15_slim_projection", "SELECT style, sku, day, qty, marketplace, source FROM sales_v")
def s15(spark, sf):
    return orders.slim(cleaned(spark, sf)).drop("row_id")


@query("p1_drop_combos", f"SELECT {_RAW_AGG} FROM orders_v WHERE NOT (product_sku_code LIKE '%&%' OR product_sku_code LIKE '%--%' OR listing_sku_code LIKE '%&%')")
def p1(spark, sf):
    return _size(orders.without_combos(view(spark, sf, "orders_v")))


@query("p2_drop_placeholders", f"SELECT {_RAW_AGG} FROM orders_v WHERE NOT regexp_matches(upper(trim(product_sku_code)), '^(INACTIVE|FREEBIE-POUCH|CTA-K)')")
def p2(spark, sf):
    return _size(orders.without_placeholders(view(spark, sf, "orders_v")))


@query("p3_drop_channel", f"SELECT {_RAW_AGG} FROM orders_v WHERE NOT contains(lower(channel_name), 'wishlink')")
def p3(spark, sf):
    return _size(orders.without_channel(view(spark, sf, "orders_v"), "Wishlink"))


@query("p4_clean_lines", f"SELECT {_RAW_AGG}, count(DISTINCT product_sku_code) AS n_skus FROM clean_v")
def p4(spark, sf):
    rows = view(spark, sf, "orders_v")
    twice = rows.unionByName(rows.where(F.col("channel_order_id").like("%7")))
    return orders.clean(twice, TODAY).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("qty").alias("units"), F.countDistinct("product_sku_code").alias("n_skus"))


_CODES = "(SELECT DISTINCT product_sku_code AS code FROM orders_v)"


def _codes(spark, sf):
    return view(spark, sf, "orders_v").select(F.col("product_sku_code").alias("code")).distinct()


@query("p5_design_key", f"SELECT code, {design_sql('code')} AS design FROM {_CODES}")
def p5(spark, sf):
    return _codes(spark, sf).select("code", keys.design_key(F.col("code")).alias("design"))


@query("p6_stock_design", f"SELECT code, coalesce(nullif(regexp_extract(upper(trim(code)), '^([A-Z]+-\\d+-\\d{{2}})$', 1), ''), {design_sql('code')}) AS design FROM (SELECT DISTINCT 'K-' || substr(product_sku_code, 1, 6) AS code FROM orders_v)")
def p6(spark, sf):
    rows = view(spark, sf, "orders_v").select(F.concat(F.lit("K-"), F.substring("product_sku_code", 1, 6)).alias("code")).distinct()
    return rows.select("code", keys.stock_design(F.col("code")).alias("design"))


@query("p7_clean_design_no", f"SELECT DESIGN_NO, coalesce({design_sql('DESIGN_NO')}, DESIGN_NO) AS design FROM design_master_v")
def p7(spark, sf):
    return view(spark, sf, "design_master_v").select("DESIGN_NO", keys.clean_design_no(F.col("DESIGN_NO")).alias("design"))


@query("p8_design_and_size", f"SELECT code, split_part(upper(code), '-', 1) || CASE WHEN contains(code, '-') THEN '-' || split_part(upper(code), '-', 2) ELSE '' END AS design, trim(split_part(upper(code), '-', 3)) AS size FROM {_CODES}")
def p8(spark, sf):
    design, size = keys.design_and_size(F.col("code"))
    return _codes(spark, sf).select("code", design.alias("design"), size.alias("size"))


@query(
    "p9_sku_key",
    f"""SELECT code, regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(trim(code)), '[-_\\s]+', '-', 'g'), '^(.*-(?:XXS|XS|S|M|L|XL|XXL|2XL|XXXL|3XL|4XL|5XL|6XL|7XL|8XL))-[A-Z]$', '\\1'), '^(.+)-2XL$', '\\1-XXL'), '^(.+)-3XL$', '\\1-XXXL') AS sku FROM {_CODES}""",
)
def p9(spark, sf):
    return _codes(spark, sf).select("code", keys.sku_key(F.col("code"), keys.design_key(F.col("code"))).alias("sku"))


@query("p10_size_of_sku", f"SELECT code, coalesce(nullif(ltrim(substr(code, length(d) + 1), '-'), ''), 'UNKNOWN') AS size FROM (SELECT code, {design_sql('code')} AS d FROM {_CODES}) WHERE d IS NOT NULL")
def p10(spark, sf):
    rows = _codes(spark, sf).withColumn("d", keys.design_key(F.col("code"))).where("d IS NOT NULL")
    return rows.select("code", keys.size_of(F.col("code"), F.col("d")).alias("size"))


@query("p11_marketplace", f"SELECT {MARKET_SQL} AS marketplace, source, count(*) AS n_lines FROM orders_v GROUP BY ALL")
def p11(spark, sf):
    return view(spark, sf, "orders_v").groupBy(keys.marketplace(F.col("channel_name"), F.col("source")).alias("marketplace"), "source").agg(F.count(F.lit(1)).alias("n_lines"))


@query("p12_place", "SELECT DISTINCT buyer_city, CASE split_part(buyer_city, ' ', 1) WHEN 'MIDDLE' THEN 'Middle East' ELSE upper(substr(split_part(buyer_city, ' ', 1), 1, 1)) || lower(substr(split_part(buyer_city, ' ', 1), 2)) END AS city FROM orders_v")
def p12(spark, sf):
    return view(spark, sf, "orders_v").select("buyer_city", keys.norm_place(F.col("buyer_city")).alias("city")).distinct()


@query("p13_warehouse", "SELECT DISTINCT warehouse_name, CASE WHEN lower(w) LIKE 'default%' OR NOT regexp_matches(w, '[A-Za-z]') THEN NULL ELSE w END AS warehouse FROM (SELECT warehouse_name, regexp_replace(trim(warehouse_name), '\\s+', ' ', 'g') AS w FROM orders_v)")
def p13(spark, sf):
    return view(spark, sf, "orders_v").select("warehouse_name", keys.norm_warehouse(F.col("warehouse_name")).alias("warehouse")).distinct()


@query("p14_status_labels", f"SELECT order_status, {GROSS_SQL} AS gross, {NET_SQL} AS net, contains(lower(order_status), 'return') AS returned, count(*) AS n_lines FROM orders_v GROUP BY ALL")
def p14(spark, sf):
    return orders.labelled(view(spark, sf, "orders_v")).groupBy("order_status", "gross", "net", "returned").agg(F.count(F.lit(1)).alias("n_lines"))


@query("p15_brand", "SELECT DISTINCT brand_name, upper(substr(brand_name, 1, 1)) || lower(substr(brand_name, 2)) AS brand FROM orders_v")
def p15(spark, sf):
    return view(spark, sf, "orders_v").select("brand_name", keys.norm_brand(F.col("brand_name")).alias("brand")).distinct()


_SPELLED = "SELECT product_sku_code, CASE WHEN qty % 3 = 0 THEN category_name WHEN qty % 3 = 1 THEN lower(category_name) ELSE upper(substr(category_name, 1, 1)) || lower(substr(category_name, 2)) END AS spelling FROM orders_v"


@query(
    "p16_unify_case",
    f"""WITH x AS ({_SPELLED}), s AS (SELECT lower(spelling) AS k, spelling AS v, count(*) AS n FROM x GROUP BY ALL),
b AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN v <> upper(v) AND v <> lower(v) THEN 0 ELSE 1 END, n DESC, v) AS r FROM s)
SELECT spelling, b.v AS name, count(*) AS n_lines FROM x JOIN b ON lower(spelling) = k AND r = 1 GROUP BY ALL""",
)
def p16(spark, sf):
    first = F.concat(F.upper(F.substring("category_name", 1, 1)), F.lower(F.substring("category_name", 2, 99)))
    rows = view(spark, sf, "orders_v").select(F.when(F.col("qty") % 3 == 0, F.col("category_name")).when(F.col("qty") % 3 == 1, F.lower("category_name")).otherwise(first).alias("spelling"))
    return keys.unified_case(rows, "spelling", "name").groupBy("spelling", "name").agg(F.count(F.lit(1)).alias("n_lines"))


@query("p17_attribute_names", "SELECT DISTINCT neck, upper(substr(neck, 1, 1)) || substr(neck, 2) || ' Neck' AS name, fabric FROM attributes_v")
def p17(spark, sf):
    return view(spark, sf, "attributes_v").select("neck", keys.clean_neck(F.col("neck")).alias("name"), keys.clean_attribute(F.col("fabric")).alias("fabric")).distinct()


@query("p18_search_page", "SELECT style, sub_category FROM attributes_v WHERE contains(style, '-0') AND category = 'Ethnic' AND contains(lower(style), '01') ORDER BY style LIMIT 20 OFFSET 5")
def p18(spark, sf):
    from ..operators import report

    return report.page(report.searched(view(spark, sf, "attributes_v").select("style", "category", "sub_category"), "01", category="Ethnic"), ["style"], 20, 5).select("style", "sub_category")


@query("p19_style_filter", "SELECT count(*) AS n_lines, CAST(sum(qty) AS BIGINT) AS units, count(DISTINCT style) AS n_styles FROM sales_v WHERE style IN (SELECT style FROM attributes_v WHERE category = 'Western' AND sub_category = 'PROMO')")
def p19(spark, sf):
    from ..operators import report

    kept = report.style_filter(sales(spark, sf).drop("category", "sub_category"), view(spark, sf, "attributes_v"), category="Western", sub_category="PROMO", style="")
    return kept.agg(F.count(F.lit(1)).alias("n_lines"), F.sum("qty").alias("units"), F.countDistinct("style").alias("n_styles"))


@query("p20_tier_order", "SELECT tier, row_number() OVER (ORDER BY CAST(substr(tier, 2) AS INT)) AS place FROM (SELECT DISTINCT tier FROM tier_history_v)")
def p20(spark, sf):
    from pyspark.sql import Window

    tiers = view(spark, sf, "tier_history_v").select("tier").distinct()
    return tiers.select("tier", F.row_number().over(Window.orderBy(keys.tier_order(F.col("tier")))).alias("place"))


@query("p21_sales_base", "SELECT month, marketplace, source, count(*) AS n_lines, CAST(sum(qty) AS BIGINT) AS units, count(DISTINCT style) AS n_styles FROM sales_v GROUP BY ALL")
def p21(spark, sf):
    return orders.sales_base(cleaned(spark, sf)).groupBy("month", "marketplace", "source").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("qty").alias("units"), F.countDistinct("style").alias("n_styles"))


@query("p22_null_cleaners", "SELECT DISTINCT category_name, CASE WHEN category_name = 'MACHINERY' THEN '' ELSE category_name END AS token FROM orders_v")
def p22(spark, sf):
    rows = view(spark, sf, "orders_v").select("category_name").distinct()
    return rows.select("category_name", keys.clean_token(F.when(F.col("category_name") == "MACHINERY", F.lit(" n/a ")).otherwise(F.col("category_name"))).alias("token"))
