"""The retail model over the shared star schema: views as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: The last order date of the shared tables; taken as now.
TODAY = date(2001, 8, 1)

_DESIGNS = """d AS (
  SELECT p_partkey, p_type, p_name, p_size, CAST(substr(p_brand, 7) AS INT) AS bno,
         CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3
                     WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 ELSE 6 END AS tno,
         concat(lpad(substr(p_brand, 7), 3, '0'), '-0',
                CASE p_type WHEN 'ECONOMY' THEN '1' WHEN 'LARGE' THEN '2' WHEN 'MEDIUM' THEN '3'
                            WHEN 'PROMO' THEN '4' WHEN 'SMALL' THEN '5' ELSE '6' END) AS dn,
         CASE WHEN p_partkey % 37 = 0 THEN '2XL'
              ELSE CASE p_size % 6 WHEN 0 THEN 'XS' WHEN 1 THEN 'S' WHEN 2 THEN 'M'
                                   WHEN 3 THEN 'L' WHEN 4 THEN 'XL' ELSE 'XXL' END END AS sz
  FROM part)"""

#: Columns of orders_v as the view has them.
_SKU = """CASE WHEN p_partkey % 97 = 0 THEN 'INACTIVE-04'
            WHEN p_partkey % 89 = 0 THEN concat(dn, '-', sz, ' & K-9301-34')
            WHEN p_partkey % 43 = 0 THEN concat(dn, '-', sz, '-A')
            WHEN p_partkey % 41 = 0 THEN concat(dn, '_', sz)
            ELSE concat(dn, '-', sz) END"""
_STATUS = """CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'Return Received'
            WHEN l_returnflag = 'R' THEN 'RTO In Transit'
            WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'Delivered'
            WHEN l_returnflag = 'A' THEN 'Shipped'
            WHEN l_linestatus = 'F' THEN 'Manifested'
            WHEN o_orderstatus = 'P' THEN 'Cancelled'
            ELSE 'In Transit' END"""
_CHANNEL = """CASE o_orderpriority WHEN '1-URGENT' THEN 'Entity A - Amazon FBA' WHEN '2-HIGH' THEN 'Entity B - Flipkart'
            WHEN '3-MEDIUM' THEN 'Entity A - Myntra' WHEN '4-NOT SPECIFIED' THEN 'Entity C - Wishlink'
            ELSE 'mokosh.in' END"""
_SOURCE = "CASE WHEN o_orderpriority = '5-LOW' THEN 'WEBSITE' ELSE 'OMS' END"

VIEWS = {
    "orders_v": """WITH d AS (
  SELECT p_partkey, p_brand, p_type, p_name,
         concat(lpad(substr(p_brand, 7), 3, '0'), '-0',
                CASE p_type WHEN 'ECONOMY' THEN '1' WHEN 'LARGE' THEN '2' WHEN 'MEDIUM' THEN '3'
                            WHEN 'PROMO' THEN '4' WHEN 'SMALL' THEN '5' ELSE '6' END) AS dn,
         CASE WHEN p_partkey % 37 = 0 THEN '2XL'
              ELSE CASE p_size % 6 WHEN 0 THEN 'XS' WHEN 1 THEN 'S' WHEN 2 THEN 'M'
                                   WHEN 3 THEN 'L' WHEN 4 THEN 'XL' ELSE 'XXL' END END AS sz
  FROM part)
SELECT CASE WHEN p_partkey % 97 = 0 THEN 'INACTIVE-04'
            WHEN p_partkey % 89 = 0 THEN concat(dn, '-', sz, ' & K-9301-34')
            WHEN p_partkey % 43 = 0 THEN concat(dn, '-', sz, '-A')
            WHEN p_partkey % 41 = 0 THEN concat(dn, '_', sz)
            ELSE concat(dn, '-', sz) END                      AS product_sku_code,
       concat('LST-', CAST(l_partkey AS STRING))              AS listing_sku_code,
       CAST(l_quantity AS INT)                                AS qty,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'Return Received'
            WHEN l_returnflag = 'R' THEN 'RTO In Transit'
            WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'Delivered'
            WHEN l_returnflag = 'A' THEN 'Shipped'
            WHEN l_linestatus = 'F' THEN 'Manifested'
            WHEN o_orderstatus = 'P' THEN 'Cancelled'
            ELSE 'In Transit' END                             AS order_status,
       CAST(o_orderdate AS DATE)                              AS order_date,
       l_extendedprice                                        AS total,
       n_name AS buyer_state, concat(r_name, ' ', CAST(c_custkey % 40 AS STRING)) AS buyer_city,
       concat('FC', CAST(s_nationkey AS STRING))              AS warehouse_name,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Entity A - Amazon FBA' WHEN '2-HIGH' THEN 'Entity B - Flipkart'
            WHEN '3-MEDIUM' THEN 'Entity A - Myntra' WHEN '4-NOT SPECIFIED' THEN 'Entity C - Wishlink'
            ELSE 'mokosh.in' END                              AS channel_name,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'WEBSITE' ELSE 'OMS' END AS source,
       p_brand AS brand_name, c_mktsegment AS category_name,
       CAST(l_orderkey AS STRING)                             AS channel_order_id,
       concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS channel_sub_order_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN d ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey JOIN supplier ON l_suppkey = s_suppkey""",
    "design_master_v": """WITH {designs}
SELECT DISTINCT CASE WHEN tno = 6 AND bno % 5 = 0 THEN concat(dn, '-XS-A') ELSE dn END AS DESIGN_NO,
       concat('G', CAST(bno AS STRING)) AS DESIGN_GROUP,
       CASE WHEN bno % 11 = 0 THEN DATE '1900-01-01'
            ELSE DATE '1995-01-01' + CAST((bno * 37 + tno * 101) % 2100 AS INT) END AS LAUNCH_DATE
FROM d""",
    "planning_v": """WITH {designs}
SELECT dn AS DESIGN_NAME, sz AS SIZE,
       CAST(sum(p_partkey % 7) AS DOUBLE) AS IN_HOUSE_QTY_WIP, CAST(sum(p_partkey % 5) AS DOUBLE) AS JOB_WORK_QTY_WIP,
       CAST(sum(p_partkey % 9) AS DOUBLE) / 2 AS ALLOCATION_QTY, CAST(sum(p_partkey % 23) AS DOUBLE) AS PENDING_QTY_PIECES
FROM d GROUP BY dn, sz""",
    "attributes_v": """WITH {designs}
SELECT DISTINCT dn AS style, CASE WHEN tno <= 3 THEN 'Ethnic' ELSE 'Western' END AS category, p_type AS sub_category,
       concat('C', CAST(bno % 8 AS STRING)) AS colour, concat('F', CAST((bno + tno) % 5 AS STRING)) AS fabric,
       concat('N', CAST(tno % 3 AS STRING)) AS neck, concat('E', CAST((bno * tno) % 4 AS STRING)) AS embroidery
FROM d""",
    "tier_history_v": """WITH {designs}
SELECT DISTINCT dn AS name, make_date(y, 1, 1) AS effective_from,
       CASE WHEN (bno + tno + y) % 9 = 0 THEN 'T11' ELSE concat('T', CAST((bno + tno + y) % 4 AS STRING)) END AS tier
FROM d CROSS JOIN (VALUES (1997), (1999), (2001)) AS t(y) WHERE bno % 13 <> 0""",
    "bom_v": """WITH {designs}
SELECT DISTINCT dn AS design, upper(p_name) AS token FROM d""",
    "events_calendar_v": """SELECT name, make_date(y, m1, d1) AS start_date, make_date(y, m2, d2) AS end_date,
       CASE WHEN name LIKE '%(Festival)' THEN 'festival' ELSE 'sale' END AS category
FROM (VALUES ('Diwali (Festival)', 10, 20, 10, 24), ('Raksha Bandhan (Festival)', 8, 9, 8, 9),
             ('Navratri (Festival)', 9, 25, 10, 3), ('Big Days (Flipkart)', 9, 23, 10, 1),
             ('Republic Sale (Amazon)', 1, 13, 1, 19), ('Summer Sale (Myntra)', 6, 1, 6, 10)) AS e(name, m1, d1, m2, d2)
CROSS JOIN (VALUES (1995), (1996), (1997), (1998), (1999), (2000), (2001), (2002)) AS t(y)""",
    "lots_v": """SELECT CASE WHEN k = 1 THEN 'Cut to Pack Issue' ELSE 'Cut To Pack Dispatch' END AS PROCESS,
       concat('LOT', CAST(l_orderkey AS STRING)) AS LOT_NO, CAST(l_partkey AS STRING) AS DESIGN_NO,
       s_name AS PARTY_NAME, CAST(CASE WHEN k = 1 THEN o_orderdate ELSE l_shipdate END AS DATE) AS VOUCHER_DATE,
       CAST(l_quantity AS INT) AS ISSUE_QTY
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
CROSS JOIN (VALUES (1), (2)) AS t(k) WHERE k = 1 OR l_linestatus = 'F'""",
}
VIEWS = {name: sql.replace("{designs}", _DESIGNS) for name, sql in VIEWS.items()}


def sql_with(query: str) -> str:
    """DuckDB SQL: the query with the views it names as common table expressions."""
    used = [v for v in VIEWS if v in query]
    while more := [v for v in VIEWS if v not in used and any(v in VIEWS[u] for u in used)]:
        used += more
    used.sort(key=list(VIEWS).index)
    return "WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in used) + (", " if query.lstrip().startswith("WITH ") else " ") + query.lstrip().removeprefix("WITH ") if used else query


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the tables in sf_dir."""
    for t in TABLES:
        if t in VIEWS[name]:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(VIEWS[name])


#: Order lines that a task joins and sorts: their wide rows take some 150 MB.
LINES_A_TASK = 300_000


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of orders_v and l_orderkey, by which they are dealt out.

    The view joins line by line in the order of its text, which moves all lines once for each
    large table.  Here customers are joined to orders, and parts and suppliers to the few columns of
    a line that are read, before lines and orders meet; names come last, when rows move no more.
    """
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines = table("lineitem")
    tasks = max(-(-lines.count() // LINES_A_TASK), spark.sparkContext.defaultParallelism)
    table("part").createOrReplaceTempView("part")
    designs = VIEWS["orders_v"].split("\nSELECT")[0]  # the view's own, by part
    skus = spark.sql(f"{designs} SELECT p_partkey, p_brand, {_SKU} AS product_sku_code FROM d")
    lines = lines.selectExpr("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "CAST(l_quantity AS INT) AS qty", "l_extendedprice AS total", "l_returnflag", "l_linestatus")
    lines = lines.join(skus, F.col("l_partkey") == F.col("p_partkey")).join(table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).drop("p_partkey", "l_suppkey", "s_suppkey")
    sold = table("orders").selectExpr("o_orderkey", "o_custkey", "o_orderstatus", "CAST(o_orderdate AS DATE) AS order_date", "o_orderpriority")
    sold = sold.join(table("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).withColumn("c_custkey", F.col("c_custkey") % 40)
    places = table("nation").join(F.broadcast(table("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")  # a row a nation
    rows = lines.repartition(tasks, "l_orderkey").join(sold.drop("o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.selectExpr(
        "product_sku_code", "concat('LST-', CAST(l_partkey AS STRING)) AS listing_sku_code", "qty", f"{_STATUS} AS order_status", "order_date", "total", "n_name AS buyer_state",
        "concat(r_name, ' ', CAST(c_custkey AS STRING)) AS buyer_city", "concat('FC', CAST(s_nationkey AS STRING)) AS warehouse_name", f"{_CHANNEL} AS channel_name", f"{_SOURCE} AS source", "p_brand AS brand_name",
        "c_mktsegment AS category_name", "CAST(l_orderkey AS STRING) AS channel_order_id", "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS channel_sub_order_id", "l_orderkey",
    )
