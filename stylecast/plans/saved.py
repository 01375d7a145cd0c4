"""Queries: tables that are saved and read again, made from the shared tables."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from ..registry import query
from ..sources import orders, snapshots
from ..sources.shared import new_path
from .base import cleaned
from .fixtures import TODAY, view
from .panel import LAST, weekly

_CALENDAR = """WITH c AS (SELECT concat(o_orderpriority, ' of ', CAST(year(o_orderdate) AS VARCHAR), CASE WHEN o_orderpriority LIKE '1%' THEN ' (Festival)' ELSE '' END) AS name, CAST(min(o_orderdate) AS DATE) AS start_date, CAST(max(o_orderdate) AS DATE) AS end_date, o_orderpriority AS p FROM orders GROUP BY o_orderpriority, year(o_orderdate))
SELECT name, start_date, end_date, CASE WHEN name LIKE '%(Festival)' THEN 'festival' ELSE 'sale' END AS category FROM c WHERE p NOT LIKE '3%'"""


@query("s7_calendar_csv", _CALENDAR)
def s7(spark, sf):
    """First and last order of each priority and year as a calendar, with blanks around names and some ends missing, saved as day-month-year."""
    priority, year = F.col("o_orderpriority"), F.year("o_orderdate").alias("year")
    spans = spark.read.parquet(f"{sf}/orders.parquet").groupBy(priority, year).agg(F.min("o_orderdate").alias("s"), F.max("o_orderdate").alias("e"))
    name = F.concat(F.lit(" "), priority, F.lit(" of "), F.col("year").cast("string"), F.when(priority.like("1%"), F.lit(" (Festival) ")).otherwise(F.lit("")))
    path = new_path(spark, "calendar")
    spans.select(name.alias("Name"), F.date_format("s", "dd-MM-yyyy").alias("Start"), F.when(~priority.like("3%"), F.date_format("e", "dd-MM-yyyy")).alias("End")).write.csv(path, header=True)
    return orders.calendar_csv(spark, path)


@query("s9_csv_snapshot", "SELECT product_sku_code, channel_name, order_date, qty FROM clean_v")
def s9(spark, sf):
    """The cleaned lines as an offline snapshot, of which four columns are read."""
    rows, path = cleaned(spark, sf), new_path(spark, "lines")
    rows.write.csv(path, header=True, quote='"', escape='"')
    return snapshots.csv_snapshot(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), ("product_sku_code", "channel_name", "order_date", "qty"))


@query("s10_forecast_snapshot", "SELECT id, CAST((week - DATE '2001-07-30') / 7 AS INT) AS step, CAST(y AS DOUBLE) AS qty FROM weekly_v WHERE week < DATE '2001-07-30'")
def s10(spark, sf):
    """Of four saved tables (two versions, two days, two levels), of which one is saved twice, one is read."""
    rows = weekly(spark, sf).where(F.col("week") < F.lit(LAST)).select("id", (F.datediff("week", F.lit(LAST)) / 7).cast("int").alias("step"), F.col("y").cast("double").alias("qty"))
    path = new_path(spark, "forecast")
    for level, version, day, plus in (("style", 3, TODAY, 1), ("style", 2, TODAY, 2), ("style", 3, TODAY - timedelta(1), 3), ("sku", 3, TODAY, 4), ("style", 3, TODAY, 0)):
        snapshots.save_forecast(rows.withColumn("qty", F.col("qty") + plus), path, level, version, day)
    return snapshots.load_forecast(spark, path, "style", 3, TODAY)


_STOCK = "SELECT concat(DESIGN_NAME, '-', SIZE) AS sku, DESIGN_NAME AS style, CAST(PENDING_QTY_PIECES AS BIGINT) AS stock, CAST(IN_HOUSE_QTY_WIP AS BIGINT) AS wip"


@query("s13_daily_stock", f"{_STOCK}, DATE '2001-07-31' AS day FROM planning_v UNION ALL {_STOCK.replace('PENDING_QTY_PIECES AS', '2 * PENDING_QTY_PIECES AS')}, DATE '2001-08-01' FROM planning_v")
def s13(spark, sf):
    """Two days of stock, one of them saved twice; a day whose feed failed isn't saved."""
    name = F.col("DESIGN_NAME")
    rows = view(spark, sf, "planning_v").select(F.concat(name, F.lit("-"), "SIZE").alias("sku"), name.alias("style"), F.col("PENDING_QTY_PIECES").cast("long").alias("stock"), F.col("IN_HOUSE_QTY_WIP").cast("long").alias("wip"))
    path = new_path(spark, "stock")
    for day, times, complete in ((TODAY, 5, True), (TODAY - timedelta(1), 1, True), (TODAY, 2, True), (date(2001, 8, 2), 1, False)):
        snapshots.save_stock(rows.withColumn("stock", F.col("stock") * times), path, day, complete)
    return snapshots.load_stock(spark, path)
