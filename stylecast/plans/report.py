"""Queries: reports and saved state."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..config import SIZE_ORDER
from ..functions import keys
from ..operators import report, state
from ..registry import query
from ..streaming import orders as stream
from .base import chunk_sql, sales
from .fixtures import TODAY, VIEWS, view
from .planning import naive

_END = "CASE WHEN day({0}) = 24 THEN last_day({0}) ELSE CAST({0} + CASE WHEN day({0}) = 1 THEN 6 ELSE 7 END AS DATE) END"
VIEWS["fc_style_v"] = "SELECT style AS id, week, sum(n.qty) AS qty FROM naive_v n JOIN (SELECT DISTINCT sku, style FROM sales_v) s ON n.id = s.sku GROUP BY ALL"
VIEWS["bucket_v"] = f"SELECT id, chunk_start, CAST(round_even(round_even(sum(qty / 7), 6), 0) AS BIGINT) AS qty FROM (SELECT id, qty, {chunk_sql('CAST(week + k AS DATE)')} AS chunk_start FROM fc_style_v, (SELECT CAST(unnest(range(7)) AS INT) AS k)) GROUP BY ALL"
VIEWS["cell_v"] = f"""SELECT *, CASE WHEN chunk_end < DATE '2001-08-01' THEN 'completed' WHEN chunk_start <= DATE '2001-08-01' THEN 'running' ELSE 'upcoming' END AS state FROM (SELECT id, chunk_start, {_END.format('chunk_start')} AS chunk_end, coalesce(units, 0) AS actual, coalesce(qty, 0) AS forecast FROM
 (SELECT style AS id, chunk_start, CAST(sum(qty) AS BIGINT) AS units FROM sales_v WHERE day >= DATE '2001-06-01' GROUP BY ALL) a FULL JOIN bucket_v USING (id, chunk_start))"""


def weekly_forecast(spark, sf):
    styles = sales(spark, sf).select("sku", "style").distinct()
    return naive(spark, sf).withColumnRenamed("id", "sku").join(styles, "sku").groupBy(F.col("style").alias("id"), "week").agg(F.sum("qty").alias("qty"))


def report_cells(spark, sf):
    actual = sales(spark, sf).where(F.col("day") >= "2001-06-01").groupBy(F.col("style").alias("id"), "chunk_start").agg(F.sum("qty").alias("units"))
    return report.cells(actual, report.rebucketed(weekly_forecast(spark, sf)), TODAY)


@query("g1_g2_weekly_series", "SELECT id, week, round_even(qty, 6) AS qty FROM fc_style_v")
def g1(spark, sf):
    return weekly_forecast(spark, sf).withColumn("qty", F.bround("qty", 6))


@query("g3_report_weeks", "SELECT * FROM bucket_v")
def g3(spark, sf):
    return report.rebucketed(weekly_forecast(spark, sf))


@query("g4_running_week", "SELECT style AS id, CAST(sum(CASE WHEN day BETWEEN DATE '2001-07-30' AND DATE '2001-08-01' THEN qty ELSE 0 END) AS BIGINT) AS so_far, sum(CASE WHEN day BETWEEN DATE '2001-07-26' AND DATE '2001-08-01' THEN qty ELSE 0 END) / 7 AS pace, sum(CASE WHEN day BETWEEN DATE '2001-07-30' AND DATE '2001-08-01' THEN qty ELSE 0 END) + sum(CASE WHEN day BETWEEN DATE '2001-07-26' AND DATE '2001-08-01' THEN qty ELSE 0 END) / 7 * 4 AS expected FROM sales_v GROUP BY style")
def g4(spark, sf):
    frame = sales(spark, sf).select(F.col("style").alias("id"), "day", "qty")
    return stream.running_week(frame, frame.select("id", "qty").limit(0), TODAY).drop("forecast")


@query("g5_report_cells", "SELECT * FROM cell_v")
def g5(spark, sf):
    return report_cells(spark, sf)


@query("g5_report_totals", "SELECT coalesce(id, 'TOTAL') AS id, coalesce(month, 'TOTAL') AS month, CAST(sum(actual) AS BIGINT) AS actual, CAST(sum(forecast) AS BIGINT) AS forecast FROM (SELECT *, strftime(chunk_start, '%Y-%m') AS month FROM cell_v) GROUP BY GROUPING SETS ((id, month), (month), (id), ())")
def g5_totals(spark, sf):
    return report.totals(report_cells(spark, sf))


@query("g6_period_accuracy", "SELECT id, chunk_start, CASE WHEN state = 'completed' AND actual > 0 THEN greatest(0.0, least(1.0, 1 - abs(actual - 30) / actual)) END AS accuracy FROM cell_v")
def g6(spark, sf):
    return report_cells(spark, sf).select("id", "chunk_start", report.accuracy(F.col("actual"), F.lit(30), F.col("state") == "completed").alias("accuracy"))


@query("g7_tier_totals", "SELECT month, CAST(sum(actual) AS BIGINT) AS actual, CAST(sum(forecast) AS BIGINT) AS forecast FROM (SELECT *, strftime(chunk_start, '%Y-%m') AS month FROM cell_v) WHERE id IN (SELECT name FROM (SELECT name, max_by(tier, effective_from) AS tier FROM tier_history_v GROUP BY name) WHERE tier = 'T1') GROUP BY month")
def g7(spark, sf):
    from ..operators import joins

    tiers = joins.current_tier(view(spark, sf, "tier_history_v"))
    kept = report.style_filter(report_cells(spark, sf), tiers, key="id", tier="T1")
    return report.totals(kept).where("id = 'TOTAL' AND month <> 'TOTAL'").drop("id")


@query("g8_frozen_view", "SELECT id, chunk_start, chunk_end, actual, state, CASE WHEN id LIKE '00%' THEN 7 WHEN state = 'completed' THEN forecast ELSE 0 END AS forecast, id NOT LIKE '00%' AND state <> 'completed' AS not_frozen FROM cell_v")
def g8(spark, sf):
    rows = report_cells(spark, sf)
    return report.frozen_view(rows, rows.where("id LIKE '00%'").select("id", "chunk_start", F.lit(7).cast("long").alias("frozen")))


_S14 = ("2001-06-01", "2001-06-08", "2001-06-16", "2001-06-24")


@query("s14_flat_export", "SELECT id, " + ", ".join(f"CAST(sum(CASE WHEN chunk_start = DATE '{d}' THEN actual ELSE 0 END) AS BIGINT) AS \"{d}\"" for d in _S14) + " FROM cell_v GROUP BY id")
def s14(spark, sf):
    return report.wide(report_cells(spark, sf), "actual", list(_S14))


@query("l1_report_order", "SELECT id, CAST(sum(actual + forecast) AS BIGINT) AS volume FROM cell_v GROUP BY id ORDER BY volume DESC, id LIMIT 20 OFFSET 10")
def l1(spark, sf):
    rows = report_cells(spark, sf).groupBy("id").agg(F.sum(F.col("actual") + F.col("forecast")).alias("volume"))
    return report.page(rows, [F.desc("volume"), "id"], 20, 10)


@query("l2_size_order", f"SELECT style, size, row_number() OVER (PARTITION BY style ORDER BY list_position([{', '.join(repr(s) for s in SIZE_ORDER)}], size)) AS place FROM (SELECT DISTINCT style, CASE size WHEN '2XL' THEN 'XXL' ELSE size END AS size FROM (SELECT style, split_part(replace(sku, '_', '-'), '-', 3) AS size FROM sales_v) WHERE list_contains([{', '.join(repr(s) for s in SIZE_ORDER)}], size))")
def l2(spark, sf):
    from pyspark.sql import Window

    size = F.element_at(F.split(keys.sku_key(F.col("sku"), F.col("style")), "-"), 3)
    rows = sales(spark, sf).select("style", size.alias("size")).where(F.col("size").isin(*SIZE_ORDER)).distinct()
    order = F.array_position(F.array(*map(F.lit, SIZE_ORDER)), F.col("size"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("style").orderBy(order)))


# the state steps run on the first weeks of the naive forecast, frozen on two days
_D1, _D2 = date(2001, 8, 1), date(2001, 8, 20)
VIEWS["val_v"] = "SELECT id AS key, week AS start, round_even(qty, 6) AS qty FROM fc_style_v WHERE week < DATE '2001-09-17'"


def _values(spark, sf):
    return weekly_forecast(spark, sf).where(F.col("week") < "2001-09-17").select(F.col("id").alias("key"), F.col("week").alias("start"), F.bround("qty", 6).alias("qty"))


@query(
    "g10_freeze",
    """SELECT key, start, CASE WHEN start + 6 < DATE '2001-08-20' THEN qty ELSE qty + 1 END AS qty, CASE WHEN start + 6 < DATE '2001-08-20' THEN 'locked' ELSE 'open' END AS status, DATE '2001-08-20' AS updated_on, CASE WHEN start <= DATE '2001-08-20' THEN qty END AS start_qty FROM val_v""",
)
def g10(spark, sf):
    values = _values(spark, sf)
    periods = values.select("start").distinct().withColumn("end", F.date_add("start", 6))
    once = state.freeze(spark.createDataFrame([], state.FROZEN), values, periods, _D1)
    return state.freeze(once, values.withColumn("qty", F.col("qty") + 1), periods, _D2)


@query("g11_rolling_snapshot", "SELECT key, DATE '2001-08-01' AS as_of, start, qty FROM val_v WHERE start < DATE '2001-08-20' UNION ALL SELECT key, DATE '2001-08-20', start, qty + 1 FROM val_v WHERE start >= DATE '2001-08-20'")
def g11(spark, sf):
    values = _values(spark, sf)
    empty = spark.createDataFrame([], "key string, as_of date, start date, qty double")
    once = state.rolling_snapshot(empty, values.where(F.col("start") < "2001-08-20"), date(2001, 7, 30), _D1)
    return state.rolling_snapshot(once, values.withColumn("qty", F.col("qty") + 1), date(2001, 8, 6), _D2)


@query("g12_frozen_values", "SELECT key, start, qty + 1 AS qty, DATE '2001-08-20' AS since FROM val_v")
def g12(spark, sf):
    values = _values(spark, sf)
    two = values.withColumn("as_of", F.lit(_D1)).unionByName(values.withColumn("qty", F.col("qty") + 1).withColumn("as_of", F.lit(_D2)))
    return state.frozen_values(two, date(2001, 8, 31))


@query("g13_refreeze", "SELECT key, DATE '2001-08-01' AS as_of, start, qty FROM val_v WHERE start < DATE '2001-08-27'")
def g13(spark, sf):
    return state.refrozen(_values(spark, sf).select("key", F.lit(_D1).alias("as_of"), "start", "qty"), date(2001, 8, 27))


@query("g14_fallback_chain", "SELECT key, start, CASE WHEN key LIKE '00%' THEN qty WHEN key LIKE '01%' THEN 5 ELSE 3 END AS qty FROM val_v")
def g14(spark, sf):
    v = _values(spark, sf)
    five, three = v.where("key LIKE '01%' OR key LIKE '00%'").withColumn("qty", F.lit(5.0)), v.withColumn("qty", F.lit(3.0))
    return state.fallback(v.where("key LIKE '00%'"), five, v.limit(0), three)


_LOG = "style string, week_start date, week_end date, forecast long, available long, suggestion long, status string, captured_on date, updated_on date, actual long"
VIEWS["made_v"] = "SELECT style, DATE '2001-07-02' AS week_start, DATE '2001-07-08' AS week_end, CAST(sum(qty) AS BIGINT) AS forecast, CAST(count(*) AS BIGINT) AS available, CAST(sum(qty) - count(*) AS BIGINT) AS suggestion FROM sales_v WHERE day BETWEEN DATE '2001-06-01' AND DATE '2001-06-20' GROUP BY style"
VIEWS["sold_v"] = "SELECT style, DATE '2001-07-02' AS week_start, CAST(sum(qty) AS BIGINT) AS units FROM sales_v WHERE day BETWEEN DATE '2001-07-02' AND DATE '2001-07-08' GROUP BY style"


def _made(spark, sf):
    rows = sales(spark, sf).where(F.col("day").between("2001-06-01", "2001-06-20")).groupBy("style").agg(F.sum("qty").alias("forecast"), F.count(F.lit(1)).alias("available"))
    return rows.select("style", F.lit(date(2001, 7, 2)).alias("week_start"), F.lit(date(2001, 7, 8)).alias("week_end"), "forecast", "available", (F.col("forecast") - F.col("available")).alias("suggestion"))


@query("g15_production_log", "SELECT style, week_start, week_end, forecast, available + 1 AS available, suggestion, 'open' AS status, DATE '2001-07-02' AS captured_on, DATE '2001-07-04' AS updated_on, CAST(NULL AS BIGINT) AS actual FROM made_v")
def g15(spark, sf):
    once = state.log_running(spark.createDataFrame([], _LOG), _made(spark, sf), date(2001, 7, 2))
    return state.log_running(once, _made(spark, sf).withColumns({"available": F.col("available") + 1, "forecast": F.col("forecast") + 9}), date(2001, 7, 4))


@query("g16_settled_log", "SELECT coalesce(m.style, s.style) AS style, coalesce(forecast, 0) AS forecast, coalesce(units, 0) AS actual, 'completed' AS status FROM made_v m FULL JOIN (SELECT * FROM sold_v WHERE units <> 0) s ON m.style = s.style")
def g16(spark, sf):
    log = state.log_running(spark.createDataFrame([], _LOG), _made(spark, sf), date(2001, 7, 2))
    sold = sales(spark, sf).where(F.col("day").between("2001-07-02", "2001-07-08")).groupBy("style").agg(F.sum("qty").alias("units")).withColumn("week_start", F.lit(date(2001, 7, 2)))
    return state.log_settled(log, sold, date(2001, 7, 25)).select("style", "forecast", "actual", "status")


@query("g17_log_retention", "SELECT DISTINCT CAST(date_trunc('week', day) AS DATE) AS week_start FROM sales_v WHERE day >= DATE '2001-05-28' AND day < DATE '2001-07-23'")
def g17(spark, sf):
    weeks = sales(spark, sf).where(F.col("day").between("2001-02-05", "2001-07-22")).select("style", F.date_trunc("week", "day").cast("date").alias("week_start")).distinct().withColumn("status", F.lit("completed"))
    return state.log_kept(weeks).select("week_start").distinct()


@query("g18_log_totals", "SELECT week_start, 'open' AS status, count(*) AS styles, CAST(sum(forecast) AS BIGINT) AS forecast, CAST(sum(available) AS BIGINT) AS available, CAST(sum(suggestion) AS BIGINT) AS suggestion, CAST(NULL AS BIGINT) AS actual FROM made_v GROUP BY week_start")
def g18(spark, sf):
    return state.log_totals(state.log_running(spark.createDataFrame([], _LOG), _made(spark, sf), date(2001, 7, 2)))


@query("w12_held_values", "SELECT key AS id, start AS week, CASE WHEN key LIKE '00%' THEN 1 ELSE qty END AS qty FROM val_v")
def w12(spark, sf):
    v = _values(spark, sf).select(F.col("key").alias("id"), F.col("start").alias("week"), "qty")
    return state.held(v.where("id LIKE '00%'").withColumn("qty", F.lit(1.0)), v)


@query("s11_latest_snapshot", "SELECT qty % 5 AS version, order_date AS snapshot FROM orders_v WHERE order_date <= DATE '2001-06-30' ORDER BY snapshot DESC, version = 3 DESC, version DESC LIMIT 1")
def s11(spark, sf):
    rows = view(spark, sf, "orders_v").select((F.col("qty") % 5).alias("version"), F.col("order_date").alias("snapshot"))
    return state.latest_snapshot(rows, date(2001, 6, 30), 3)


@query("s12_aligned_forecast", "SELECT id, CAST(step - 2 AS INT) AS step, qty FROM naive_v WHERE step >= 2")
def s12(spark, sf):
    return state.aligned(naive(spark, sf).select("id", "step", "qty"), date(2001, 8, 1), date(2001, 8, 15))
