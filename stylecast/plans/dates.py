"""Queries: dates, weeks, seasons and axes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import calendar as cal
from ..registry import query
from .base import NOW, chunk_sql
from .fixtures import TODAY, view

_DAYS = "(SELECT DISTINCT order_date AS d FROM orders_v)"
_END = "CASE WHEN day(d) <= 7 THEN make_date(year(d), month(d), 7) WHEN day(d) <= 15 THEN make_date(year(d), month(d), 15) WHEN day(d) <= 23 THEN make_date(year(d), month(d), 23) ELSE last_day(d) END"
_ORD = "((year(d) * 12 + month(d) - 1) * 4 + CASE WHEN day(d) <= 7 THEN 0 WHEN day(d) <= 15 THEN 1 WHEN day(d) <= 23 THEN 2 ELSE 3 END)"
_SEASON = "CASE WHEN month(d) IN (11, 12, 1) THEN 'S1' WHEN month(d) IN (2, 3, 4) THEN 'S2' WHEN month(d) IN (5, 6, 7) THEN 'S3' ELSE 'S4' END"


def _snap(spark, sf):
    return view(spark, sf, "orders_v").agg(F.max("order_date").alias("snap"))


def _days(spark, sf):
    return view(spark, sf, "orders_v").select(F.col("order_date").alias("d")).distinct()


@query("t1_week_start", f"SELECT d, CAST(date_trunc('week', d) AS DATE) AS week FROM {_DAYS}")
def t1(spark, sf):
    return _days(spark, sf).select("d", cal.monday(F.col("d")).alias("week"))


@query("t2_forecast_week", f"SELECT d, CAST(date_trunc('week', d) AS DATE) + 21 AS week FROM {_DAYS}")
def t2(spark, sf):
    return _days(spark, sf).select("d", cal.forecast_week_start(F.col("d"), F.lit(2)).alias("week"))


@query("t3_report_week", f"SELECT d, {chunk_sql('d')} AS chunk_start, {_END} AS chunk_end FROM {_DAYS}")
def t3(spark, sf):
    return _days(spark, sf).select("d", cal.chunk_start(F.col("d")).alias("chunk_start"), cal.chunk_end(F.col("d")).alias("chunk_end"))


@query("t4_report_week_ordinal", f"SELECT CAST({_ORD} AS INT) AS ord, {chunk_sql('d')} AS chunk_start, {_END} AS chunk_end, strftime(d, '%b') || ' W' || ({_ORD} % 4 + 1) AS label, count(*) AS n_days FROM {_DAYS} GROUP BY ALL")
def t4(spark, sf):
    o = F.col("ord")
    rows = _days(spark, sf).groupBy(cal.chunk_ord(F.col("d")).alias("ord")).agg(F.count(F.lit(1)).alias("n_days"))
    return rows.select("ord", cal.ord_start(o).alias("chunk_start"), cal.ord_end(o).alias("chunk_end"), cal.ord_label(o).alias("label"), "n_days")


@query(
    "t5_week_axis",
    f"""SELECT CAST(unnest(generate_series(date_trunc('week', DATE '{DEFAULT.axis_start}'), date_trunc('week', {NOW}), INTERVAL 7 DAY)) AS DATE) AS week, 'past' AS kind
UNION ALL SELECT CAST(date_trunc('week', d) AS DATE) + 7 * (w + 1) AS week, 'forecast' AS kind FROM (SELECT max(order_date) AS d FROM orders_v), (SELECT CAST(unnest(range(13)) AS INT) AS w) WHERE CAST(date_trunc('week', d) AS DATE) + 7 * (w + 1) > date_trunc('week', {NOW})""",
)
def t5(spark, sf):
    return cal.week_axis(_snap(spark, sf), DEFAULT.axis_start, TODAY, 13)


@query("t6_report_week_axis", f"SELECT DISTINCT {chunk_sql('d')} AS chunk_start, {_END} AS chunk_end FROM (SELECT CAST(unnest(generate_series(date_trunc('month', lo), last_day(hi), INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT min(order_date) AS lo, CAST(max(order_date) + INTERVAL 40 WEEK AS DATE) AS hi FROM orders_v))")
def t6(spark, sf):
    return cal.chunk_axis(view(spark, sf, "orders_v").agg(F.min("order_date").alias("lo"), F.date_add(F.max("order_date"), 280).alias("hi")))


@query(
    "t7_season",
    f"""WITH s AS (SELECT d, {_SEASON} AS season, CAST(year(d) - CASE WHEN month(d) = 1 THEN 1 ELSE 0 END AS INT) AS year FROM {_DAYS}),
b AS (SELECT *, make_date(year, CASE season WHEN 'S1' THEN 11 WHEN 'S2' THEN 2 WHEN 'S3' THEN 5 ELSE 8 END, 1) AS first FROM s)
SELECT d, season, year, first AS start, CAST(first + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS end_, CASE WHEN season = 'S1' THEN 'S1 ' || year || '-' || substr(CAST(year + 1 AS VARCHAR), 3, 2) ELSE season || ' ' || year END AS label,
       CASE season WHEN 'S4' THEN 'S1' WHEN 'S1' THEN 'S2' WHEN 'S2' THEN 'S3' ELSE 'S4' END AS next FROM b""",
)
def t7(spark, sf):
    s, y = F.col("season"), F.col("year")
    rows = _days(spark, sf).select("d", cal.season(F.col("d")).alias("season"), cal.season_year(F.col("d")).alias("year"))
    return rows.select("d", "season", "year", cal.season_start(s, y).alias("start"), cal.season_end(s, y).alias("end_"), cal.season_label(s, y).alias("label"), cal.next_season(s, y)[0].alias("next"))


@query(
    "t8_week_features",
    f"""SELECT DISTINCT w AS week, CAST(weekofyear(w) AS INT) AS weekofyear, CAST(month(w) AS INT) AS month, CAST(quarter(w) AS INT) AS quarter, CAST(year(w) AS INT) AS year, CAST(dayofyear(w) AS INT) AS day_of_year,
CAST(day(w) = 1 AS INT) AS is_month_start, CAST(w = last_day(w) AS INT) AS is_month_end, CAST(w = date_trunc('quarter', w) AS INT) AS is_quarter_start, CAST(quarter(w) <> quarter(w + 1) AS INT) AS is_quarter_end
FROM (SELECT CAST(date_trunc('week', d) AS DATE) AS w FROM {_DAYS})""",
)
def t8(spark, sf):
    weeks = _days(spark, sf).select(cal.monday(F.col("d")).alias("week")).distinct()
    return weeks.select("week", *cal.week_features(F.col("week")))


@query(
    "t9_week_status",
    f"""WITH w AS (SELECT CAST(unnest(generate_series(DATE '2001-06-04', date_trunc('week', greatest(max(order_date) + 56, {NOW})), INTERVAL 7 DAY)) AS DATE) AS week FROM orders_v), e AS (SELECT week, coalesce(lead(week) OVER (ORDER BY week), week + 7) - 1 AS week_end FROM w)
SELECT week, CAST(week_end AS DATE) AS week_end, CASE WHEN week_end < {NOW} THEN 'completed' WHEN week <= {NOW} THEN 'running' ELSE 'upcoming' END AS status FROM e""",
)
def t9(spark, sf):
    return cal.week_status(cal.week_axis(_snap(spark, sf), date(2001, 6, 4), TODAY, 8).select("week"), TODAY)


@query("t10_snapshot_date", f"SELECT max(order_date) AS snap, strftime(max(order_date) - INTERVAL 1 MONTH, '%Y-%m') AS last_month FROM orders_v WHERE order_date <= {NOW} AND product_sku_code IS NOT NULL")
def t10(spark, sf):
    return cal.snapshot_date(view(spark, sf, "orders_v"), TODAY)
