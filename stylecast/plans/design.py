"""Queries: design suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import design
from ..registry import query
from .base import once, sales
from .fixtures import TODAY, VIEWS, view

VIEWS["chunk_v"] = """SELECT style, channel, CAST(o - 96076 AS INT) AS "offset", CAST(sum(qty) AS BIGINT) AS qty FROM (SELECT style, marketplace AS channel, qty, (year(day) * 12 + month(day) - 1) * 4 + CASE WHEN day(day) <= 7 THEN 0 WHEN day(day) <= 15 THEN 1 WHEN day(day) <= 23 THEN 2 ELSE 3 END AS o FROM sales_v) WHERE o - 96076 > -56 AND o <= 96076 GROUP BY ALL"""
VIEWS["adj_v"] = """SELECT c.*, CASE WHEN tc > 0 THEN qty * coalesce(w, 0) * t / tc ELSE 0 END AS adj FROM (SELECT *, sum(qty) OVER (PARTITION BY "offset") AS t, sum(qty) OVER (PARTITION BY "offset", channel) AS tc FROM chunk_v) c
 LEFT JOIN (SELECT channel, sum(qty) / (SELECT sum(qty) FROM chunk_v WHERE "offset" > -24) AS w FROM chunk_v WHERE "offset" > -24 GROUP BY channel) u USING (channel)"""
VIEWS["trend_v"] = """SELECT style, sum(CASE WHEN "offset" > -4 THEN adj ELSE 0 END) AS now, sum(CASE WHEN "offset" <= -4 THEN adj ELSE 0 END) AS before, CAST(sum(CASE WHEN "offset" > -4 THEN qty ELSE 0 END) AS BIGINT) AS real_now, CAST(sum(CASE WHEN "offset" <= -4 THEN qty ELSE 0 END) AS BIGINT) AS real_before FROM adj_v WHERE "offset" > -8 GROUP BY style"""


def frame(spark, sf):
    return once(spark, sf, "chunk_frame", lambda: design.chunk_frame(sales(spark, sf).withColumnRenamed("marketplace", "channel"), TODAY))


def _rounded(df, *cols):
    return df.withColumns({c: F.bround(c, 6) for c in cols})


@query("d2_chunk_frame", 'SELECT style, channel, "offset", qty, round_even(adj, 6) AS adj FROM adj_v')
def d2(spark, sf):
    return _rounded(frame(spark, sf), "adj")


@query("d3_momentum", 'SELECT style, round_even(sum(CASE WHEN "offset" > -8 THEN adj ELSE 0 END), 6) AS now, round_even(sum(CASE WHEN "offset" <= -48 THEN adj ELSE 0 END), 6) AS year_ago FROM adj_v WHERE "offset" > -8 OR "offset" <= -48 GROUP BY style')
def d3(spark, sf):
    return _rounded(design.momentum(frame(spark, sf)), "now", "year_ago")


@query("d4_trend", "SELECT style, round_even(now, 6) AS now, round_even(before, 6) AS before, real_now, real_before FROM trend_v")
def d4(spark, sf):
    return _rounded(design.trend(frame(spark, sf)), "now", "before")


@query(
    "d5_share_trend",
    """WITH v AS (SELECT colour AS value, sum(now) AS now, sum(before) AS before, count(*) FILTER (WHERE real_now > 0) AS active FROM trend_v JOIN attributes_v USING (style) GROUP BY colour), t AS (SELECT sum(now) AS tn, sum(before) AS tb FROM trend_v)
SELECT value, round_even(now, 6) AS now, round_even(now / tn * 100, 6) AS share, CASE WHEN before >= 30 THEN round_even(((now / tn) / (before / tb) - 1) * 100, 6) END AS change_pct, active FROM v, t""",
)
def d5(spark, sf):
    return _rounded(design.share_trends(design.trend(frame(spark, sf)), view(spark, sf, "attributes_v"), "colour"), "now", "share", "change_pct")


@query("d8_trending_designs", "SELECT style, real_now, real_before, CASE WHEN real_before >= 10 THEN round_even((real_now / real_before - 1) * 100, 1) END AS growth_pct, DATE '2001-08-01' - first <= 56 AS new_launch FROM trend_v JOIN (SELECT style, min(day) AS first FROM sales_v GROUP BY style) f USING (style) WHERE real_now >= 20 AND real_now >= 1.3 * real_before")
def d8(spark, sf):
    first = sales(spark, sf).groupBy("style").agg(F.min("day").alias("first"))
    return design.trending(design.trend(frame(spark, sf)), first, TODAY)


@query("d9_reference_season", "SELECT 'S2' AS season, 2000 AS year, DATE '2000-02-01' >= min(day) AS whole FROM sales_v")
def d9(spark, sf):
    return design.reference_season(sales(spark, sf), "S2", 2001, TODAY)


@query("d21_style_prices", "SELECT style, min(day) AS first_sale, round_even(CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) / sum(qty), 4) AS price FROM sales_v GROUP BY style")
def d21(spark, sf):
    return sales(spark, sf).groupBy("style").agg(F.min("day").alias("first_sale"), F.bround(F.sum(F.col("total").cast("decimal(18,2)")).cast("double") / F.sum("qty"), 4).alias("price"))


@query(
    "l4_top_pick_hits",
    """WITH y AS (SELECT style, CAST(year(day) AS INT) AS season, sum(qty) AS y, sum(CASE WHEN month(day) <= 6 THEN qty ELSE 0 END) AS p FROM sales_v GROUP BY ALL), r AS (SELECT season, row_number() OVER (PARTITION BY season ORDER BY y DESC, style) AS ry, row_number() OVER (PARTITION BY season ORDER BY p DESC, style) AS rp, floor(count(*) OVER (PARTITION BY season) * 0.2) AS n FROM y)
SELECT round_even(count(*) FILTER (WHERE ry <= n AND rp <= n) / count(*) FILTER (WHERE rp <= n) * 100, 1) AS hit_pct FROM r WHERE n >= 5""",
)
def l4(spark, sf):
    rows = sales(spark, sf).groupBy("style", F.year("day").alias("season")).agg(F.sum("qty").alias("y"), F.sum(F.when(F.month("day") <= 6, F.col("qty")).otherwise(0)).alias("p"))
    return design.top_pick_hits(rows)
