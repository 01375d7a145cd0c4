"""Queries: the weekly panel."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import joins, panel
from ..registry import query
from .base import sales
from .fixtures import VIEWS, view

LAST = date(2001, 7, 30)
VIEWS["weekly_v"] = "SELECT style AS id, CAST(date_trunc('week', day) AS DATE) AS week, CAST(sum(qty) AS BIGINT) AS y FROM sales_v GROUP BY ALL"
VIEWS["panel_v"] = """SELECT g.id, g.week, coalesce(y, 0) AS y FROM (SELECT id, CAST(unnest(generate_series(first, last, INTERVAL 7 DAY)) AS DATE) AS week FROM (SELECT id, min(week) AS first FROM weekly_v GROUP BY id), (SELECT max(week) AS last FROM weekly_v)) g LEFT JOIN weekly_v USING (id, week)"""
VIEWS["launch_v"] = "SELECT CASE WHEN length(DESIGN_NO) > 6 THEN substr(DESIGN_NO, 1, 6) ELSE DESIGN_NO END AS id, min(LAUNCH_DATE) AS launch FROM design_master_v WHERE LAUNCH_DATE >= DATE '1990-01-01' GROUP BY 1"


def weekly(spark, sf):
    return panel.weekly_of(sales(spark, sf), "style")


def launches(spark, sf):
    master = view(spark, sf, "design_master_v").select(F.substring("DESIGN_NO", 1, 6).alias("id"), F.col("LAUNCH_DATE").alias("launch"))
    return panel.launch_dates(master, date(1990, 1, 1))


@query("m1_matured_weeks", "SELECT * FROM weekly_v WHERE week + 13 <= DATE '2001-08-01'")
def m1(spark, sf):
    return panel.matured(weekly(spark, sf), date(2001, 8, 1))


@query("m2_dense_panel", "SELECT * FROM panel_v")
def m2(spark, sf):
    return panel.dense(weekly(spark, sf))


@query("j8_calendar_scaffold", "SELECT id, count(*) AS n_weeks, CAST(sum(y) AS BIGINT) AS units, count(*) FILTER (WHERE y = 0) AS n_zero FROM panel_v GROUP BY id")
def j8(spark, sf):
    return panel.dense(weekly(spark, sf)).groupBy("id").agg(F.count(F.lit(1)).alias("n_weeks"), F.sum("y").alias("units"), F.count_if(F.col("y") == 0).alias("n_zero"))


@query("m3_launch_rate", "SELECT id, sum(y) / (count(*) * 7) AS launch_drr FROM weekly_v JOIN launch_v USING (id) WHERE week - launch BETWEEN 0 AND 19 GROUP BY id")
def m3(spark, sf):
    return panel.launch_rates(weekly(spark, sf), launches(spark, sf))


@query(
    "m4_static_attributes",
    """WITH t AS (SELECT name AS id, max_by(tier, effective_from) AS tier FROM tier_history_v GROUP BY name) SELECT p.id, week, y, CAST(CASE WHEN launch IS NULL THEN -1 ELSE greatest(floor((week - launch) / 7), 0) END AS INT) AS age_weeks, coalesce(category, 'Unclassified') AS category, coalesce(sub_category, 'Unclassified') AS sub_category, coalesce(tier, 'Unknown') AS tier
FROM panel_v p LEFT JOIN launch_v USING (id) LEFT JOIN attributes_v a ON p.id = a.style LEFT JOIN t ON p.id = t.id""",
)
def m4(spark, sf):
    rows = panel.product_age(panel.dense(weekly(spark, sf)), launches(spark, sf))
    rows = joins.with_styles(rows, view(spark, sf, "attributes_v"), ("category", "sub_category"), key="id")
    tiers = joins.current_tier(view(spark, sf, "tier_history_v")).withColumnRenamed("style", "id")
    return rows.join(tiers, "id", "left").fillna("Unknown", ["tier"])


@query("m5_design_level", "SELECT id, week, y, quantile_cont(y, 0.5) OVER (PARTITION BY id ORDER BY week ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS design_level FROM weekly_v")
def m5(spark, sf):
    return panel.design_level_before(weekly(spark, sf))


@query("m7_rolling_folds", "WITH w AS (SELECT week, row_number() OVER (ORDER BY week) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT week FROM weekly_v)), f AS (SELECT CAST(unnest(range(3)) AS INT) AS fold), b AS (SELECT *, greatest(1, floor(n * 0.15)) AS s, n - greatest(1, floor(n * 0.15)) - greatest(1, floor(n * 0.15)) * (3 - fold) AS b FROM w, f) SELECT fold, CASE WHEN i < b THEN 'train' ELSE 'val' END AS role, week FROM b WHERE i < b + s")
def m7(spark, sf):
    return panel.rolling_folds(weekly(spark, sf))


@query("m10_direct_training_set", "SELECT id, CAST(step AS INT) AS step, count(*) AS n_rows, CAST(sum(target) AS BIGINT) AS units FROM (SELECT p.id, p.week, s.step, q.y AS target FROM panel_v p, (SELECT unnest(range(1, 14)) AS step) s JOIN panel_v q ON q.id = p.id AND q.week = p.week + CAST(7 * (s.step - 1) AS INT)) GROUP BY ALL")
def m10(spark, sf):
    rows = panel.forward_targets(panel.dense(weekly(spark, sf)))
    return rows.groupBy("id", "step").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("target").alias("units"))


@query("m12_active_scope", "SELECT DISTINCT id FROM weekly_v WHERE week > DATE '2001-07-30' - 91 AND y > 0")
def m12(spark, sf):
    return panel.active_ids(weekly(spark, sf), LAST)


_W = "OVER (PARTITION BY id ORDER BY week ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
_FEATURES = ", ".join(
    [f"lag(y, {k}) OVER (PARTITION BY id ORDER BY week) AS lag_{k}" for k in panel.LAGS]
    + [f"avg(y) {_W.format(k)} AS rolling_mean_{k}" for k in panel.MEANS]
    + [f"stddev_samp(y) {_W.format(k)} AS rolling_std_{k}" for k in panel.STDS]
    + [f"max(y) {_W.format(4)} AS rolling_max_4", f"min(y) {_W.format(4)} AS rolling_min_4", f"avg(y) {_W.format('UNBOUNDED')} AS avg_weekly_sales", f"avg(CAST(y = 0 AS DOUBLE)) {_W.format('UNBOUNDED')} AS zero_sales_ratio"]
)


@query(
    "w1_w6_lag_features",
    f"""WITH f AS (SELECT id, week, y, {_FEATURES} FROM panel_v) SELECT id, week, y, {", ".join(f"lag_{k}" for k in panel.LAGS)}, rolling_max_4, rolling_min_4, lag_1 - lag_2 AS sales_diff_1,
{", ".join(f"round_even({c}, 6) AS {c}" for c in (*(f"rolling_mean_{k}" for k in panel.MEANS), *(f"rolling_std_{k}" for k in panel.STDS), "avg_weekly_sales", "zero_sales_ratio"))},
round_even(CASE WHEN coalesce(lag_2, 0) = 0 THEN 0 ELSE (lag_1 - lag_2) / lag_2 END, 6) AS sales_growth_pct, round_even(CASE WHEN coalesce(rolling_mean_4, 0) = 0 THEN 0 ELSE lag_1 / rolling_mean_4 END, 6) AS rolling_mean_ratio, round_even(lag_1 - rolling_mean_4, 6) AS trend_vs_avg,
round_even(CASE WHEN coalesce(rolling_mean_4, 0) = 0 THEN 0 ELSE rolling_std_4 / rolling_mean_4 END, 6) AS coefficient_variation FROM f""",
)
def w1_w6(spark, sf):
    rows = panel.lag_features(panel.dense(weekly(spark, sf)))
    return rows.select(*(F.bround(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))


@query("w8_percentile_rank", "WITH s AS (SELECT id, sum(y) % 50 AS v FROM weekly_v GROUP BY id) SELECT id, (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2) / count(*) OVER () AS pct FROM s")
def w8(spark, sf):
    rows = weekly(spark, sf).groupBy("id").agg((F.sum("y") % 50).alias("v"))
    return panel.percentile_rank(rows, pct="v").select("id", "pct")


@query("w13_recency_weight", "SELECT week, count(*) AS n_rows, power(0.5, (DATE '2001-07-30' - week) / 7 / 26) AS weight FROM panel_v GROUP BY week")
def w13(spark, sf):
    return panel.recency_weights(panel.dense(weekly(spark, sf))).groupBy("week", "weight").agg(F.count(F.lit(1)).alias("n_rows"))


@query("w15_forward_target", "SELECT id, week, y, lead(y, 4) OVER (PARTITION BY id ORDER BY week) AS target FROM panel_v QUALIFY target IS NOT NULL")
def w15(spark, sf):
    return panel.forward_targets(panel.dense(weekly(spark, sf))).where("step = 5").select("id", "week", "y", "target")


@query("a9_recent_level", "SELECT id, median(y) AS level FROM weekly_v WHERE week > DATE '2001-07-30' - 84 GROUP BY id")
def a9(spark, sf):
    return panel.recent_level(weekly(spark, sf), LAST)


@query(
    "a10_outlier_cap",
    """WITH e AS (SELECT DISTINCT CAST(date_trunc('week', CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE)) AS DATE) AS week FROM events_calendar_v), c AS (SELECT id, quantile_cont(y, 0.99) AS cap FROM weekly_v WHERE week NOT IN (SELECT week FROM e) AND week <= DATE '2000-06-26' GROUP BY id)
SELECT id, week, CASE WHEN week NOT IN (SELECT week FROM e) AND cap IS NOT NULL THEN least(CAST(y AS DOUBLE), cap) ELSE CAST(y AS DOUBLE) END AS y FROM weekly_v LEFT JOIN c USING (id)""",
)
def a10(spark, sf):
    weeks = joins.event_days(view(spark, sf, "events_calendar_v")).select(F.date_trunc("week", "day").cast("date").alias("week"))
    return panel.capped(weekly(spark, sf), weeks, date(2000, 6, 26))


@query("k10_launch_dates", "SELECT * FROM launch_v")
def k10(spark, sf):
    return launches(spark, sf)
