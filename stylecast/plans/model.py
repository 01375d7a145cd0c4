"""Queries: the forecast model."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import festival, joins, model, panel
from ..registry import query
from .base import once
from .festival import _SIGNAL, _effects, _events
from .fixtures import view
from .panel import _FEATURES, LAST, launches, weekly

#: Variance power and ridge of each setting.
GRID = ((1.3, 0.01), (1.1, 0.001), (1.5, 0.1))


def features(spark, sf):
    """The feature rows, written once as each fit reads them."""

    def make():
        styles, tiers = view(spark, sf, "attributes_v"), view(spark, sf, "tier_history_v")
        return model.feature_rows(weekly(spark, sf), styles, tiers, launches(spark, sf), festival.windows(_events(spark, sf)), _effects(spark))

    return once(spark, sf, "features", make)


def _design(spark, sf):
    made = model.design(features(spark, sf))
    return model.Design(once(spark, sf, "design", lambda: made.rows), made.labels)


def _selection(spark, sf):
    rows = features(spark, sf)
    return once(spark, sf, "selection", lambda: model.selection(_design(spark, sf), rows, panel.rolling_folds(rows), GRID))


def _final(spark, sf):
    """The best setting, fitted to all rows."""
    made, best = _design(spark, sf), _selection(spark, sf).where("chosen").first()
    return made, model.fitted(made.rows, made.labels, best["power"], best["ridge"])


_HISTORY = """lag_1 - lag_2 AS sales_diff_1, CASE WHEN coalesce(lag_2, 0) = 0 THEN 0 ELSE (lag_1 - lag_2) / lag_2 END AS sales_growth_pct, CASE WHEN coalesce(rolling_mean_4, 0) = 0 THEN 0 ELSE lag_1 / rolling_mean_4 END AS rolling_mean_ratio,
lag_1 - rolling_mean_4 AS trend_vs_avg, CASE WHEN coalesce(rolling_mean_4, 0) = 0 THEN 0 ELSE rolling_std_4 / rolling_mean_4 END AS coefficient_variation"""
_ROUNDED = [c for c in model.NUMERIC if c.startswith("rolling_mean") or c.startswith("rolling_std") or c in ("sales_growth_pct", "trend_vs_avg", "coefficient_variation", "avg_weekly_sales", "zero_sales_ratio", "design_level", "launch_drr", "factor")]
_PLAIN = [c for c in (*model.NUMERIC, *model.CATEGORICAL) if c not in _ROUNDED]


@query(
    "m6_feature_assembly",
    f"""WITH {_SIGNAL.replace("SELECT DISTINCT CAST(date_trunc('week', day) AS DATE) AS week FROM daily_v", "SELECT DISTINCT week FROM panel_v")},
s AS (SELECT week, factor, coalesce(event, 'None') AS event, CAST(CASE WHEN abs(gap) < 999 THEN gap ELSE 999 END AS INT) AS days_to_peak, CAST(factor > 1 AS INT) AS is_festival FROM m LEFT JOIN e USING (week) LEFT JOIN g USING (week)),
h AS (SELECT id, week, y, {_FEATURES} FROM panel_v), r AS (SELECT id, sum(y) / (count(*) * 7) AS drr FROM weekly_v JOIN launch_v USING (id) WHERE week - launch BETWEEN 0 AND 19 GROUP BY id),
v AS (SELECT id, week, quantile_cont(y, 0.5) OVER (PARTITION BY id ORDER BY week ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS design_level FROM weekly_v WHERE y > 0),
a AS (SELECT h.*, {_HISTORY}, {", ".join(f"coalesce({c}, 'Unclassified') AS {c}" for c in model.ATTRIBUTES)}, CAST(CASE WHEN launch IS NULL THEN -1 ELSE greatest(floor((week - launch) / 7), 0) END AS INT) AS age_weeks,
 CASE WHEN week - launch >= 20 THEN coalesce(drr, 0) ELSE 0 END AS launch_drr, coalesce(design_level, 0) AS design_level, CAST(month(week) AS INT) AS month
 FROM h LEFT JOIN attributes_v t ON h.id = t.style LEFT JOIN launch_v USING (id) LEFT JOIN r USING (id) LEFT JOIN v USING (id, week)),
z AS (SELECT a.*, factor, event, days_to_peak, is_festival, category || '_' || event AS category_event, coalesce(t.tier, 'Unknown') AS tier FROM a JOIN s USING (week) ASOF LEFT JOIN tier_history_v t ON a.id = t.name AND a.week >= t.effective_from)
SELECT id, week, y, {", ".join(_PLAIN)}, {", ".join(f"round_even({c}, 6) AS {c}" for c in _ROUNDED)} FROM z""",
)
def m6(spark, sf):
    return features(spark, sf).select("id", "week", "y", *_PLAIN, *(F.bround(c, 6).alias(c) for c in _ROUNDED))


@query("m9_model_selection")
def m9(spark, sf):
    return _selection(spark, sf).withColumns({c: F.bround(c, 3) for c in ("wape", "naive_wape")})


@query("m11_recursive_forecast")
def m11(spark, sf):
    _, fit = _final(spark, sf)
    rows, tiers = weekly(spark, sf), joins.current_tier(view(spark, sf, "tier_history_v")).withColumnRenamed("style", "id")
    static = rows.select("id").distinct().join(view(spark, sf, "attributes_v").withColumnRenamed("style", "id"), "id", "left").join(tiers, "id", "left").join(launches(spark, sf), "id", "left")
    static = static.join(panel.launch_rates(rows, launches(spark, sf)), "id", "left")
    static = static.join(panel.recent_level(rows.where(F.col("y") > 0), LAST).withColumnRenamed("level", "design_level"), "id", "left")
    days = spark.createDataFrame([(LAST + timedelta(weeks=k),) for k in range(1, 41)], "week date")
    return model.recursive_forecast(rows, static, festival.week_signals(days, festival.windows(_events(spark, sf)), _effects(spark)), fit, LAST)


@query("m13_importances")
def m13(spark, sf):
    return model.importances(*_final(spark, sf)).withColumn("importance", F.bround("importance", 6))


