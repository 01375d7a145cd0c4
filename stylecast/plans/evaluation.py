"""Queries: evaluation."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from ..operators import evaluation, festival, joins
from ..registry import query
from .base import cleaned, sales
from .festival import _effects, _events, daily
from .fixtures import TODAY, VIEWS, view
from .panel import weekly

SNAPSHOTS = (date(2001, 2, 4), date(2001, 3, 4), date(2001, 4, 1), date(2001, 5, 6), date(2001, 6, 3))
_LAST = date(2001, 7, 16)
VIEWS["pred_v"] = (
    "SELECT p.snapshot, w.id, CAST(k AS INT) AS step, CAST(date_trunc('week', p.snapshot) AS DATE) + 7 * (CAST(k AS INT) + 1) AS week, sum(y) / 8 AS qty FROM weekly_v w, (SELECT unnest(["
    + ", ".join(f"DATE '{d}'" for d in SNAPSHOTS)
    + "]) AS snapshot) p, (SELECT unnest(range(8)) AS k) WHERE w.week > CAST(date_trunc('week', p.snapshot) AS DATE) - 56 AND w.week <= date_trunc('week', p.snapshot) GROUP BY ALL"
)
VIEWS["scored_v"] = "SELECT p.*, coalesce(y, 0) AS y FROM pred_v p LEFT JOIN weekly_v USING (id, week) WHERE week <= DATE '2001-07-16'"


def predictions(spark, sf):
    """The mean of the eight weeks up to each snapshot, for the eight weeks after it."""
    snaps = spark.createDataFrame([(d, d - timedelta(days=d.weekday())) for d in SNAPSHOTS], "snapshot date, monday date")
    rows = weekly(spark, sf).join(F.broadcast(snaps), F.col("week").between(F.date_sub("monday", 49), F.col("monday")))
    mean = rows.groupBy("snapshot", "monday", "id").agg((F.sum("y") / 8).alias("qty"))
    return mean.select("snapshot", "id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("step"), "monday", "qty").select("snapshot", "id", "step", F.expr("date_add(monday, 7 * (step + 1))").alias("week"), "qty")


def _scored(spark, sf):
    return evaluation.scored(predictions(spark, sf), weekly(spark, sf), _LAST)


_ACC = "round_even(greatest(0, 100 - CASE WHEN sum(abs(y)) = 0 THEN 0 ELSE sum(abs(y - qty)) / sum(abs(y)) * 100 END), 6) AS accuracy, CAST(sum(y) AS BIGINT) AS units, count(*) AS n"


def _rounded(df):
    return df.withColumn("accuracy", F.bround("accuracy", 6))


@query("e1_walk_forward", f"SELECT id, {_ACC} FROM (SELECT id, week, max_by(qty, snapshot) AS qty, max(y) AS y FROM scored_v GROUP BY ALL) GROUP BY id")
def e1(spark, sf):
    return _rounded(evaluation.accuracy_by(evaluation.latest_predictions(_scored(spark, sf)), "id"))


@query("e2_accuracy_by_step", f"SELECT step, {_ACC} FROM scored_v GROUP BY step")
def e2(spark, sf):
    return _rounded(evaluation.accuracy_by(_scored(spark, sf), "step"))


@query("e3_accuracy_by_tier", f"SELECT tier, {_ACC} FROM (SELECT s.*, coalesce(t.tier, 'Unknown') AS tier FROM scored_v s ASOF LEFT JOIN tier_history_v t ON s.id = t.name AND s.week >= t.effective_from) GROUP BY tier")
def e3(spark, sf):
    rows = joins.tier_as_of(_scored(spark, sf), view(spark, sf, "tier_history_v"), "id", "week")
    return _rounded(evaluation.accuracy_by(rows, "tier"))


@query("e4_naive_proxy", f"SELECT {_ACC} FROM scored_v WHERE week > DATE '2001-07-16' - 56")
def e4(spark, sf):
    return _rounded(evaluation.accuracy_by(_scored(spark, sf).where(F.col("week") > F.date_sub(F.lit(_LAST), 56))))


@query("e5_cutoffs", "SELECT CAST(unnest(generate_series(min(week) + INTERVAL 120 DAY, max(week) - INTERVAL 14 DAY, INTERVAL 28 DAY)) AS DATE) AS cutoff FROM weekly_v")
def e5(spark, sf):
    return evaluation.cutoffs(weekly(spark, sf))


@query("e6_blend_sweep", "WITH g AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS alpha), f AS (SELECT unnest([true, false]) AS festival) SELECT CAST(alpha AS DOUBLE) AS alpha, festival, round_even(sum(abs(y - greatest(0, alpha * (qty + 5) + (1 - alpha) * qty * CASE WHEN festival THEN 1.1 ELSE 1.0 END))) / sum(abs(y)) * 100, 6) AS wape FROM scored_v, g, f GROUP BY ALL")
def e6(spark, sf):
    rows = _scored(spark, sf).select("y", (F.col("qty") + 5).alias("model"), F.col("qty").alias("naive"), F.lit(1.1).alias("factor"))
    return evaluation.sweep(rows, [0.0, 0.25, 0.5, 0.75, 1.0]).withColumn("wape", F.bround("wape", 6))


@query("m8_metrics", "SELECT round_even(sum(abs(y - qty)) / sum(abs(y)) * 100, 6) AS wape, round_even(avg(abs(y - qty)), 6) AS mae, round_even(sqrt(avg((y - qty) * (y - qty))), 6) AS rmse, round_even(sum(qty - y) / sum(y) * 100, 6) AS bias FROM scored_v")
def m8(spark, sf):
    out = evaluation.metrics(_scored(spark, sf), "y", "qty")
    return out.select(*(F.bround(c, 6).alias(c) for c in out.columns))


_LOG = "SELECT CAST(week AS DATE) AS week_start, 'completed' AS status, CAST(round_even(sum(qty), 0) AS BIGINT) AS forecast, CAST(sum(y) AS BIGINT) AS actual FROM (SELECT id, week, max_by(qty, snapshot) AS qty, max(y) AS y FROM scored_v GROUP BY ALL) GROUP BY week"


@query(
    "e7_data_health",
    f"""WITH s AS (SELECT max(day) AS snap FROM daily_v), x AS (SELECT CAST(unnest(generate_series(snap - INTERVAL 90 DAY, snap, INTERVAL 1 DAY)) AS DATE) AS day, snap FROM s),
d AS (SELECT x.*, snap - x.day AS ago, coalesce(units, 0) AS units, x.day IN (SELECT day FROM wdays_v) AS listed, coalesce(factor, 1) AS factor FROM x LEFT JOIN daily_v USING (day) LEFT JOIN factors_v USING (day)), n AS (SELECT list_sort(list(units))[46] AS normal FROM d),
f AS (SELECT max(normal) AS normal, DATE '2001-08-05' - max(snap) AS old, count(*) FILTER (WHERE ago < 60 AND units > 2.0 * normal) AS spikes, count(*) FILTER (WHERE ago < 21 AND units > 1.8 * normal AND NOT listed) AS unlisted, avg(factor) FILTER (WHERE ago < 7) AS calendar, avg(units) FILTER (WHERE ago < 7) AS made FROM d, n),
a AS (SELECT actual, greatest(0, (1 - abs(forecast - actual) / actual) * 100) AS accuracy FROM ({_LOG}) WHERE actual > 0 ORDER BY week_start DESC LIMIT 1),
m AS (SELECT count(*) AS n, sum(qty) AS qty FROM (SELECT style, sum(qty) AS qty FROM sales_v, s WHERE snap - day <= 55 AND sub_category IN ('', 'Unclassified') GROUP BY style HAVING sum(qty) <> 0)),
l AS (SELECT 'sales_incomplete' AS rule, (SELECT count(*) FROM clean_v) AS got, (SELECT count(*) FROM orders_v) AS expected), u AS (
SELECT 'error' AS severity, rule, 1 AS n, got / greatest(1, expected) AS value FROM l WHERE got < 0.995 * expected OR got = 0 UNION ALL SELECT 'warning', 'data_stale', old, old FROM f WHERE old > 2 UNION ALL SELECT 'warning', 'runrate_spike', spikes, normal FROM f WHERE normal > 0 AND spikes > 0
UNION ALL SELECT 'warning', 'calendar_missing_event', unlisted, normal FROM f WHERE normal > 0 AND unlisted > 0 UNION ALL SELECT 'warning', 'calendar_event_not_seen', 7, calendar FROM f WHERE normal > 0 AND calendar >= 1.25 AND made < 1.25 * normal
UNION ALL SELECT 'warning', 'accuracy_low', actual, accuracy FROM a WHERE accuracy < 70 UNION ALL SELECT 'info', 'master_missing', n, qty FROM m WHERE n > 0)
SELECT severity, rule, CAST(n AS BIGINT) AS n, round_even(CAST(value AS DOUBLE), 6) AS value, CAST(CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS INT) AS rank FROM u""",
)
def e7(spark, sf):
    """Four days after the last order; what the cleaning leaves of the sales counts as what was loaded, and the latest forecasts as the log."""
    latest = evaluation.latest_predictions(_scored(spark, sf)).groupBy(F.col("week").alias("week_start")).agg(F.bround(F.sum("qty"), 0).cast("long").alias("forecast"), F.sum("y").cast("long").alias("actual"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    sold = sales(spark, sf)
    loads = count(view(spark, sf, "orders_v"), "expected").crossJoin(count(cleaned(spark, sf), "got")).select(F.lit("sales").alias("part"), "expected", "got")
    windows = festival.windows(_events(spark, sf))
    days = daily(spark, sf)
    return evaluation.health(days, festival.window_days(windows), festival.day_factors(days, windows, _effects(spark)), latest.withColumn("status", F.lit("completed")), sold, loads, TODAY + timedelta(days=4))
