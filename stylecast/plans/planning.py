"""Queries: the plan and the lifecycle."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..config import STAGES
from ..functions import calendar as cal
from ..functions import keys
from ..operators import analysis, joins, panel, planning
from ..registry import query
from ..sources import orders
from .base import cleaned, net, once, sales
from .fixtures import TODAY, VIEWS, view
from .panel import launches, weekly

VIEWS["event_day_v"] = "SELECT DISTINCT CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS day FROM events_calendar_v"
VIEWS["clean_day_v"] = """SELECT day, units, (ok OR NOT enough) AS clean FROM (SELECT *, count(*) FILTER (WHERE ok) OVER () >= 21 AS enough FROM (
 SELECT d.day, units, NOT ev AND units <= 2 * greatest(1, coalesce(m, o)) AS ok FROM (SELECT s.day, coalesce(units, 0) AS units, s.day IN (SELECT day FROM event_day_v) AS ev FROM (SELECT CAST(unnest(generate_series(DATE '2001-08-01' - 59, DATE '2001-08-01', INTERVAL 1 DAY)) AS DATE) AS day) s LEFT JOIN (SELECT day, CAST(sum(qty) AS BIGINT) AS units FROM sales_v GROUP BY day) u ON s.day = u.day) d
 LEFT JOIN (SELECT dayofweek(day) AS dow, median(units) AS m FROM (SELECT s.day, coalesce(units, 0) AS units FROM (SELECT CAST(unnest(generate_series(DATE '2001-08-01' - 59, DATE '2001-08-01', INTERVAL 1 DAY)) AS DATE) AS day) s LEFT JOIN (SELECT day, CAST(sum(qty) AS BIGINT) AS units FROM sales_v GROUP BY day) u ON s.day = u.day WHERE s.day NOT IN (SELECT day FROM event_day_v)) GROUP BY 1) w ON dayofweek(d.day) = w.dow
 CROSS JOIN (SELECT median(units) AS o FROM (SELECT coalesce(units, 0) AS units, s.day FROM (SELECT CAST(unnest(generate_series(DATE '2001-08-01' - 59, DATE '2001-08-01', INTERVAL 1 DAY)) AS DATE) AS day) s LEFT JOIN (SELECT day, CAST(sum(qty) AS BIGINT) AS units FROM sales_v GROUP BY day) u ON s.day = u.day WHERE s.day NOT IN (SELECT day FROM event_day_v))) q))"""
VIEWS["rate_v"] = "SELECT sku AS id, sum(qty) * 7 / (SELECT count(*) FROM clean_day_v WHERE clean) AS weekly FROM sales_v WHERE day IN (SELECT day FROM clean_day_v WHERE clean) GROUP BY sku"
VIEWS["step_v"] = "SELECT CAST(k AS INT) AS step, CAST(DATE '2001-08-06' + 7 * CAST(k AS INT) AS DATE) AS week, 1 + (k % 4) / 8.0 AS factor FROM (SELECT unnest(range(40)) AS k)"
VIEWS["naive_v"] = "SELECT id, step, week, greatest(0, weekly * factor) AS qty FROM rate_v, step_v"
VIEWS["horizon_v"] = """SELECT id, CAST(round_even(sum(CASE WHEN step = 0 THEN qty ELSE 0 END), 0) AS BIGINT) AS forecast7, CAST(round_even(sum(CASE WHEN step = 0 THEN qty ELSE 0 END) + sum(CASE WHEN step = 1 THEN qty ELSE 0 END) * 3 / 7, 0) AS BIGINT) AS forecast10,
 CAST(sum(CASE WHEN step < 5 THEN round_even(qty, 0) ELSE 0 END) AS BIGINT) AS forecast35 FROM naive_v GROUP BY id"""
VIEWS["avail_v"] = """SELECT product_sku_code AS id, CAST(round_even(coalesce(max(stock), 0), 0) AS BIGINT) AS inventory, CAST(round_even(coalesce(max(wip), 0), 0) AS BIGINT) AS wip FROM stocked_v LEFT JOIN wip_v USING (design, size) GROUP BY 1"""
VIEWS["cover_v"] = """SELECT f.id, coalesce(s.sigma, 0) AS sigma, CAST(greatest(0, round_even(1.65 * coalesce(s.sigma, 0) * sqrt(84.0 / 7), 0)) AS BIGINT) AS safety, p50, greatest(p50, CAST(round_even(p50 + 0.841621 * coalesce(s.sigma, 0) * sqrt(12), 0) AS BIGINT)) AS p80
 FROM (SELECT id, CAST(greatest(0, round_even(sum(CASE WHEN step < 12 THEN qty ELSE 0 END), 0)) AS BIGINT) AS p50 FROM naive_v GROUP BY id) f LEFT JOIN (SELECT id, coalesce(stddev_samp(y), 0) AS sigma FROM (SELECT sku AS id, date_trunc('week', day) AS week, sum(qty) AS y FROM sales_v GROUP BY ALL) WHERE week BETWEEN DATE '2001-06-04' AND DATE '2001-07-23' GROUP BY id) s USING (id)"""


def _gross(spark, sf):
    return sales(spark, sf).select(F.col("sku").alias("id"), "day", "qty")


def clean(spark, sf):
    gross = _gross(spark, sf).where(F.col("day") > F.date_sub(F.lit(TODAY), 60))
    daily = gross.groupBy("day").agg(F.sum("qty").alias("units"))
    return planning.clean_days(daily, joins.event_days(view(spark, sf, "events_calendar_v")), TODAY)


def rates(spark, sf):
    return planning.run_rate(_gross(spark, sf), clean(spark, sf))


def naive(spark, sf):
    factors = spark.range(40).select(F.col("id").cast("int").alias("step"), cal.forecast_week_start(F.lit(TODAY), F.col("id").cast("int")).alias("week"), (1 + (F.col("id") % 4) / 8.0).alias("factor"))
    return planning.naive_forecast(rates(spark, sf), factors)


def _available(spark, sf):
    from .joins import wip_stock

    rows = joins.with_stock(cleaned(spark, sf), *wip_stock(spark, sf))
    return planning.available(rows.select(F.col("product_sku_code").alias("id"), "stock", "wip"))


@query("q1_run_rate", "SELECT id, weekly FROM rate_v")
def q1(spark, sf):
    return rates(spark, sf)


@query("q1_excluded_days", "SELECT day FROM clean_day_v WHERE NOT clean")
def q1_days(spark, sf):
    return clean(spark, sf).where("NOT clean").select("day")


@query("q2_blend", "SELECT id, step, greatest(0, CASE WHEN step % 5 = 0 THEN weekly * factor ELSE 0.5 * 100 + 0.5 * weekly * factor END) AS qty FROM rate_v, step_v WHERE step < 10")
def q2(spark, sf):
    rows = rates(spark, sf).crossJoin(spark.range(10).select(F.col("id").cast("int").alias("step"), (1 + (F.col("id") % 4) / 8.0).alias("factor")))
    model = F.when(F.col("step") % 5 != 0, 100.0)
    return rows.select("id", "step", planning.blended(model, F.col("weekly"), F.col("factor")).alias("qty"))


@query("q3_horizons", "SELECT * FROM horizon_v")
def q3(spark, sf):
    return planning.horizons(naive(spark, sf))


_STYLE_NAIVE = "SELECT style AS id, step, sum(n.qty) AS qty FROM naive_v n JOIN (SELECT DISTINCT sku, style FROM sales_v) s ON n.id = s.sku GROUP BY ALL"


@query("q4_preferred_series", f"SELECT id, step, CASE WHEN id LIKE '01%' THEN 50.0 ELSE round_even(qty, 6) END AS qty FROM ({_STYLE_NAIVE}) WHERE step < 13")
def q4(spark, sf):
    parts = naive(spark, sf).where("step < 13").withColumnRenamed("id", "sku").join(sales(spark, sf).select("sku", F.col("style").alias("id")).distinct(), "sku")
    own = parts.where(F.col("id").startswith("01")).select("id", "step", F.lit(50.0).alias("qty")).distinct()
    return planning.preferred(own, parts.select("id", "sku", "step", "qty")).withColumn("qty", F.bround("qty", 6))


@query("q5_design_five_weeks", f"SELECT id, CAST(sum(round_even(qty, 0)) AS BIGINT) AS forecast35 FROM ({_STYLE_NAIVE}) WHERE step < 5 GROUP BY id")
def q5(spark, sf):
    parts = naive(spark, sf).where("step < 5").withColumnRenamed("id", "sku").join(sales(spark, sf).select("sku", F.col("style").alias("id")).distinct(), "sku")
    return planning.horizons(planning.by_design(parts)).select("id", "forecast35")


@query("q6_available", "SELECT *, inventory + wip AS available FROM avail_v")
def q6(spark, sf):
    return _available(spark, sf)


def _cover(spark, sf):
    weekly_sku = panel.weekly_of(sales(spark, sf), "sku")
    return planning.cover(naive(spark, sf), weekly_sku, TODAY)


@query("q7_cover", "SELECT id, round_even(sigma, 6) AS sigma, safety, p50, p80 FROM cover_v")
def q7(spark, sf):
    return _cover(spark, sf).withColumn("sigma", F.bround("sigma", 6))


@query("q8_replenishment", "SELECT id, p80 AS target, inventory + wip AS available, greatest(0, p80 - inventory - wip) AS produce, CASE WHEN inventory + wip >= p80 THEN 'In Stock' ELSE 'Needs Production' END AS stock_status FROM cover_v JOIN avail_v USING (id)")
def q8(spark, sf):
    return planning.replenishment(_cover(spark, sf).join(_available(spark, sf), "id")).select("id", "target", "available", "produce", "stock_status")


VIEWS["life_v"] = """SELECT b.*, CASE WHEN launch IS NULL THEN NULL ELSE DATE '2001-08-01' - launch END AS age, t30 / 30.0 AS current FROM (SELECT h.id, forecast35, inventory + wip AS available, coalesce(t30, 0) AS t30, coalesce(t60, 0) AS t60, coalesce(prior, 0) AS prior, coalesce(older, 0) AS older, coalesce(lwin, 0) AS lwin, coalesce(ret30, 0) AS ret30, l.launch
 FROM horizon_v h JOIN avail_v USING (id) LEFT JOIN sku_launch_v l USING (id) LEFT JOIN (SELECT product_sku_code AS id, sum(CASE WHEN a >= 0 AND a < 30 THEN qty ELSE 0 END) AS t30, sum(CASE WHEN a >= 0 AND a < 60 THEN qty ELSE 0 END) AS t60, sum(CASE WHEN a >= 30 AND a < 60 THEN qty ELSE 0 END) AS prior, sum(CASE WHEN a >= 60 AND a < 90 THEN qty ELSE 0 END) AS older, sum(CASE WHEN order_date - launch BETWEEN 0 AND 19 THEN qty ELSE 0 END) AS lwin
  FROM (SELECT n.*, DATE '2001-08-01' - order_date AS a, launch FROM net_v n LEFT JOIN sku_launch_v k ON n.product_sku_code = k.id) GROUP BY 1) s USING (id)
 LEFT JOIN (SELECT product_sku_code AS id, sum(CASE WHEN DATE '2001-08-01' - order_date BETWEEN 0 AND 29 THEN abs(qty) ELSE 0 END) AS ret30 FROM clean_v WHERE contains(lower(order_status), 'return') GROUP BY 1) r USING (id)) b"""
VIEWS["sku_launch_v"] = "SELECT DISTINCT sku AS id, launch FROM sales_v JOIN launch_v ON style = launch_v.id"
VIEWS["life_v"] = VIEWS.pop("life_v")
VIEWS["grow_v"] = """SELECT *, (current - at_launch) / greatest(at_launch, 1e-6) AS growth, greatest(0.0, least(1.0, ret30 / greatest(t30 + ret30, 1e-6))) AS return_rate, greatest(0.0, least(1.0, t30 / greatest(available, 1))) AS turnover, greatest(0.0, least(1.0, (available - forecast35) / greatest(forecast35, 1))) AS overstock, greatest(0.0, least(1.0, (forecast35 - available) / greatest(forecast35, 1))) AS stockout
 FROM (SELECT *, coalesce(CASE WHEN least(age, 20) > 0 THEN lwin / least(age, 20) END, current) AS at_launch FROM life_v)"""
VIEWS["stage_v"] = """SELECT *, CASE WHEN age <= 20 THEN 'Emerging' WHEN t60 <= 0 THEN 'Dead' WHEN older > 0 AND prior <= 0 AND t30 > 0 THEN 'Reviving' WHEN growth <= -0.3 THEN 'Declining' WHEN growth >= 1 AND current >= (SELECT coalesce(median(current), 0) FROM grow_v WHERE current > 0) THEN 'Emerging' WHEN growth >= 0.2 THEN 'Growing' ELSE 'Stable' END AS stage FROM grow_v"""


def figures(spark, sf):
    """Lifecycle figures of each SKU, written once as tiers, stages and scores start from them."""
    return once(spark, sf, "figures", lambda: _figures(spark, sf))


def _figures(spark, sf):
    rows = cleaned(spark, sf)
    as_id = lambda df: df.select(F.col("product_sku_code").alias("id"), F.col("order_date").alias("day"), "qty")
    sku_launch = sales(spark, sf).select(F.col("sku"), F.col("style").alias("id")).distinct().join(launches(spark, sf), "id").select(F.col("sku").alias("id"), "launch")
    ids = planning.horizons(naive(spark, sf)).join(_available(spark, sf), "id").select("id", "forecast35", "available")
    return planning.lifecycle_figures(ids, as_id(net(spark, sf)), as_id(orders.labelled(rows).where("returned")), sku_launch, TODAY)


_ROUNDED = ("current", "at_launch", "growth", "return_rate", "turnover", "overstock", "stockout")


@query("q9_lifecycle_figures", f"SELECT id, forecast35, available, CAST(t30 AS BIGINT) AS t30, CAST(t60 AS BIGINT) AS t60, CAST(prior AS BIGINT) AS prior, CAST(older AS BIGINT) AS older, CAST(lwin AS BIGINT) AS lwin, CAST(ret30 AS BIGINT) AS ret30, launch, CAST(age AS INT) AS age, {', '.join(f'round_even({c}, 6) AS {c}' for c in _ROUNDED)} FROM grow_v")
def q9(spark, sf):
    return figures(spark, sf).withColumns({c: F.bround(c, 6) for c in _ROUNDED})


@query("q10_stages", "SELECT id, stage FROM stage_v")
def q10(spark, sf):
    return planning.with_stage(figures(spark, sf)).select("id", "stage")


def _tier_sql(c, prefix):
    q = f"(SELECT quantile_cont({c}, {{}}) FROM grow_v WHERE {c} > 0)"
    return f"CASE WHEN {c} <= 0 THEN '{prefix}_T0' ELSE '{prefix}_T' || ({' + '.join(f'CAST({c} >= {q.format(x)} AS INT)' for x in (0.4, 0.7, 0.9))}) END"


@query("q11_velocity_tiers", f"SELECT id, CASE WHEN age IS NULL THEN 'Unknown' ELSE {_tier_sql('at_launch', 'Launch')} END AS launch_tier, {_tier_sql('current', 'Current')} AS current_tier FROM grow_v")
def q11(spark, sf):
    return planning.with_tiers(figures(spark, sf)).select("id", "launch_tier", "current_tier")


@query("a11_velocity_cuts", "SELECT quantile_cont(current, 0.4) AS cut0, quantile_cont(current, 0.7) AS cut1, quantile_cont(current, 0.9) AS cut2, median(current) AS median FROM grow_v WHERE current > 0")
def a11(spark, sf):
    return planning.velocity_cuts(figures(spark, sf), "current")


_RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2) / count(*) OVER ()"


@query(
    "q12_scores",
    f"""WITH p(stage, factor, h, r, p) AS (VALUES {", ".join(f"('{k}', {a}, {b}, {c}, {d})" for k, (a, b, c, d) in STAGES.items())}), x AS (SELECT *, {_RANK.format("current")} AS vel, {_RANK.format("greatest(-1.0, least(5.0, growth))")} AS grow FROM stage_v JOIN p USING (stage))
SELECT id, stage, CAST(round_even(round_even(100 * (0.35 * vel + 0.20 * grow + 0.15 * turnover + 0.10 * (1 - return_rate) + 0.20 * h), 6), 0) AS INT) AS health, CAST(round_even(round_even(100 * (0.45 * r + 0.30 * overstock + 0.25 * return_rate), 6), 0) AS INT) AS risk,
CAST(round_even(round_even(100 * (0.45 * p + 0.30 * vel + 0.25 * stockout), 6), 0) AS INT) AS priority, CAST(greatest(0, round_even(forecast35 * factor, 0) - available) AS BIGINT) AS suggested FROM x""",
)
def q12(spark, sf):
    return planning.with_scores(planning.with_stage(figures(spark, sf))).select("id", "stage", "health", "risk", "priority", "suggested")


_KEY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(trim(sku)), '[-_\\s]+', '-', 'g'), '^(.*-(?:XXS|XS|S|M|L|XL|XXL|2XL|XXXL|3XL|4XL|5XL|6XL|7XL|8XL))-[A-Z]$', '\\1'), '^(.+)-2XL$', '\\1-XXL'), '^(.+)-3XL$', '\\1-XXXL')"


@query(
    "q13_style_to_sku",
    f"""WITH k AS (SELECT style, {_KEY} AS sku, CAST(sum(CASE WHEN day > DATE '2001-08-01' - 90 THEN qty ELSE 0 END) AS BIGINT) AS w, CAST(sum(qty) AS BIGINT) AS units FROM sales_v GROUP BY ALL), t AS (SELECT *, 500 AS total, CASE WHEN sum(w) OVER (PARTITION BY style) > 0 THEN w ELSE units END AS wt FROM k),
r AS (SELECT *, total * wt / sum(wt) OVER (PARTITION BY style) AS raw FROM t), f AS (SELECT *, floor(raw) AS fl FROM r), q AS (SELECT *, row_number() OVER (PARTITION BY style ORDER BY round_even(raw - fl, 9) DESC, sku) AS rk, total - sum(fl) OVER (PARTITION BY style) AS rest FROM f)
SELECT style, sku, w AS recent, CAST(fl + CASE WHEN rk <= rest THEN 1 ELSE 0 END AS BIGINT) AS forecast FROM q""",
)
def q13(spark, sf):
    rows = sales(spark, sf).groupBy("style", keys.sku_key(F.col("sku"), F.col("style")).alias("sku")).agg(F.sum(F.when(F.col("day") > F.date_sub(F.lit(TODAY), 90), F.col("qty")).otherwise(0)).alias("recent"), F.sum("qty").alias("units"))
    from pyspark.sql import Window

    rows = rows.withColumn("total", F.lit(500)).withColumn("w", F.when(F.sum("recent").over(Window.partitionBy("style")) > 0, F.col("recent")).otherwise(F.col("units")))
    return analysis.split_by_share(rows, ["style"], "total", "w", "sku", "forecast").select("style", "sku", "recent", "forecast")


@query("a27_tier_roll_up", "WITH t AS (SELECT name AS style, max_by(tier, effective_from) AS tier FROM tier_history_v GROUP BY name) SELECT coalesce(tier, 'Unclassified') AS tier, count(*) AS n_skus, CAST(sum(forecast35) AS BIGINT) AS forecast35, CAST(sum(inventory + wip) AS BIGINT) AS available FROM horizon_v JOIN avail_v USING (id) JOIN (SELECT DISTINCT sku, style FROM sales_v) s ON id = s.sku LEFT JOIN t USING (style) GROUP BY 1")
def a27(spark, sf):
    tiers = joins.current_tier(view(spark, sf, "tier_history_v"))
    rows = planning.horizons(naive(spark, sf)).join(_available(spark, sf), "id").join(sales(spark, sf).select(F.col("sku").alias("id"), "style").distinct(), "id").join(tiers, "style", "left").fillna("Unclassified", ["tier"])
    return rows.groupBy("tier").agg(F.count(F.lit(1)).alias("n_skus"), F.sum("forecast35").alias("forecast35"), F.sum("available").alias("available"))


@query("w14_share_of_block", "SELECT sub_category, month, units, units / sum(units) OVER (PARTITION BY month) AS share FROM (SELECT sub_category, month, CAST(sum(qty) AS BIGINT) AS units FROM sales_v GROUP BY ALL)")
def w14(spark, sf):
    return planning.share_shift(sales(spark, sf), ["sub_category"], "month", "qty")
