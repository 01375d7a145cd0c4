"""Queries: festivals and sales."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import festival
from ..registry import query
from .base import once, sales
from .fixtures import VIEWS, view

# Effects by event, as a calibration may have left them.
EFFECTS = (("Diwali dip", 0.84), ("Pre-Rakhi shopping", 1.25), ("Raksha Bandhan (Festival)", 1.03), ("Navratri (Festival)", 1.18), ("Big Days (Flipkart)", 1.4), ("Republic Sale (Amazon)", 1.12), ("Summer Sale (Myntra)", 0.92))
VIEWS["effects_v"] = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST({m} AS DOUBLE))" for n, m in EFFECTS) + ") AS t(name, multiplier)"
VIEWS["windows_v"] = """SELECT name, start_date, end_date FROM events_calendar_v WHERE name <> 'Diwali (Festival)'
 UNION ALL SELECT 'Diwali dip', start_date - 2, end_date FROM events_calendar_v WHERE name = 'Diwali (Festival)'
 UNION ALL SELECT 'Pre-Rakhi shopping', start_date - 10, start_date - 4 FROM events_calendar_v WHERE name = 'Raksha Bandhan (Festival)'"""
VIEWS["daily_v"] = "SELECT day, CAST(sum(qty) AS BIGINT) AS units FROM sales_v GROUP BY day"
VIEWS["wdays_v"] = "SELECT DISTINCT name, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS day FROM windows_v"
VIEWS["factors_v"] = f"""SELECT day, round_even(greatest({festival.LOWEST}, least({festival.HIGHEST}, exp(sum(ln(multiplier))))), 9) AS factor, first(name ORDER BY abs(ln(multiplier)) DESC, name) AS event FROM wdays_v JOIN effects_v USING (name) WHERE abs(multiplier - 1) > {festival.NOISE} GROUP BY day"""


_UNITS = "name, start_date, end_date, CAST(coalesce(sum(units), 0) AS BIGINT) AS units"


def _events(spark, sf):
    return view(spark, sf, "events_calendar_v")


def _effects(spark):
    return spark.createDataFrame(list(EFFECTS), "name string, multiplier double")


def daily(spark, sf):
    """A row a day, written once as steps read it several times."""
    return once(spark, sf, "daily", lambda: _daily(spark, sf))


def _daily(spark, sf):
    return sales(spark, sf).groupBy("day").agg(F.sum("qty").alias("units"))


@query("f1_windows", f"SELECT {_UNITS} FROM windows_v LEFT JOIN daily_v ON day BETWEEN start_date AND end_date GROUP BY ALL")
def f1(spark, sf):
    return festival.with_units(festival.windows(_events(spark, sf)), daily(spark, sf))


VIEWS["baseline_v"] = """SELECT day, units, median(qu) AS baseline FROM (SELECT d.day, d.units, q.units AS qu, row_number() OVER (PARTITION BY d.day ORDER BY q.day DESC) AS r FROM dense_v d JOIN dense_v q ON dayofweek(d.day) = dayofweek(q.day) AND q.day < d.day AND d.day - q.day <= 182
 WHERE q.day NOT IN (SELECT day FROM wdays_v)) WHERE r <= 6 GROUP BY day, units HAVING count(*) >= 4 AND median(qu) > 0"""
VIEWS["dense_v"] = "SELECT s.day, coalesce(units, 0) AS units FROM (SELECT CAST(unnest(generate_series(min(day), max(day) - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM daily_v) s LEFT JOIN daily_v USING (day)"
VIEWS["baseline_v"] = VIEWS.pop("baseline_v")  # after what it builds on


@query("f2_baseline", "SELECT day, units, baseline FROM baseline_v")
def f2(spark, sf):
    return festival.same_weekday_baseline(daily(spark, sf), festival.windows(_events(spark, sf)))


_EQUATIONS = """x AS (SELECT name, day, ln(least(5.0, greatest(0.2, units / baseline))) AS y FROM wdays_v JOIN baseline_v USING (day))
SELECT p.name AS a, q.name AS b, count(*) AS n, round_even(sum(CASE WHEN p.name = q.name THEN p.y END), 6) AS xy FROM x p JOIN x q USING (day) GROUP BY ALL"""


@query("f3_normal_equations", f"WITH {_EQUATIONS}")
def f3_equations(spark, sf):
    return festival.normal_equations(daily(spark, sf), festival.windows(_events(spark, sf))).withColumn("xy", F.bround("xy", 6))


@query("f3_calibration")
def f3(spark, sf):
    return festival.calibrated(daily(spark, sf), festival.windows(_events(spark, sf)))


@query("f4_day_factors", "SELECT day, coalesce(factor, 1) AS factor, event FROM daily_v LEFT JOIN factors_v USING (day)")
def f4(spark, sf):
    return festival.day_factors(daily(spark, sf), festival.windows(_events(spark, sf)), _effects(spark))


_SIGNAL = """w AS (SELECT DISTINCT CAST(date_trunc('week', day) AS DATE) AS week FROM daily_v), d AS (SELECT week, CAST(week + k AS DATE) AS day FROM w, (SELECT CAST(unnest(range(7)) AS INT) AS k)), f AS (SELECT week, coalesce(factor, 1) AS factor, event FROM d LEFT JOIN factors_v USING (day)),
m AS (SELECT week, round_even(sum(factor) / 7, 9) AS factor FROM f GROUP BY week), e AS (SELECT week, first(event ORDER BY n DESC, event) AS event FROM (SELECT week, event, count(*) AS n FROM f WHERE event IS NOT NULL GROUP BY ALL) GROUP BY week),
u AS (SELECT DISTINCT CAST(start_date + CAST(floor((end_date - start_date) / 2) AS INT) AS DATE) AS middle FROM windows_v JOIN effects_v USING (name) WHERE multiplier > 1.07),
g AS (SELECT week, first(middle - week ORDER BY abs(middle - week), middle - week) AS gap FROM w, u GROUP BY week)"""


@query("f5_week_signals", f"WITH {_SIGNAL} SELECT week, factor, event, CAST(CASE WHEN abs(gap) < 999 THEN gap ELSE 999 END AS INT) AS days_to_peak FROM m LEFT JOIN e USING (week) LEFT JOIN g USING (week)")
def f5(spark, sf):
    weeks = daily(spark, sf).select(cal.monday(F.col("day")).alias("week"))
    return festival.week_signals(weeks, festival.windows(_events(spark, sf)), _effects(spark))


@query("f6_uplift_windows", f"SELECT {_UNITS}, multiplier FROM windows_v JOIN effects_v USING (name) LEFT JOIN daily_v ON day BETWEEN start_date AND end_date WHERE multiplier > 1.07 AND start_date <= DATE '2001-12-31' AND end_date >= DATE '2000-06-01' GROUP BY ALL")
def f6(spark, sf):
    return festival.with_units(festival.uplift_windows(festival.windows(_events(spark, sf)), _effects(spark), date(2000, 6, 1), date(2001, 12, 31)), daily(spark, sf))


@query(
    "f7_next_and_past_event",
    f"""SELECT part, {_UNITS} FROM ((SELECT 'next' AS part, name, start_date, end_date FROM events_calendar_v WHERE category = 'sale' AND end_date >= DATE '2001-08-01' ORDER BY start_date, name LIMIT 1)
UNION ALL (SELECT 'past', name, start_date, end_date FROM events_calendar_v WHERE name = 'Navratri (Festival)' AND end_date < DATE '2001-08-01' ORDER BY start_date DESC LIMIT 1)) LEFT JOIN daily_v ON day BETWEEN start_date AND end_date GROUP BY ALL""",
)
def f7(spark, sf):
    e, cols = _events(spark, sf), ("name", "start_date", "end_date")
    a = festival.next_event(e, "sale", date(2001, 8, 1)).select(F.lit("next").alias("part"), *cols)
    both = a.unionByName(festival.past_occurrence(e, "Navratri (Festival)", date(2001, 8, 1)).select(F.lit("past").alias("part"), *cols))
    return festival.with_units(both, daily(spark, sf))


_LATE = "(SELECT style AS id, CAST(date_trunc('week', day) AS DATE) AS week, CAST(sum(qty) AS BIGINT) AS qty FROM sales_v WHERE day >= DATE '2000-07-03' AND day < DATE '2001-07-02' GROUP BY ALL)"


@query(
    "f8_design_spikes",
    f"""WITH x AS {_LATE}, h AS (SELECT min(week) AS lo, max(week) + 6 AS hi FROM x), c AS (SELECT name, greatest(start_date, lo) AS s, least(end_date, hi) AS e FROM windows_v JOIN effects_v USING (name), h WHERE multiplier > 1.07 AND start_date <= DATE '2001-07-01' AND end_date >= DATE '2000-07-03' AND greatest(start_date, lo) <= least(end_date, hi)),
p AS (SELECT name, s, e, CAST(date_trunc('week', d) AS DATE) AS week, count(*) AS n FROM (SELECT name, s, e, CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS d FROM c) GROUP BY ALL),
b AS (SELECT id, coalesce(avg(qty) FILTER (WHERE week NOT IN (SELECT week FROM p)), avg(qty)) AS base FROM x GROUP BY id), g AS (SELECT id, name, s, e, sum(qty / 7 * n) AS qty FROM x JOIN p USING (week) GROUP BY ALL),
k AS (SELECT id, name AS event, s AS event_start, e AS event_end, CAST(round_even(qty, 0) AS BIGINT) AS qty, CAST(round_even((qty / (e - s + 1) / (base / 7) - 1) * 100, 0) AS INT) AS uplift_pct FROM g JOIN b USING (id) WHERE base > 0)
SELECT id, event, CAST(event_start AS DATE) AS event_start, CAST(event_end AS DATE) AS event_end, qty, uplift_pct FROM k WHERE uplift_pct >= 10 QUALIFY row_number() OVER (PARTITION BY id ORDER BY uplift_pct DESC, event_start, event) = 1""",
)
def f8(spark, sf):
    late = sales(spark, sf).where(F.col("day").between(F.lit(date(2000, 7, 3)), F.lit(date(2001, 7, 1))))
    weekly = late.groupBy(F.col("style").alias("id"), cal.monday(F.col("day")).alias("week")).agg(F.sum("qty").alias("qty"))
    up = festival.uplift_windows(festival.windows(_events(spark, sf)), _effects(spark), date(2000, 7, 3), date(2001, 7, 1))
    return festival.spikes(weekly, up.drop("multiplier"))


@query(
    "f9_event_outlook",
    """SELECT sub_category, CAST(q AS BIGINT) AS qty, CASE WHEN b > 0 THEN CAST(round_even((q / b - 1) * 100, 0) AS INT) END AS uplift_pct FROM (SELECT sub_category, sum(CASE WHEN day >= DATE '2000-09-25' THEN qty END) AS q, sum(CASE WHEN day < DATE '2000-09-25' THEN qty ELSE 0 END) AS b
FROM sales_v WHERE day BETWEEN DATE '2000-09-16' AND DATE '2000-10-03' GROUP BY 1) WHERE q IS NOT NULL ORDER BY q DESC, sub_category LIMIT 5""",
)
def f9(spark, sf):
    return festival.outlook(sales(spark, sf), date(2000, 9, 25), date(2000, 10, 3), "sub_category", 5)


@query(
    "f10_spike_lead_days",
    """WITH d AS (SELECT CAST(DATE '2000-09-25' - k AS DATE) AS day, -k AS o FROM (SELECT CAST(unnest(range(1, 51)) AS INT) AS k)), r AS (SELECT day, o, coalesce(units, 0) AS u, avg(coalesce(units, 0)) OVER (ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM d LEFT JOIN daily_v USING (day)),
q AS (SELECT avg(u) AS base, count(*) AS n FROM r WHERE o BETWEEN -45 AND -15 AND day NOT IN (SELECT CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) FROM events_calendar_v WHERE name <> 'Navratri (Festival)'))
SELECT CAST(max(CASE WHEN m >= base * 1.2 AND n >= 8 AND base >= 3 AND o > -15 THEN -o END) AS INT) AS lead_days FROM r, q""",
)
def f10(spark, sf):
    return festival.spike_lead_days(daily(spark, sf), _events(spark, sf), "Navratri (Festival)", date(2000, 9, 25))


_PARTS = (("past", "2000-09-25"), ("past", "2000-10-02"), ("control", "2000-09-11"), ("control", "2000-09-18"), ("upcoming", "2001-09-24"), ("upcoming", "2001-10-01"))


@query(
    "f11_event_boost",
    f"""WITH p(part, week) AS (VALUES {", ".join(f"('{a}', DATE '{b}')" for a, b in _PARTS)}), a AS (SELECT sub_category AS id, CAST(date_trunc('week', day) AS DATE) AS week, sum(qty) AS units FROM sales_v GROUP BY ALL),
s AS (SELECT id, least(4, sum(CASE WHEN part = 'past' THEN units ELSE 0 END) / sum(CASE WHEN part = 'control' THEN units ELSE 0 END)) AS ratio FROM a JOIN p USING (week) GROUP BY id HAVING sum(CASE WHEN part = 'control' THEN units ELSE 0 END) >= 5),
f AS (SELECT DISTINCT id, week, 200.0::DOUBLE AS qty, 190.0::DOUBLE AS naive FROM (SELECT DISTINCT id FROM a), (SELECT week FROM p WHERE part = 'upcoming' UNION ALL SELECT DATE '2001-10-08'))
SELECT f.id, f.week, f.naive, greatest(coalesce(CASE WHEN f.week <> DATE '2001-10-08' AND ratio > 1 THEN round_even(naive * ratio, 0) END, 0), qty) AS qty FROM f LEFT JOIN s USING (id)""",
)
def f11(spark, sf):
    frame = sales(spark, sf)
    actual = frame.groupBy(F.col("sub_category").alias("id"), cal.monday(F.col("day")).alias("week")).agg(F.sum("qty").alias("units"))
    parts = spark.createDataFrame([("Navratri", p, date.fromisoformat(w)) for p, w in _PARTS], "event string, part string, week date")
    weeks = parts.where("part = 'upcoming'").select("week").union(spark.createDataFrame([(date(2001, 10, 8),)], "week date"))
    forecast = actual.select("id").distinct().crossJoin(F.broadcast(weeks)).withColumn("qty", F.lit(200.0)).withColumn("naive", F.lit(190.0))
    return festival.boosted(forecast, actual, parts).select("id", "week", "naive", "qty")


_AHEAD = "SELECT CAST(CAST(date_trunc('week', d) AS DATE) + 7 * (k + 1) AS DATE) AS week FROM (SELECT max(day) AS d FROM daily_v), (SELECT CAST(unnest(range(40)) AS INT) AS k)"


@query("f12_horizon_factors", f"""WITH {_SIGNAL.replace("SELECT DISTINCT CAST(date_trunc('week', day) AS DATE) AS week FROM daily_v", _AHEAD)} SELECT week, factor, event FROM m LEFT JOIN e USING (week)""")
def f12(spark, sf):
    weeks = cal.forecast_weeks(daily(spark, sf).agg(F.max("day").alias("snap")), 40)
    return festival.week_signals(weeks, festival.windows(_events(spark, sf)), _effects(spark)).drop("days_to_peak")
