"""Queries: rankings of attribute values and forecasts by report week."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import design, joins, rankings, report
from ..registry import query
from .base import sales
from .design import frame
from .fixtures import TODAY, VIEWS, view
from .report import report_cells

ATTRIBUTES = ("category", "sub_category", "colour", "fabric", "neck")
# The season that is compared with: S2 of 2000.
SEASON = (date(2000, 2, 1), date(2000, 4, 30))

VIEWS["value_v"] = "SELECT style, unnest([" + ", ".join(f"'{a}'" for a in ATTRIBUTES) + "]) AS attribute, unnest([" + ", ".join(ATTRIBUTES) + "]) AS value FROM attributes_v"
VIEWS["block_v"] = """SELECT attribute, value, block, units, active, CASE WHEN total > 0 THEN adj / total * 100 ELSE 0 END AS share FROM (SELECT attribute, value, block, sum(qty) AS units, sum(adj) AS adj, count(*) FILTER (WHERE qty > 0) AS active
 FROM (SELECT style, CAST(floor(("offset" + 23) / 4) AS INT) AS block, sum(qty) AS qty, sum(adj) AS adj FROM adj_v WHERE "offset" > -24 GROUP BY ALL) JOIN value_v USING (style) GROUP BY ALL) JOIN (SELECT CAST(floor(("offset" + 23) / 4) AS INT) AS block, sum(adj) AS total FROM adj_v WHERE "offset" > -24 GROUP BY ALL) USING (block)"""
_SHARES = ", ".join(f"round_even(coalesce(sum(share) FILTER (WHERE block = {k}), 0), 9)" for k in range(6))
VIEWS["status_v"] = f"""SELECT *, CASE WHEN NOT on_sale THEN 'out' WHEN change >= 30 THEN 'trending' WHEN peak > 0 AND now <= 0.5 * peak AND coalesce(change, 0) <= 0 THEN 'out' WHEN change <= -30 THEN 'fading' ELSE 'steady' END AS stage FROM (
 SELECT *, now_units >= 20 AND active_styles >= 2 AS on_sale, CASE WHEN units_before >= 30 AND before > 0 THEN (now / before - 1) * 100 END AS change FROM (SELECT *, s[6] AS now, s[5] AS before, list_max(s) AS peak FROM (
 SELECT attribute, value, [{_SHARES}] AS s, max(units) AS most, coalesce(sum(units) FILTER (WHERE block = 4), 0) AS units_before, CAST(coalesce(sum(units) FILTER (WHERE block = 5), 0) AS BIGINT) AS now_units, CAST(coalesce(sum(active) FILTER (WHERE block = 5), 0) AS BIGINT) AS active_styles FROM block_v GROUP BY attribute, value) WHERE most >= 20))"""
_OF = "CASE WHEN {1} > 0 THEN {0} / {1} ELSE 0 END"
VIEWS["known_v"] = """SELECT o.style, category, sub_category, a.style IS NOT NULL AS known, o.units AS all_units, se.units AS season_units, coalesce(m_now, 0) AS m_now, coalesce(m_ago, 0) AS m_ago, coalesce(t.now, 0) AS t_now, coalesce(t.before, 0) AS t_before, coalesce(real_now, 0) AS real_now
 FROM (SELECT style, sum(qty) AS units FROM sales_v GROUP BY style) o LEFT JOIN (SELECT style, category, sub_category FROM attributes_v) a ON o.style = a.style LEFT JOIN (SELECT style, sum(qty) AS units FROM sales_v WHERE day BETWEEN DATE '2000-02-01' AND DATE '2000-04-30' GROUP BY style) se ON o.style = se.style
 LEFT JOIN (SELECT style, sum(CASE WHEN "offset" > -8 THEN adj ELSE 0 END) AS m_now, sum(CASE WHEN "offset" <= -48 THEN adj ELSE 0 END) AS m_ago FROM adj_v GROUP BY style) m ON o.style = m.style LEFT JOIN trend_v t ON o.style = t.style"""


def _ranked_sql(scope: str, upcoming: bool = False) -> str:
    """SQL of the ranking; scope is an expression over known_v."""
    weights = rankings.UPCOMING if upcoming else rankings.RUNNING
    base = f"(SELECT *, {scope} AS scope FROM known_v)" + ("" if scope == "'ALL'" else "")
    where = "" if scope == "'ALL'" else " WHERE scope IS NOT NULL AND scope <> ''"
    sure = "least(1.0, active_styles / 5) * least(1.0, t_now / 100)"
    if upcoming:
        sure = f"(least(1.0, styles / 5) * least(1.0, units / 200) + {sure}) / 2"
    r = lambda e, d: f"round_even(round_even({e}, 8), {d})"

    def rank(c: str) -> str:
        if c == "stage":
            return "CASE stage WHEN 'trending' THEN 1.0 WHEN 'steady' THEN CAST(2 AS DOUBLE) / 3 WHEN 'fading' THEN CAST(1 AS DOUBLE) / 3 WHEN 'out' THEN 0.0 ELSE 0.5 END"
        v = f"(CASE WHEN last_season THEN {c} END)" if c in ("lift", "per_style") else c
        return f"CASE WHEN {v} IS NULL THEN 0.5 ELSE (rank() OVER (PARTITION BY scope, attribute, {v} IS NULL ORDER BY {v}) + (count(*) OVER (PARTITION BY scope, attribute, {v}) - 1) / 2) / count(*) OVER (PARTITION BY scope, attribute, {v} IS NULL) END"

    raw = " + ".join(f"CAST({w} AS DOUBLE) * ({rank(c)})" for c, w in weights.items())
    return f"""SELECT *, CAST({r(f"100 * ({raw}) * (0.5 + 0.5 * confidence)", 0)} AS INT) AS score FROM (SELECT x.*, CASE WHEN x.attribute IN ('category', 'sub_category', 'colour', 'fabric') THEN coalesce(st.stage, 'none') END AS stage FROM (
 SELECT scope, attribute, value, CAST(units AS BIGINT) AS units, styles, {r("share_s * 100", 1)} AS share, {r("CASE WHEN last_season AND share_a > 0 THEN share_s / share_a ELSE 1.0 END", 2)} AS lift, {r("CASE WHEN last_season THEN (units + 5 * avg_last) / (styles + 5) ELSE 0.0 END", 1)} AS per_style,
 {r("CASE WHEN m_ago >= 20 THEN (m_now - m_ago) / m_ago * 100 END", 1)} AS momentum, {r(sure, 2)} AS confidence, {r("CASE WHEN t_before >= 30 AND share_b > 0 THEN (share_n / share_b - 1) * 100 END", 1)} AS trend, {r("share_n * 100", 1)} AS now_share, active_styles, CAST({r("t_now", 0)} AS BIGINT) AS now_units,
 {r("(t_now + 5 * avg_now) / (active_styles + 5)", 1)} AS now_per_style, last_season, avg_now, avg_last FROM (SELECT *, {_OF.format("units", "all_season")} AS share_s, {_OF.format("all_units", "all_all")} AS share_a, {_OF.format("t_now", "all_now")} AS share_n, {_OF.format("t_before", "all_before")} AS share_b FROM (
 SELECT g.*, n >= 2 AS last_season, CASE WHEN n >= 2 THEN n ELSE 0 END AS styles, CASE WHEN n >= 2 THEN season_units ELSE 0 END AS units, t.* EXCLUDE (scope) FROM (SELECT scope, attribute, value, sum(season_units) AS season_units, count(season_units) AS n, sum(all_units) AS all_units, sum(m_now) AS m_now, sum(m_ago) AS m_ago, sum(t_now) AS t_now, sum(t_before) AS t_before, count(*) FILTER (WHERE real_now > 0) AS active_styles
 FROM {base} JOIN value_v USING (style){where} GROUP BY ALL) g JOIN (SELECT scope, sum(t_now) AS all_now, sum(t_before) AS all_before, coalesce(sum(season_units) FILTER (WHERE known), 0) AS all_season, coalesce(sum(all_units) FILTER (WHERE known), 0) AS all_all, sum(t_now) / greatest(1, count(*) FILTER (WHERE real_now > 0)) AS avg_now, coalesce(sum(season_units) FILTER (WHERE known), 0) / greatest(1, count(season_units) FILTER (WHERE known)) AS avg_last FROM {base}{where} GROUP BY scope) t ON g.scope = t.scope
 WHERE active_styles >= 2 AND greatest(m_now, t_now) >= 20))) x LEFT JOIN status_v st ON x.attribute = st.attribute AND x.value = st.value)"""


VIEWS["ranked_all_v"], VIEWS["ranked_next_v"], VIEWS["ranked_sub_v"] = _ranked_sql("'ALL'"), _ranked_sql("'ALL'", upcoming=True), _ranked_sql("sub_category")
VIEWS["ahead_v"] = "SELECT id, chunk_start, forecast, actual, state, (year(chunk_start) * 12 + month(chunk_start) - 1) * 4 + CASE WHEN day(chunk_start) <= 7 THEN 0 WHEN day(chunk_start) <= 15 THEN 1 WHEN day(chunk_start) <= 23 THEN 2 ELSE 3 END - 96076 AS ahead FROM cell_v"
_VALUES = "attribute, value, units, styles, share, lift, per_style, momentum, confidence, trend, now_share, active_styles, now_units, now_per_style, last_season, stage, score"


def _status(spark, sf, f):
    return rankings.trend_status(f, rankings.long(view(spark, sf, "attributes_v"), ATTRIBUTES))


def _ranked(spark, sf, scope=None, weights=None):
    """The ranking and the stages it uses."""
    styles, f, base = view(spark, sf, "attributes_v"), frame(spark, sf), sales(spark, sf)
    units = lambda df: df.groupBy("style").agg(F.sum("qty").alias("units"))
    ev = rankings.evidence(units(base), units(base.where(F.col("day").between(*map(F.lit, SEASON)))), design.momentum(f), design.trend(f), styles, scope)
    stages = _status(spark, sf, f)
    return rankings.ranked(ev, rankings.long(styles, ATTRIBUTES), stages, weights), stages


@query("d6_trend_status", "SELECT attribute, value, stage, " + ", ".join(f"round_even(s[{k}], 6) AS share_{k}" for k in range(1, 7)) + ", round_even(change, 6) AS change, CASE WHEN peak > 0 THEN round_even((now / peak - 1) * 100, 6) END AS from_peak_pct, CAST(list_position(s, peak) - 1 AS INT) AS peak_block, now_units, active_styles, on_sale, round_even(now - before, 6) AS gain FROM status_v")
def d6(spark, sf):
    return _status(spark, sf, frame(spark, sf))


@query(
    "d7_spikes",
    """WITH y AS (SELECT style, sum(CASE WHEN "offset" = -1 THEN qty ELSE 0 END) AS qn, sum(CASE WHEN "offset" = -1 THEN adj ELSE 0 END) AS an, sum(CASE WHEN "offset" < -1 THEN qty ELSE 0 END) AS qb, sum(CASE WHEN "offset" < -1 THEN adj ELSE 0 END) AS ab FROM adj_v WHERE "offset" BETWEEN -5 AND -1 GROUP BY style),
t AS (SELECT sum(an) AS tn, sum(ab) AS tb FROM y), v AS (SELECT attribute, value, sum(qn) AS qn, sum(an) AS an, sum(qb) AS qb, sum(ab) AS ab, count(*) FILTER (WHERE qn > 0) AS active_styles FROM y JOIN value_v USING (style) GROUP BY ALL),
w AS (SELECT *, round_even(an / tn * 100, 9) AS sn, round_even(ab / tb * 100, 9) AS sb, qb < 20 AS new FROM v, t WHERE tn > 0 AND tb > 0 AND qn >= 20 AND active_styles >= 2)
SELECT attribute, value, CASE WHEN NOT new AND sb > 0 THEN round_even(sn / sb, 6) END AS ratio, CAST(qn AS BIGINT) AS units, round_even(sn, 6) AS share, round_even(sb, 6) AS usual_share, active_styles, new FROM w WHERE sn - sb >= 0.1 AND (new OR (sb > 0 AND sn / sb >= 1.5))""",
)
def d7(spark, sf):
    return rankings.spikes(frame(spark, sf), rankings.long(view(spark, sf, "attributes_v"), ATTRIBUTES), TODAY)


@query("d10_attribute_ranking", f"SELECT {_VALUES} FROM ranked_all_v")
def d10(spark, sf):
    return _ranked(spark, sf)[0].drop("scope", "avg_now", "avg_last")


@query("d10_upcoming_ranking", f"SELECT {_VALUES} FROM ranked_next_v")
def d10_upcoming(spark, sf):
    return _ranked(spark, sf, weights=rankings.UPCOMING)[0].drop("scope", "avg_now", "avg_last")


@query("d11_sub_category_ranking", f"SELECT scope AS sub_category, {_VALUES} FROM ranked_sub_v")
def d11(spark, sf):
    return _ranked(spark, sf, "sub_category")[0].drop("avg_now", "avg_last").withColumnRenamed("scope", "sub_category")


VIEWS["opp_v"] = """WITH p AS (SELECT * FROM ranked_sub_v WHERE attribute IN ('colour', 'fabric')), c AS (SELECT scope, attribute, list_sort(list(active_styles))[CAST(floor(count(*) / 2) + 1 AS INT)] AS med FROM p GROUP BY ALL HAVING count(*) >= 3),
m AS (SELECT p.*, med, CASE WHEN (p.stage IS NULL OR p.stage IN ('trending', 'steady')) AND coalesce(st.stage, 'none') IN ('trending', 'steady') THEN d ELSE least(d, -1) END AS move FROM (SELECT *, CASE WHEN coalesce(trend, momentum) >= 30 THEN 1 WHEN coalesce(trend, momentum) <= -30 THEN -1 ELSE 0 END AS d FROM p) p JOIN c USING (scope, attribute) LEFT JOIN (SELECT value, stage FROM status_v WHERE attribute = 'sub_category') st ON p.scope = st.value WHERE avg_now > 0),
k AS (SELECT *, CASE WHEN now_per_style >= 1.3 * avg_now AND active_styles <= greatest(2, med) AND move >= 0 THEN 'gap' WHEN move < 0 AND last_season AND per_style >= avg_last THEN 'declining' WHEN now_per_style <= 0.7 * avg_now AND active_styles >= greatest(4, 1.5 * med) AND move <= 0 THEN 'saturated' WHEN move > 0 THEN 'rising' END AS kind FROM m)
SELECT kind, scope AS sub_category, attribute, value, active_styles AS styles, units, now_per_style AS per_style, round_even(round_even(avg_now, 8), 1) AS average, momentum, trend, score FROM k WHERE kind IS NOT NULL"""


@query("d12_opportunities", "SELECT * FROM opp_v")
def d12(spark, sf):
    scored, stages = _ranked(spark, sf, "sub_category")
    return rankings.opportunities(scored.where("attribute IN ('colour', 'fabric')"), stages)


@query("d20_expected_sale", "SELECT id, CAST(sum(forecast) AS BIGINT) AS expected, CAST(sum(CASE WHEN ahead = 0 THEN actual ELSE 0 END) AS BIGINT) AS sold_so_far FROM ahead_v WHERE ahead BETWEEN 0 AND 8 GROUP BY id")
def d20(spark, sf):
    return report.expected_sale(report_cells(spark, sf), TODAY)


_SETS = "SELECT coalesce(id, 'TOTAL') AS id, coalesce(month, 'TOTAL') AS month, chunk_start, CAST(sum(forecast) AS BIGINT) AS forecast FROM (SELECT *, strftime(chunk_start, '%Y-%m') AS month FROM ahead_v WHERE {}) GROUP BY GROUPING SETS ((id, month, chunk_start), (id, month), (id), (month, chunk_start), (month), ())"


@query("g9_latest_forecast", _SETS.format("ahead BETWEEN 0 AND 12"))
def g9_latest(spark, sf):
    return report.forecast_table(report_cells(spark, sf), TODAY)


@query("g9_frozen_forecast", _SETS.format("ahead BETWEEN -4 AND 12 AND forecast > 0"))
def g9_frozen(spark, sf):
    return report.forecast_table(report_cells(spark, sf).where("forecast > 0"), TODAY, past_weeks=4)


@query(
    "a20_tier_forecast",
    """WITH tier AS (SELECT name AS id, max_by(tier, effective_from) AS tier FROM tier_history_v GROUP BY name), s AS (SELECT id, date_trunc('month', chunk_start) AS m, sum(forecast) AS units FROM ahead_v WHERE ahead BETWEEN -4 AND 12 AND chunk_start >= DATE '2001-08-01' AND chunk_start < DATE '2001-11-01' GROUP BY ALL HAVING sum(forecast) > 0),
u AS (SELECT m, coalesce(tier, 'Unclassified') AS tier, count(*) AS styles, sum(units) AS units FROM s LEFT JOIN tier USING (id) GROUP BY ALL), a AS (SELECT DATE '2001-07-01' AS m, coalesce(tier, 'Unclassified') AS tier, sum(qty) AS units FROM sales_v LEFT JOIN tier ON style = id WHERE month = '2001-07' GROUP BY ALL), p AS (SELECT m, tier, units FROM u UNION ALL SELECT * FROM a),
g AS (SELECT k AS m, tier FROM (SELECT DISTINCT tier FROM u), (SELECT unnest([DATE '2001-08-01', DATE '2001-09-01', DATE '2001-10-01']) AS k))
SELECT strftime(g.m, '%Y-%m') AS month, g.tier, CAST(coalesce(styles, 0) AS BIGINT) AS styles, CAST(coalesce(u.units, 0) AS BIGINT) AS units, CAST(coalesce(p.units, 0) AS BIGINT) AS prev_units, g.m > DATE '2001-08-01' AS prev_is_forecast, CASE WHEN p.units > 0 THEN round_even((coalesce(u.units, 0) - p.units) / p.units * 100, 1) END AS change_pct
FROM g LEFT JOIN u ON g.m = u.m AND g.tier = u.tier LEFT JOIN p ON p.m = g.m - INTERVAL 1 MONTH AND p.tier = g.tier""",
)
def a20(spark, sf):
    actual = sales(spark, sf).select("style", "month", "qty")
    return report.tier_forecast(report_cells(spark, sf), actual, joins.current_tier(view(spark, sf, "tier_history_v")), TODAY)
