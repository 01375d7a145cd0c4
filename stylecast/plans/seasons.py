"""Queries: the model of seasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rankings, seasons
from ..operators.model import ATTRIBUTES
from ..registry import query
from .base import once, sales
from .fixtures import TODAY, VIEWS, view
from .rankings import _ranked

#: Variance power and ridge of each setting.
GRID = tuple((power, ridge) for power in (1.3, 1.5, 1.7) for ridge in (0.01, 0.1))
RUNNING_SEASON = "S4"

_ORD = "(year({0}) * 12 + month({0}) - 1) * 4 + CASE WHEN day({0}) <= 7 THEN 0 WHEN day({0}) <= 15 THEN 1 WHEN day({0}) <= 23 THEN 2 ELSE 3 END"
_SEASON = "CASE WHEN month({0}) IN (11, 12, 1) THEN 'S1' WHEN month({0}) IN (2, 3, 4) THEN 'S2' WHEN month({0}) IN (5, 6, 7) THEN 'S3' ELSE 'S4' END"
_YEAR = "CAST(year({0}) - CASE WHEN month({0}) = 1 THEN 1 ELSE 0 END AS INT)"
_START = "make_date(year, CASE season WHEN 'S1' THEN 11 WHEN 'S2' THEN 2 WHEN 'S3' THEN 5 ELSE 8 END, 1)"
VIEWS["season_v"] = f"""SELECT season, year, start, "end" FROM (SELECT *, CAST(start + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS "end" FROM (SELECT *, {_START} AS start FROM (SELECT DISTINCT {_SEASON.format('day')} AS season, {_YEAR.format('day')} AS year FROM sales_v)))
 WHERE "end" < DATE '{TODAY.isoformat()}' AND start >= (SELECT min(day) FROM sales_v) - 3"""
VIEWS["then_v"] = f"""SELECT season, year, style, channel, CAST(o - last AS INT) AS "offset", qty FROM (SELECT style, marketplace AS channel, {_ORD.format('day')} AS o, sum(qty) AS qty FROM sales_v GROUP BY ALL) JOIN (SELECT season, year, {_ORD.format('(start - 1)')} AS last FROM season_v) ON o > last - 24 AND o <= last"""
VIEWS["then_adj_v"] = """SELECT c.*, CAST(floor(("offset" + 23) / 4) AS INT) AS block, CASE WHEN tc > 0 THEN qty * w * t / tc ELSE 0 END AS adj FROM (SELECT *, sum(qty) OVER (PARTITION BY season, year, "offset") AS t, sum(qty) OVER (PARTITION BY season, year, "offset", channel) AS tc FROM then_v) c
 JOIN (SELECT season, year, channel, sum(qty) / sum(sum(qty)) OVER (PARTITION BY season, year) AS w FROM then_v GROUP BY season, year, channel) u USING (season, year, channel)"""
VIEWS["then_block_v"] = """SELECT season, year, attribute, value, block, units, active, CASE WHEN total > 0 THEN adj / total * 100 ELSE 0 END AS share FROM (SELECT season, year, attribute, value, block, sum(qty) AS units, sum(adj) AS adj, count(*) FILTER (WHERE qty > 0) AS active
 FROM (SELECT season, year, style, block, sum(qty) AS qty, sum(adj) AS adj FROM then_adj_v GROUP BY ALL) JOIN value_v USING (style) GROUP BY ALL) JOIN (SELECT season, year, block, sum(adj) AS total FROM then_adj_v GROUP BY ALL) USING (season, year, block)"""
_SHARES = ", ".join(f"round_even(coalesce(sum(share) FILTER (WHERE block = {k}), 0), 9)" for k in range(6))
VIEWS["then_status_v"] = f"""SELECT season, year, attribute, value, CASE WHEN NOT on_sale THEN 'out' WHEN change >= 30 THEN 'trending' WHEN peak > 0 AND now <= 0.5 * peak AND coalesce(change, 0) <= 0 THEN 'out' WHEN change <= -30 THEN 'fading' ELSE 'steady' END AS stage FROM (
 SELECT *, now_units >= 20 AND active_styles >= 2 AS on_sale, CASE WHEN units_before >= 30 AND before > 0 THEN (now / before - 1) * 100 END AS change FROM (SELECT *, s[6] AS now, s[5] AS before, list_max(s) AS peak FROM (
 SELECT season, year, attribute, value, [{_SHARES}] AS s, max(units) AS most, coalesce(sum(units) FILTER (WHERE block = 4), 0) AS units_before, coalesce(sum(units) FILTER (WHERE block = 5), 0) AS now_units, coalesce(sum(active) FILTER (WHERE block = 5), 0) AS active_styles FROM then_block_v GROUP BY ALL) WHERE most >= 20))"""
VIEWS["price_v"] = "SELECT style, round_even(CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) / sum(qty), 4) AS price FROM sales_v GROUP BY style"
_EDGES = ", ".join(f"round_even(quantile_cont(price, {k / 5}), 6)" for k in range(1, 6))
VIEWS["band_v"] = f"SELECT style, CASE WHEN n >= 10 THEN len(list_filter(list_distinct(edges), lambda e: e > low AND e < price)) END AS price_band FROM price_v, (SELECT count(*) AS n, [{_EDGES}] AS edges, round_even(quantile_cont(price, 0), 6) AS low FROM price_v)"
_SAID = ", ".join(f"CASE WHEN coalesce({a}, '') = '' THEN 'Unknown' ELSE {a} END AS {a}" for a in ATTRIBUTES)
_STAGES = ", ".join(f"coalesce(s{k}.stage, 'none') AS {a}_stage" for k, a in enumerate(rankings.TRACKED))
_JOINS = " ".join(f"LEFT JOIN then_status_v s{k} ON s{k}.attribute = '{a}' AND s{k}.value = r.{a} AND s{k}.season = r.season AND s{k}.year = r.year" for k, a in enumerate(rankings.TRACKED))
VIEWS["training_v"] = f"""SELECT *, least(CAST(units AS DOUBLE), cap) AS y FROM (SELECT *, round_even(quantile_cont(units, 0.99) OVER (), 6) AS cap FROM (
 SELECT r.style, r.season, r.year, {", ".join(f"r.{a}" for a in ATTRIBUTES)}, {_STAGES}, CAST(price_band AS INT) AS price_band, round_even(greatest(0, (start - first) / CAST(91 AS DOUBLE)), 1) AS age_quarters, CAST(coalesce(units, 0) AS BIGINT) AS units
 FROM (SELECT a.*, f.first, season_v.* FROM (SELECT style, {_SAID} FROM attributes_v) a JOIN (SELECT style, min(day) AS first FROM sales_v GROUP BY style) f USING (style) JOIN season_v ON first <= "end") r
 LEFT JOIN (SELECT style, {_SEASON.format('day')} AS season, {_YEAR.format('day')} AS year, sum(qty) AS units FROM sales_v GROUP BY ALL) u USING (style, season, year) LEFT JOIN band_v USING (style) {_JOINS}))"""


def training(spark, sf):
    """The training rows, written once as each fit reads them."""

    def make():
        base = sales(spark, sf).withColumnRenamed("marketplace", "channel")
        prices = base.groupBy("style").agg(F.bround(F.sum(F.col("total").cast("decimal(18,2)")).cast("double") / F.sum("qty"), 4).alias("price"))
        styles, over = view(spark, sf, "attributes_v"), once(spark, sf, "seasons", lambda: seasons.occurrences(base, TODAY))
        stages = once(spark, sf, "season_stages", lambda: seasons.stages_at_start(base, rankings.long(styles, rankings.TRACKED), over))
        return seasons.training_rows(base, styles, prices, over, stages)

    return once(spark, sf, "season_rows", make)


def _vectors(spark, sf):
    made, labels = seasons.vectors(training(spark, sf))
    return once(spark, sf, "season_vectors", lambda: made), labels


def _chosen(spark, sf):
    return once(spark, sf, "season_setting", lambda: seasons.chosen_setting(seasons.out_of_fold(_vectors(spark, sf)[0], GRID)))


def fitted(spark, sf):
    """The model of all rows at the best setting."""
    rows, labels = _vectors(spark, sf)
    best = _chosen(spark, sf).where("chosen").first()
    return seasons.fitted(rows, labels, (best["power"], best["ridge"]))


@query("d13_training_rows", "SELECT * FROM training_v")
def d13(spark, sf):
    return training(spark, sf)


@query("d14_style_folds", "SELECT style, CAST(CAST('0x' || substr(md5(style), 1, 8) AS BIGINT) % 5 AS INT) AS fold, count(*) AS n_rows FROM training_v GROUP BY style")
def d14(spark, sf):
    return training(spark, sf).groupBy("style", seasons.style_fold(F.col("style")).alias("fold")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("d15_chosen_setting")
def d15(spark, sf):
    rounded = F.transform("fold_wapes", lambda w: F.bround(w, 3))
    return _chosen(spark, sf).withColumns({c: F.bround(c, 3) for c in ("wape", "baseline_wape")} | {"fold_wapes": rounded})


@query("d16_attribute_effects")
def d16(spark, sf):
    parts = seasons.contributions(training(spark, sf), fitted(spark, sf))
    return seasons.attribute_effects(parts, RUNNING_SEASON, _ranked(spark, sf)[0])
