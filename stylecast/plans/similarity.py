"""Queries: similar designs and cold start."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import joins, panel, similarity
from ..registry import query
from ..sources import orders
from .base import once
from .fixtures import VIEWS, view
from .panel import LAST, launches, weekly

_COLS = ("sub_category", "colour", "fabric", "neck", "embroidery")
VIEWS["token_v"] = "SELECT DISTINCT style AS design, unnest([" + ", ".join(f"'{c.upper()}:' || upper({c})" for c in _COLS) + "]) AS token, category AS grp FROM attributes_v"
VIEWS["idf_v"] = "SELECT token, count(DISTINCT design) AS df, ln((SELECT count(DISTINCT design) FROM token_v) / count(DISTINCT design)) + 1 AS idf FROM token_v GROUP BY token"
VIEWS["edge_v"] = """SELECT design, other, sim FROM (SELECT a.design, b.design AS other, round_even(sum(idf) / (any_value(ta.w) + any_value(tb.w) - sum(idf)), 9) AS sim FROM token_v a JOIN token_v b ON a.token = b.token AND a.design <> b.design AND a.grp = b.grp JOIN idf_v ON idf_v.token = a.token
 JOIN (SELECT design, sum(idf) AS w FROM token_v JOIN idf_v USING (token) GROUP BY design) ta ON ta.design = a.design JOIN (SELECT design, sum(idf) AS w FROM token_v JOIN idf_v USING (token) GROUP BY design) tb ON tb.design = b.design GROUP BY a.design, b.design)"""
VIEWS["near_v"] = "SELECT design, other, sim, row_number() OVER (PARTITION BY design ORDER BY sim DESC, other) AS rank FROM edge_v QUALIFY rank <= 6"
VIEWS["donor_v"] = "SELECT n.* FROM near_v n LEFT JOIN launch_v l ON n.other = l.id WHERE launch IS NULL OR DATE '1999-06-07' - launch >= 90 OR sim >= 0.9"
VIEWS["level_v"] = "SELECT id, median(y) AS level FROM weekly_v WHERE week > DATE '2001-07-30' - 84 GROUP BY id"
VIEWS["offset_v"] = "SELECT id, CAST(floor((week - launch) / 7) AS INT) AS offset_, CAST(sum(y) AS BIGINT) AS qty FROM weekly_v JOIN launch_v USING (id) WHERE week >= launch GROUP BY ALL"
AS_OF = date(1999, 6, 7)


def tokens(spark, sf):
    return similarity.attribute_tokens(view(spark, sf, "attributes_v"), _COLS, "category")


def near(spark, sf):
    return similarity.neighbours(similarity.pairs(tokens(spark, sf)))


def donor_edges(spark, sf):
    return similarity.donors(near(spark, sf), launches(spark, sf), AS_OF)


@query("s5_bom_materials", "SELECT DISTINCT token AS material, design FROM bom_v")
def s5(spark, sf):
    listed = view(spark, sf, "bom_v").groupBy("token").agg(F.array_join(F.collect_set(F.concat(F.lower("design"), F.lit(" "))), ",").alias("USED_IN"))
    return orders.materials(listed.withColumnRenamed("token", "ARTICLE_GROUP"))


@query("k1_token_weights", "SELECT token, df, idf FROM idf_v")
def k1(spark, sf):
    return similarity.token_weights(tokens(spark, sf))


@query("k2_weighted_jaccard", "SELECT * FROM edge_v")
def k2(spark, sf):
    return similarity.pairs(tokens(spark, sf))


def profiled(spark, sf):
    """The designs' tokens with weights, written once: both sides of the join and the weighing start from them."""
    return once(spark, sf, "profiles", lambda: similarity.profiles(tokens(spark, sf)))


@query("k2_similar_over_half", "SELECT design, other, sim FROM edge_v WHERE design < other AND sim >= 0.5")
def k2_over(spark, sf):
    return similarity.pairs_over(profiled(spark, sf), 0.5).drop("grp")


_CATEGORY_PAIRS = "SELECT category, design, other, sim FROM edge_v JOIN (SELECT style, category FROM attributes_v) a ON a.style = design WHERE design < other"


@query("j10_category_pairs", _CATEGORY_PAIRS)
def j10(spark, sf):
    rows = tokens(spark, sf)
    return similarity.pairs(rows).where("design < other").join(rows.select("design", F.col("grp").alias("category")).distinct(), "design")


@query("j10_category_pairs_over", f"{_CATEGORY_PAIRS} AND sim >= 0.3")
def j10_over(spark, sf):
    return similarity.pairs_over(profiled(spark, sf), 0.3).withColumnRenamed("grp", "category")


@query(
    "j9_alike_materials",
    """WITH i AS (SELECT token, ln((SELECT count(DISTINCT design) FROM bom_v) / count(DISTINCT design)) + 1 AS idf FROM bom_v GROUP BY token), w AS (SELECT design, sum(idf) AS total FROM bom_v JOIN i USING (token) GROUP BY design),
s AS (SELECT a.design, b.design AS other, sum(idf) AS shared FROM bom_v a JOIN bom_v b ON a.token = b.token AND a.design < b.design JOIN i ON i.token = a.token GROUP BY ALL)
SELECT s.design, s.other, round_even(shared / (x.total + y.total - shared), 9) AS sim FROM s JOIN w x ON x.design = s.design JOIN w y ON y.design = s.other WHERE round_even(shared / (x.total + y.total - shared), 9) >= 0.1""",
)
def j9_over(spark, sf):
    rows = view(spark, sf, "bom_v").withColumn("grp", F.lit(None).cast("string"))
    return similarity.pairs_over(once(spark, sf, "materials", lambda: similarity.profiles(rows)), 0.1).drop("grp")


@query("k3_attribute_tokens", "SELECT * FROM token_v")
def k3(spark, sf):
    return tokens(spark, sf)


@query("j9_shared_material_pairs", "SELECT DISTINCT a.design, b.design AS other FROM bom_v a JOIN bom_v b USING (token) WHERE a.design <> b.design")
def j9(spark, sf):
    rows = view(spark, sf, "bom_v").withColumn("grp", F.lit(None).cast("string"))
    return similarity.pairs(rows).select("design", "other")


@query("j14_filled_edges", "SELECT design, other, sim FROM near_v WHERE design LIKE '00%' UNION ALL SELECT design, other, 0.5 AS sim FROM near_v WHERE design NOT LIKE '00%'")
def j14(spark, sf):
    edges = near(spark, sf).select("design", "other", "sim")
    return joins.filled_edges(edges.where("design LIKE '00%'"), edges.withColumn("sim", F.lit(0.5)))


@query("w10_top_neighbours", "SELECT * FROM near_v")
def w10(spark, sf):
    return near(spark, sf)


@query("k4_donor_eligibility", "SELECT design, other, sim, rank FROM donor_v")
def k4(spark, sf):
    return donor_edges(spark, sf)


@query("k5_similar_designs", "SELECT n.design, n.other, sim, rank, string_agg(a.token, ',' ORDER BY a.token) AS shared FROM near_v n JOIN token_v a ON a.design = n.design JOIN token_v b ON b.design = n.other AND a.token = b.token GROUP BY ALL")
def k5(spark, sf):
    return similarity.similar_designs(near(spark, sf), tokens(spark, sf))


@query("k6_borrowed_level", "SELECT design AS id, round_even(sum(sim * level) / sum(sim), 6) AS level FROM donor_v JOIN level_v ON other = id WHERE level > 0 GROUP BY design")
def k6(spark, sf):
    levels = panel.recent_level(weekly(spark, sf), LAST)
    return similarity.borrowed_level(donor_edges(spark, sf), levels).withColumn("level", F.bround("level", 6))


_CURVE = """WITH e AS (SELECT id, avg(qty) AS early FROM offset_v WHERE offset_ BETWEEN 0 AND 2 GROUP BY id), c AS (SELECT d.design AS id, CAST(o.offset_ - 3 AS INT) AS step, sum(sim * qty * CASE WHEN coalesce(de.early, 0) > 0 THEN own.early / de.early ELSE 1 END) / sum(sim) AS qty
FROM donor_v d JOIN offset_v o ON o.id = d.other AND o.offset_ BETWEEN 3 AND 8 LEFT JOIN e de ON de.id = d.other JOIN e own ON own.id = d.design GROUP BY ALL)"""


def _curve(spark, sf):
    offsets = similarity.since_launch(weekly(spark, sf), launches(spark, sf))
    own = offsets.where("offset BETWEEN 0 AND 2").groupBy("id").agg(F.avg("qty").alias("early"))
    return similarity.borrowed_curve(donor_edges(spark, sf), offsets, 3, own)


@query("k7_borrowed_curve", f"{_CURVE} SELECT id, step, round_even(qty, 6) AS qty FROM c")
def k7(spark, sf):
    return _curve(spark, sf).withColumn("qty", F.bround("qty", 6))


@query("k8_weeks_since_launch", "SELECT id, offset_ AS \"offset\", qty FROM offset_v")
def k8(spark, sf):
    return similarity.since_launch(weekly(spark, sf), launches(spark, sf))


@query(
    "k9_cold_start_blend",
    f"""{_CURVE}, t AS (SELECT name, max_by(tier, effective_from) AS tier FROM tier_history_v GROUP BY name), k AS (SELECT o.id, count(*) AS n, bool_or(offset_ >= 4) AS saw, coalesce(any_value(tier), 'Unknown') AS tier FROM offset_v o LEFT JOIN t ON o.id = t.name WHERE offset_ < 10 GROUP BY o.id),
q AS (SELECT id, CASE WHEN saw THEN least(1.0, n / 13) ELSE least(0.5, n / 13) END AS c, tier FROM k), z AS (SELECT id, CASE tier WHEN 'T0' THEN least(0.3, c) WHEN 'T1' THEN least(0.6, c) WHEN 'T2' THEN least(0.8, c) ELSE c END AS c FROM q), f AS (SELECT id, step, 40.0 AS qty FROM (SELECT DISTINCT id FROM offset_v), (SELECT CAST(unnest(range(8)) AS INT) AS step))
SELECT f.id, f.step, round_even(CASE WHEN c.qty IS NOT NULL THEN coalesce(z.c, 1) * f.qty + (1 - coalesce(z.c, 1)) * c.qty ELSE f.qty END, 6) AS qty FROM f LEFT JOIN c ON c.id = f.id AND c.step = f.step LEFT JOIN z ON z.id = f.id""",
)
def k9(spark, sf):
    offsets = similarity.since_launch(weekly(spark, sf), launches(spark, sf))
    tiers = joins.current_tier(view(spark, sf, "tier_history_v")).withColumnRenamed("style", "id")
    own = offsets.where(F.col("offset") < 10).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("offset") >= 4).alias("saw")).join(tiers, "id", "left").fillna("Unknown", ["tier"])
    trust = own.select("id", similarity.confidence(F.col("n"), F.col("saw"), F.col("tier")).alias("confidence"))
    forecast = offsets.select("id").distinct().crossJoin(spark.range(8).select(F.col("id").cast("int").alias("step"))).withColumn("qty", F.lit(40.0))
    return similarity.cold_start(forecast, _curve(spark, sf), trust).withColumn("qty", F.bround("qty", 6))
