"""Queries: the running week's projection and what follows from it (D1, with D6 and D7), product cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import design, festival, products, rankings, report, seasons
from ..registry import query
from .base import once, sales
from .design import frame
from .festival import _effects, _events, daily
from .fixtures import TODAY, VIEWS, view
from .rankings import ATTRIBUTES, _ranked, _status
from .report import report_cells, weekly_forecast
from .seasons import RUNNING_SEASON, fitted

VIEWS["expected_v"] = """SELECT e.style, CASE WHEN coalesce(sub_category, '') = '' THEN '_' ELSE sub_category END AS grp, done, rest FROM (
 SELECT style, coalesce(forecast * 1 / 7, weekly / 7 * f_done) AS done, coalesce(forecast * 6 / 7, weekly / 7 * f_rest) AS rest
 FROM (SELECT id AS style, qty AS weekly FROM fc_style_v WHERE week = (SELECT min(week) FROM fc_style_v)) FULL JOIN (SELECT id AS style, qty AS forecast FROM bucket_v WHERE chunk_start = DATE '2001-08-01' AND id IN (SELECT name FROM tier_history_v)) USING (style),
  (SELECT 1 + coalesce(sum(factor - 1) FILTER (WHERE day = DATE '2001-08-01'), 0) AS f_done, 6 + coalesce(sum(factor - 1) FILTER (WHERE day BETWEEN DATE '2001-08-02' AND DATE '2001-08-07'), 0) AS f_rest FROM factors_v)) e LEFT JOIN attributes_v a ON a.style = e.style"""
VIEWS["proj_v"] = """SELECT u.style, coalesce(m.channel, x.channel) AS channel, units * coalesce(m.share, x.share) AS units FROM (
 SELECT style, rest * pace AS units FROM expected_v JOIN (SELECT grp, least(2.0, greatest(0.5, 1 + (CASE WHEN planned > 0 THEN made / planned ELSE 1 END - 1) * 0.25)) AS pace FROM (SELECT grp, sum(coalesce(so_far, 0)) AS made, sum(done) AS planned
  FROM expected_v LEFT JOIN (SELECT style, sum(qty) AS so_far FROM sales_v WHERE day = DATE '2001-08-01' GROUP BY style) USING (style) GROUP BY grp)) USING (grp) WHERE rest * pace > 0) u
 LEFT JOIN (SELECT style, channel, qty / sum(qty) OVER (PARTITION BY style) AS share FROM (SELECT style, marketplace AS channel, sum(qty) AS qty FROM sales_v WHERE day BETWEEN DATE '2001-07-01' AND DATE '2001-07-31' GROUP BY ALL)) m ON m.style = u.style
 LEFT JOIN (SELECT channel, qty / sum(qty) OVER () AS share FROM (SELECT marketplace AS channel, sum(qty) AS qty FROM sales_v WHERE day BETWEEN DATE '2001-07-01' AND DATE '2001-07-31' GROUP BY ALL)) x ON m.style IS NULL"""
VIEWS["chunkp_v"] = 'SELECT style, channel, "offset", sum(qty) AS qty, sum(real) AS real FROM (SELECT style, channel, "offset", CAST(qty AS DOUBLE) AS qty, CAST(qty AS DOUBLE) AS real FROM chunk_v UNION ALL SELECT style, channel, 0, units, 0 FROM proj_v) GROUP BY ALL'
VIEWS["adjp_v"] = VIEWS["adj_v"].replace("chunk_v", "chunkp_v")
VIEWS["blockp_v"] = VIEWS["block_v"].replace("adj_v", "adjp_v").replace("WHERE qty > 0", "WHERE real > 0").replace("sum(qty) AS qty, sum(adj) AS adj FROM adjp_v", "sum(qty) AS qty, sum(adj) AS adj, sum(real) AS real FROM adjp_v")
VIEWS["statusp_v"] = VIEWS["status_v"].replace("block_v", "blockp_v").replace("CAST(coalesce(sum(units) FILTER (WHERE block = 5), 0) AS BIGINT)", "coalesce(sum(units) FILTER (WHERE block = 5), 0)")


def projection(spark, sf):
    """The forecast of the running week as it was saved for styles with a tier, else the weekly rate; written once."""

    def make():
        weekly = weekly_forecast(spark, sf).withColumnRenamed("id", "style")
        first = weekly.agg(F.min("week").alias("first"))
        rates = weekly.join(F.broadcast(first), F.col("week") == F.col("first")).select("style", F.col("qty").alias("weekly"))
        tiers = view(spark, sf, "tier_history_v").select(F.col("name").alias("style")).distinct()
        stored = report.rebucketed(weekly_forecast(spark, sf)).where(F.col("chunk_start") == F.lit(TODAY)).select(F.col("id").alias("style"), F.col("qty").alias("forecast")).join(tiers, "style", "left_semi")
        days = spark.range(7).select(F.date_add(F.lit(TODAY), F.col("id").cast("int")).alias("day"))
        factors = festival.day_factors(days, festival.windows(_events(spark, sf)), _effects(spark))
        base = sales(spark, sf).select("style", "day", F.col("marketplace").alias("channel"), "qty")
        return design.running_projection(base, stored, rates, factors, view(spark, sf, "attributes_v"), TODAY)

    return once(spark, sf, "projection", make)


def completed(spark, sf):
    """The chunk frame with the running week completed, written once."""
    return once(spark, sf, "completed_frame", lambda: design.with_projection(frame(spark, sf), projection(spark, sf)))


@query("d1_running_projection", "SELECT style, channel, round_even(units, 6) AS units FROM proj_v")
def d1(spark, sf):
    return projection(spark, sf).withColumn("units", F.bround("units", 6))


@query("d6_completed_status", "SELECT attribute, value, stage, " + ", ".join(f"round_even(s[{k}], 6) AS share_{k}" for k in range(1, 7)) + ", round_even(change, 6) AS change, round_even(now_units, 6) AS now_units, active_styles, on_sale FROM statusp_v")
def d6_completed(spark, sf):
    rows = rankings.trend_status(completed(spark, sf), rankings.long(view(spark, sf, "attributes_v"), ATTRIBUTES))
    return rows.select("attribute", "value", "stage", *(f"share_{k}" for k in range(1, 7)), "change", F.bround("now_units", 6).alias("now_units"), "active_styles", "on_sale")


@query(
    "d7_completed_spikes",
    """WITH y AS (SELECT style, sum(CASE WHEN "offset" = -1 THEN qty ELSE 0 END) AS qn, sum(CASE WHEN "offset" = -1 THEN adj ELSE 0 END) AS an, sum(CASE WHEN "offset" < -1 THEN qty ELSE 0 END) AS qb, sum(CASE WHEN "offset" < -1 THEN adj ELSE 0 END) AS ab FROM adjp_v WHERE "offset" BETWEEN -5 AND -1 GROUP BY style),
t AS (SELECT sum(an) AS tn, sum(ab) AS tb FROM y), v AS (SELECT attribute, value, sum(qn) AS qn, sum(an) AS an, sum(qb) AS qb, sum(ab) AS ab, count(*) FILTER (WHERE qn > 0) AS active_styles FROM y JOIN value_v USING (style) GROUP BY ALL),
w AS (SELECT *, round_even(an / tn * 100, 9) AS sn, round_even(ab / tb * 100, 9) AS sb, qb < 20 AS new FROM v, t WHERE tn > 0 AND tb > 0 AND qn >= 20 AND active_styles >= 2)
SELECT attribute, value, CASE WHEN NOT new AND sb > 0 THEN round_even(sn / sb, 6) END AS ratio, CAST(qn AS BIGINT) AS units, round_even(sn, 6) AS share, round_even(sb, 6) AS usual_share, active_styles, new FROM w WHERE sn - sb >= 0.1 AND (new OR (sb > 0 AND sn / sb >= 1.5))""",
)
def d7_completed(spark, sf):
    rows = rankings.spikes(completed(spark, sf), rankings.long(view(spark, sf, "attributes_v"), ATTRIBUTES), TODAY)
    return rows.withColumn("units", F.col("units").cast("long"))


_USABLE = "stage IN ('trending', 'steady')"
VIEWS["usable_v"] = f"SELECT *, row_number() OVER (PARTITION BY scope, attribute ORDER BY score DESC, value) AS place FROM ranked_sub_v WHERE coalesce(trend, 0) > -30 AND (stage IS NULL OR {_USABLE})"
VIEWS["more_v"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sub_category ORDER BY score DESC, attribute, value) AS nth FROM opp_v WHERE kind = 'gap') WHERE nth <= 2"
VIEWS["used_v"] = "SELECT u.* FROM usable_v u LEFT JOIN more_v m ON m.sub_category = u.scope AND m.attribute = u.attribute AND m.value = u.value WHERE u.attribute IN ('colour', 'fabric') AND (place <= CASE u.attribute WHEN 'colour' THEN 4 ELSE 2 END OR m.value IS NOT NULL)"
VIEWS["cut_v"] = """SELECT *, row_number() OVER (PARTITION BY scope ORDER BY styles DESC, kind, pos, place) AS nth FROM (SELECT * FROM (
  SELECT scope, attribute, value, stage AS reason, active_styles AS styles, 0 AS kind, CASE attribute WHEN 'colour' THEN 0 ELSE 1 END AS pos, place FROM (SELECT *, row_number() OVER (PARTITION BY scope, attribute ORDER BY score DESC, value) AS place FROM ranked_sub_v WHERE attribute IN ('colour', 'fabric')) WHERE stage IN ('fading', 'out') AND active_styles >= 2
  UNION ALL SELECT sub_category, attribute, value, kind, styles, 1, 0, row_number() OVER (PARTITION BY sub_category ORDER BY score DESC, attribute, value) FROM opp_v WHERE kind IN ('declining', 'saturated'))
 WHERE (scope, attribute, value) NOT IN (SELECT (scope, attribute, value) FROM used_v) QUALIFY row_number() OVER (PARTITION BY scope, attribute, value ORDER BY styles DESC, kind, pos, place) = 1)"""
VIEWS["card_v"] = f"""SELECT p.value AS sub_category, category, row_number() OVER (ORDER BY score DESC, p.value) AS nth, stage, score, CASE WHEN score >= 70 THEN 'strong' WHEN score >= 50 THEN 'good' ELSE 'trySmall' END AS level, now_share, active_styles,
 CASE WHEN avg_now > 0 THEN round_even(round_even(now_units / greatest(1, active_styles) / avg_now, 8), 2) END AS vs_average, last_season, lift, trend, colours, fabrics, details, make_more, cut_back
 FROM (SELECT * FROM ranked_all_v WHERE attribute = 'sub_category' AND {_USABLE}) p JOIN (SELECT DISTINCT scope FROM ranked_sub_v) k ON k.scope = p.value LEFT JOIN (SELECT sub_category, category FROM (SELECT sub_category, category, count(*) AS n FROM attributes_v GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY sub_category ORDER BY n DESC, category) = 1) c ON c.sub_category = p.value
 LEFT JOIN (SELECT scope, list(value ORDER BY place) AS colours FROM used_v WHERE attribute = 'colour' GROUP BY scope) a ON a.scope = p.value LEFT JOIN (SELECT scope, list(value ORDER BY place) AS fabrics FROM used_v WHERE attribute = 'fabric' GROUP BY scope) b ON b.scope = p.value
 LEFT JOIN (SELECT scope, list(value) AS details FROM usable_v WHERE attribute = 'neck' AND place = 1 GROUP BY scope) d ON d.scope = p.value LEFT JOIN (SELECT sub_category, list(attribute || ':' || value || ':' || styles ORDER BY nth) AS make_more FROM more_v GROUP BY sub_category) m ON m.sub_category = p.value
 LEFT JOIN (SELECT scope, list(attribute || ':' || value || ':' || reason || ':' || styles ORDER BY nth) AS cut_back FROM cut_v WHERE nth <= 4 GROUP BY scope) x ON x.scope = p.value"""
_LISTS = ("colours", "fabrics", "details", "make_more", "cut_back")
VIEWS["expected_sale_v"] = "SELECT id, CAST(sum(forecast) AS BIGINT) AS expected FROM ahead_v WHERE ahead BETWEEN 0 AND 8 GROUP BY id"
VIEWS["fit_v"] = """SELECT *, round_even(round_even(100 * (rank() OVER (ORDER BY expected) + (count(*) OVER (PARTITION BY expected) - 1) / 2) / count(*) OVER (), 8), 1) AS forecast_score, round_even(round_even(CAST(0.7 AS DOUBLE) * fit + CAST(0.3 AS DOUBLE) * score, 8), 1) AS design_fit FROM (
 SELECT *, 100.0 * (CASE WHEN has_c AND hit_c THEN 6 ELSE 0 END + 46 + CASE WHEN has_f AND hit_f THEN 20 ELSE 0 END + CASE WHEN has_n AND hit_n THEN 7 ELSE 0 END) / (CASE WHEN has_c THEN 6 ELSE 0 END + 46 + CASE WHEN has_f THEN 20 ELSE 0 END + CASE WHEN has_n THEN 7 ELSE 0 END) AS fit,
  CAST(has_c AND hit_c AS INT) + 2 + CAST(has_f AND hit_f AS INT) + CAST(has_n AND hit_n AS INT) AS matches, CAST(has_c AS INT) + 2 + CAST(has_f AS INT) + CAST(has_n AS INT) AS suggested FROM (
 SELECT a.style, a.sub_category, a.colour, k.nth AS card, k.score, k.level AS product_level, list_position(k.colours, a.colour) - 1 AS colour_place, expected, k.category IS NOT NULL AS has_c, coalesce(a.category = k.category, FALSE) AS hit_c,
  k.fabrics IS NOT NULL AS has_f, coalesce(list_contains(k.fabrics, a.fabric), FALSE) AS hit_f, k.details IS NOT NULL AS has_n, coalesce(a.neck = k.details[1], FALSE) AS hit_n
 FROM attributes_v a JOIN card_v k ON k.sub_category = a.sub_category JOIN expected_sale_v e ON e.id = a.style WHERE expected > 0 AND list_contains(k.colours, a.colour)))"""


def _suggestions(spark, sf, weights=None):
    """Rankings over all styles and within sub-categories, and opportunities, each written once."""
    kind = "next" if weights is rankings.UPCOMING else "now"
    overall = once(spark, sf, f"ranked_{kind}", lambda: _ranked(spark, sf, weights=weights)[0])
    inner = once(spark, sf, f"ranked_inside_{kind}", lambda: _ranked(spark, sf, "sub_category", weights)[0])
    stages = once(spark, sf, "status", lambda: _status(spark, sf, frame(spark, sf)))
    return overall, inner, rankings.opportunities(inner.where("attribute IN ('colour', 'fabric')"), stages)


def cards(spark, sf, weights=None):
    kind = "next" if weights is rankings.UPCOMING else "now"
    return once(spark, sf, f"cards_{kind}", lambda: products.cards(*_suggestions(spark, sf, weights), view(spark, sf, "attributes_v")))


def _texts(df):
    """Arrays of structs as text: values, or attribute:value:..., one after the other."""
    values = {"colours": lambda x: x["value"], "fabrics": lambda x: x["value"], "details": lambda x: x["value"]}
    values["make_more"] = lambda x: F.concat_ws(":", x["attribute"], x["value"], x["styles"].cast("string"))
    values["cut_back"] = lambda x: F.concat_ws(":", x["attribute"], x["value"], x["reason"], x["styles"].cast("string"))
    return df.withColumns({c: F.array_join(F.transform(c, f), ",") for c, f in values.items()})


def _recommended(spark, sf, weights=None):
    return products.recommended_styles(cards(spark, sf, weights), view(spark, sf, "attributes_v"), report.expected_sale(report_cells(spark, sf), TODAY))


@query("d17_product_cards", f"SELECT sub_category, category, CAST(nth AS INT) AS nth, stage, score, level, now_share, active_styles, vs_average, last_season, lift, trend, {', '.join(f"array_to_string({c}, ',') AS {c}" for c in _LISTS)} FROM card_v")
def d17(spark, sf):
    return _texts(cards(spark, sf))


@query("d17_mixes")
def d17_mixes(spark, sf):
    overall, inner, opportunities = _suggestions(spark, sf)
    use = products.used(products.usable(inner), products.make_more(opportunities))
    stages = once(spark, sf, "status", lambda: _status(spark, sf, frame(spark, sf)))
    of = lambda a: stages.where(F.col("attribute") == a).select(F.col("value").alias(a), F.col("stage").alias(f"{a}_stage"))
    card = cards(spark, sf).select("sub_category", "category", *(F.coalesce(products.detail(a), F.lit("Unknown")).alias(a) for a in ("neck", "embroidery")))
    rows = products.mix_candidates(inner, use).join(card, "sub_category").join(of("category"), "category", "left").join(of("sub_category"), "sub_category", "left").fillna("none", ["category_stage", "sub_category_stage"])
    rows = rows.withColumns({"season": F.lit(RUNNING_SEASON), "price_band": F.lit(2), "age_quarters": F.lit(2.0)})
    fit = fitted(spark, sf)
    p = fit.mean(fit.part({c: F.col(c).cast("double" if c in seasons.NUMERIC else "string") for c in (*seasons.NUMERIC, *seasons.CATEGORICAL)}))
    return products.mixes(rows.withColumn("p", p), view(spark, sf, "attributes_v"))


@query("d18_recommended_styles", """SELECT CAST(rank AS INT) AS rank, style, sub_category, colour, matches, suggested, round_even(round_even(fit, 8), 1) AS fit, design_fit, forecast_score, recommendation, expected, product_level FROM (SELECT *, round_even(round_even(CAST(0.75 AS DOUBLE) * design_fit + CAST(0.25 AS DOUBLE) * forecast_score, 8), 1) AS recommendation,
 row_number() OVER (ORDER BY card, colour_place, matches DESC, round_even(round_even(fit, 8), 1) DESC, expected DESC, style) AS rank FROM fit_v) WHERE rank <= 100""")
def d18(spark, sf):
    return _recommended(spark, sf).drop("missing")


@query("d19_overview", """WITH top AS (SELECT * FROM card_v WHERE nth <= 8), c AS (SELECT v AS value, sum(now_share) AS w, min(nth * 100 + pos) AS f FROM (SELECT nth, now_share, unnest(colours) AS v, unnest(range(len(colours))) AS pos FROM top) GROUP BY v), b AS (SELECT v AS value, sum(now_share) AS w, min(nth * 100 + pos) AS f FROM (SELECT nth, now_share, unnest(fabrics) AS v, unnest(range(len(fabrics))) AS pos FROM top) GROUP BY v)
SELECT (SELECT string_agg(sub_category, ',' ORDER BY nth) FROM top WHERE nth <= 3) AS focus, (SELECT string_agg(value, ',' ORDER BY round_even(w, 6) DESC, f) FROM (SELECT * FROM c ORDER BY round_even(w, 6) DESC, f LIMIT 3)) AS colours, (SELECT string_agg(value, ',' ORDER BY round_even(w, 6) DESC, f) FROM (SELECT * FROM b ORDER BY round_even(w, 6) DESC, f LIMIT 2)) AS fabrics""")
def d19(spark, sf):
    return products.overview(cards(spark, sf)).select(*(F.array_join(c, ",").alias(c) for c in ("focus", "colours", "fabrics")))


@query("d23_stage_map", "SELECT attribute, string_agg(value || '=' || stage, ',' ORDER BY value) AS stages FROM status_v WHERE attribute IN ('category', 'sub_category', 'colour', 'fabric') GROUP BY attribute")
def d23(spark, sf):
    stages = products.stage_map(_status(spark, sf, frame(spark, sf)), rankings.TRACKED)
    return stages.select("attribute", F.array_join(F.transform(F.map_entries("stages"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("stages"))
