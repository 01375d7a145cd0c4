"""Rankings of attribute values: trend status, sudden spikes, scores by evidence, and where to design more or less.

frame: style, offset, channel, qty, adj, as `design.chunk_frame` gives it.
values: style, attribute, value, as `long` gives it.
Everything is summed by style before values are joined, so that a value's rows are few.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from .design import BLOCKS, LEAST_UNITS, ON_SALE, STRONG, TREND

# Styles a value needs; strength of the prior in styles; share of its peak at which a value is out; the rules of a spike;
# the rules of opportunities; weights of the running and of the upcoming season; scores of the stages.
LEAST_STYLES, PRIOR_STYLES, OUT_OF_PEAK = 2, 5.0, 0.5
SPIKE_WEEKS, SPIKE_DAYS, SPIKE_RATIO, SPIKE_GAIN = 4, 4, 1.5, 0.1
GAP_RATIO, SATURATED_RATIO, SATURATED_STYLES = 1.3, 0.7, 4
RUNNING = {"now_per_style": 0.30, "trend": 0.20, "now_share": 0.10, "lift": 0.15, "per_style": 0.05, "momentum": 0.10, "stage": 0.10}
UPCOMING = {"per_style": 0.25, "lift": 0.20, "now_per_style": 0.20, "trend": 0.10, "now_share": 0.05, "momentum": 0.10, "stage": 0.10}
STAGE_SCORE = {"trending": 1.0, "steady": 2 / 3, "fading": 1 / 3, "out": 0.0}
TRACKED = ("category", "sub_category", "colour", "fabric")


def long(styles: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """style, attribute, value: one row for each attribute that says something."""
    rows = styles.select("style", *attributes).unpivot("style", list(attributes), "attribute", "value")
    return rows.where(F.coalesce("value", F.lit("")) != "")


def _if(condition: Column, c: Column) -> Column:
    return F.sum(F.when(condition, c).otherwise(0))


def move(change: Column) -> Column:
    """1 rising, -1 falling, 0 steady or unknown."""
    return F.when(change >= STRONG, 1).when(change <= -STRONG, -1).otherwise(0)


def suggestable(stage: Column) -> Column:
    """A value without stages may be suggested, one with them only while it trends or holds."""
    return stage.isNull() | stage.isin("trending", "steady")


def trend_status(frame: DataFrame, values: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row a value that ever sold the least units in a block: its share in each of the last blocks and its stage.

    attribute, value, stage, share_1 to share_6 (per cent, oldest first), change (per cent, null
    under the least units), from_peak_pct, peak_block, now_units, active_styles, on_sale, gain;
    and keys, columns of the frame that hold frames apart.
    """
    span, last = BLOCKS * TREND, BLOCKS - 1
    recent = frame.where(F.col("offset") > -span).withColumn("block", F.floor((F.col("offset") + span - 1) / TREND).cast("int"))
    real = "real" if "real" in frame.columns else "qty"  # what is projected for the running week isn't selling
    by_style = recent.groupBy(*keys, "style", "block").agg(F.sum("qty").alias("qty"), F.sum("adj").alias("adj"), F.sum(real).alias("real"))
    totals = by_style.groupBy(*keys, "block").agg(F.sum("adj").alias("total"))  # a row a block
    cells = by_style.join(values, "style").groupBy(*keys, "attribute", "value", "block").agg(F.sum("qty").alias("units"), F.sum("adj").alias("adj"), F.count_if(F.col("real") > 0).alias("active"))
    cells = cells.join(F.broadcast(totals), [*keys, "block"]).withColumn("share", F.when(F.col("total") > 0, F.col("adj") / F.col("total") * 100).otherwise(0.0))
    at = [F.col("block") == k for k in range(BLOCKS)]
    rows = cells.groupBy(*keys, "attribute", "value").agg(
        F.array(*(F.bround(_if(a, F.col("share")), 9) for a in at)).alias("s"), F.max("units").alias("most"), _if(at[last - 1], F.col("units")).alias("units_before"),
        _if(at[last], F.col("units")).alias("now_units"), _if(at[last], F.col("active")).alias("active_styles"),
    )
    rows = rows.where(F.col("most") >= ON_SALE).withColumns({"now": F.element_at("s", BLOCKS), "before": F.element_at("s", last), "peak": F.array_max("s")})
    rows = rows.withColumn("change", F.when((F.col("units_before") >= LEAST_UNITS) & (F.col("before") > 0), (F.col("now") / F.col("before") - 1) * 100))
    rows = rows.withColumn("on_sale", (F.col("now_units") >= ON_SALE) & (F.col("active_styles") >= LEAST_STYLES))
    far_below = (F.col("peak") > 0) & (F.col("now") <= OUT_OF_PEAK * F.col("peak")) & (F.coalesce("change", F.lit(0.0)) <= 0)
    m = move(F.col("change"))
    stage = F.when(~F.col("on_sale"), "out").when(m > 0, "trending").when(far_below, "out").when(m < 0, "fading").otherwise("steady")
    return rows.select(
        *keys, "attribute", "value", stage.alias("stage"), *(F.bround(F.element_at("s", k + 1), 6).alias(f"share_{k + 1}") for k in range(BLOCKS)), F.bround("change", 6).alias("change"),
        F.when(F.col("peak") > 0, F.bround((F.col("now") / F.col("peak") - 1) * 100, 6)).alias("from_peak_pct"), (F.array_position("s", F.col("peak")) - 1).cast("int").alias("peak_block"),
        "now_units", "active_styles", "on_sale", F.bround(F.col("now") - F.col("before"), 6).alias("gain"),
    )


def spikes(frame: DataFrame, values: DataFrame, snap: date) -> DataFrame:
    """Values whose share of one report week stands out against the weeks before.

    The week is the running one once it has enough days, else the one before.
    attribute, value, ratio (null if new), units, share, usual_share, active_styles, new.
    """
    first = max(d for d in (1, 8, 16, 24) if d <= snap.day)
    k = 0 if snap.day - first + 1 >= SPIKE_DAYS else -1
    o = F.col("offset")
    now, base = o == k, (o < k) & (o >= k - SPIKE_WEEKS)
    real = F.col("real" if "real" in frame.columns else "qty")
    by_style = frame.where(now | base).groupBy("style").agg(*(_if(w, F.col(c)).alias(f"{c}_{n}") for n, w in (("now", now), ("base", base)) for c in ("qty", "adj")), _if(now, real).alias("real_now"))
    totals = by_style.agg(F.sum("adj_now").alias("t_now"), F.sum("adj_base").alias("t_base"))  # one row
    sums = [F.sum(c).alias(c) for c in ("qty_now", "adj_now", "qty_base", "adj_base")]
    rows = by_style.join(values, "style").groupBy("attribute", "value").agg(*sums, F.count_if(F.col("real_now") > 0).alias("active_styles"))
    rows = rows.crossJoin(F.broadcast(totals)).where((F.col("t_now") > 0) & (F.col("t_base") > 0) & (F.col("qty_now") >= ON_SALE) & (F.col("active_styles") >= LEAST_STYLES))
    rows = rows.withColumns({"share": F.bround(F.col("adj_now") / F.col("t_now") * 100, 9), "usual_share": F.bround(F.col("adj_base") / F.col("t_base") * 100, 9), "new": F.col("qty_base") < ON_SALE})
    ratio = F.when(F.col("usual_share") > 0, F.col("share") / F.col("usual_share"))
    rows = rows.where((F.col("share") - F.col("usual_share") >= SPIKE_GAIN) & (F.col("new") | F.coalesce(ratio >= SPIKE_RATIO, F.lit(False))))
    return rows.select("attribute", "value", F.when(~F.col("new"), F.bround(ratio, 6)).alias("ratio"), F.col("qty_now").alias("units"), F.bround("share", 6).alias("share"), F.bround("usual_share", 6).alias("usual_share"), "active_styles", "new")


def evidence(overall: DataFrame, season: DataFrame, momentum: DataFrame, trends: DataFrame, styles: DataFrame, scope: str | None = None) -> DataFrame:
    """What is known of each sold style, one row a style, with the scope it is compared in (ALL, or a column of styles).

    overall, season: style, units.  momentum: style, now, year_ago.  trends: style, now, before, real_now.
    """
    out = overall.select("style", F.col("units").alias("all_units")).join(season.select("style", F.col("units").alias("season_units")), "style", "left")
    out = out.join(momentum.select("style", F.col("now").alias("m_now"), F.col("year_ago").alias("m_ago")), "style", "left")
    out = out.join(trends.select("style", F.col("now").alias("t_now"), F.col("before").alias("t_before"), "real_now"), "style", "left")
    out = out.join(styles.select("style", (F.col(scope) if scope else F.lit("ALL")).alias("scope"), F.lit(True).alias("known")), "style", "left")
    out = out.fillna(0, ["m_now", "m_ago", "t_now", "t_before", "real_now"]).fillna(False, ["known"])
    return out.where(F.col("scope").isNotNull() & (F.col("scope") != "")) if scope else out.withColumn("scope", F.lit("ALL"))


def _percentile(c: str, present: Column, keys: list[str]) -> Column:
    """Average percentile rank among the rows that have the figure, 0.5 for the others."""
    v = F.when(present, F.col(c))
    among = Window.partitionBy(*keys, v.isNull())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, v))
    return F.when(v.isNull(), 0.5).otherwise((F.rank().over(among.orderBy(v)) + (ties - 1) / 2) / F.count(F.lit(1)).over(among))


def ranked(ev: DataFrame, values: DataFrame, stages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The values of each scope and attribute that are on sale, scored by what sells now and what sold in the season.

    ev: rows of `evidence`.  stages: attribute, value, stage.  A figure that a value lacks ranks in the middle.
    scope, attribute, value, units, styles, share, lift, per_style, momentum, confidence, trend,
    now_share, active_styles, now_units, now_per_style, last_season, stage, score, avg_now, avg_last.
    """
    weights = weights or RUNNING
    totals = ev.groupBy("scope").agg(
        F.sum("t_now").alias("all_now"), F.sum("t_before").alias("all_before"), F.count_if(F.col("real_now") > 0).alias("n_now"),
        _if(F.col("known"), F.coalesce("season_units", F.lit(0))).alias("all_season"), _if(F.col("known"), F.col("all_units")).alias("all_all"), F.count_if(F.col("known") & F.col("season_units").isNotNull()).alias("n_season"),
    )
    totals = totals.withColumns({"avg_now": F.col("all_now") / F.greatest(F.lit(1), "n_now"), "avg_last": F.col("all_season") / F.greatest(F.lit(1), "n_season")})
    rows = ev.join(values, "style").groupBy("scope", "attribute", "value").agg(
        F.sum("season_units").alias("season_units"), F.count("season_units").alias("n"), F.sum("all_units").alias("all_units"), F.sum("m_now").alias("m_now"), F.sum("m_ago").alias("m_ago"),
        F.sum("t_now").alias("t_now"), F.sum("t_before").alias("t_before"), F.count_if(F.col("real_now") > 0).alias("active_styles"),
    ).join(totals, "scope").where((F.col("active_styles") >= LEAST_STYLES) & (F.greatest("m_now", "t_now") >= ON_SALE))
    share_of = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    ref = F.col("n") >= LEAST_STYLES
    rows = rows.withColumns({"last_season": ref, "styles": F.when(ref, F.col("n")).otherwise(0), "units": F.when(ref, F.col("season_units")).otherwise(0)})
    rows = rows.withColumns({"share_s": share_of("units", "all_season"), "share_a": share_of("all_units", "all_all"), "share_n": share_of("t_now", "all_now"), "share_b": share_of("t_before", "all_before")})
    now_sure = F.least(F.lit(1.0), F.col("active_styles") / 5) * F.least(F.lit(1.0), F.col("t_now") / 100)
    ref_sure = F.least(F.lit(1.0), F.col("styles") / 5) * F.least(F.lit(1.0), F.col("units") / 200)
    r = lambda c, digits: F.bround(F.bround(c, 8), digits)
    rows = rows.withColumns({
        "share": r(F.col("share_s") * 100, 1), "lift": r(F.when(ref & (F.col("share_a") > 0), F.col("share_s") / F.col("share_a")).otherwise(1.0), 2),
        "per_style": r(F.when(ref, (F.col("units") + PRIOR_STYLES * F.col("avg_last")) / (F.col("styles") + PRIOR_STYLES)).otherwise(0.0), 1),
        "momentum": r(F.when(F.col("m_ago") >= ON_SALE, (F.col("m_now") - F.col("m_ago")) / F.col("m_ago") * 100), 1),
        "trend": r(F.when((F.col("t_before") >= LEAST_UNITS) & (F.col("share_b") > 0), (F.col("share_n") / F.col("share_b") - 1) * 100), 1),
        "now_share": r(F.col("share_n") * 100, 1), "now_per_style": r((F.col("t_now") + PRIOR_STYLES * F.col("avg_now")) / (F.col("active_styles") + PRIOR_STYLES), 1),
        "now_units": r(F.col("t_now"), 0).cast("long"), "confidence": r(now_sure if weights is RUNNING else (ref_sure + now_sure) / 2, 2),
    })
    rows = rows.join(stages.select("attribute", "value", F.col("stage").alias("s")), ["attribute", "value"], "left").withColumn("stage", F.when(F.col("attribute").isin(*TRACKED), F.coalesce("s", F.lit("none"))))
    score = F.lit(0.5)
    for name, points in STAGE_SCORE.items():
        score = F.when(F.col("stage") == name, points).otherwise(score)
    keys, ref_only = ["scope", "attribute"], ("lift", "per_style")
    rows = rows.withColumns({f"r_{c}": score if c == "stage" else _percentile(c, (F.col("last_season") if c in ref_only else F.lit(True)) & F.col(c).isNotNull(), keys) for c in weights})
    raw = sum((F.lit(w) * F.col(f"r_{c}") for c, w in weights.items()), F.lit(0.0))
    total = r(100 * raw * (0.5 + 0.5 * F.col("confidence")), 0).cast("int")
    return rows.select("scope", "attribute", "value", F.col("units").cast("long").alias("units"), F.col("styles").cast("long").alias("styles"), "share", "lift", "per_style", "momentum", "confidence", "trend", "now_share", "active_styles", "now_units", "now_per_style", "last_season", "stage", total.alias("score"), "avg_now", "avg_last")


def opportunities(scored: DataFrame, stages: DataFrame) -> DataFrame:
    """Where to design more (gap), what picks up (rising), loses steam (declining) or is designed too much (saturated).

    scored: rows of `ranked` in scopes of sub-categories, of colours and fabrics.  Attributes with under three values are left out.
    """
    n = F.col("active_styles")
    middle = scored.groupBy("scope", "attribute").agg(F.count(F.lit(1)).alias("n_values"), F.element_at(F.sort_array(F.collect_list(n)), (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int")).alias("median"))
    around = stages.where("attribute = 'sub_category'").select(F.col("value").alias("scope"), F.col("stage").alias("scope_stage"))
    rows = scored.join(middle.where("n_values >= 3"), ["scope", "attribute"]).join(around, "scope", "left").where("avg_now > 0")
    m = move(F.coalesce("trend", "momentum"))
    rows = rows.withColumn("move", F.when(suggestable(F.col("stage")) & suggestable(F.coalesce("scope_stage", F.lit("none"))), m).otherwise(F.least(m, F.lit(-1))))
    per, avg = F.col("now_per_style"), F.col("avg_now")
    kind = (
        F.when((per >= GAP_RATIO * avg) & (n <= F.greatest(F.lit(2), "median")) & (F.col("move") >= 0), "gap")
        .when((F.col("move") < 0) & F.col("last_season") & (F.col("per_style") >= F.col("avg_last")), "declining")
        .when((per <= SATURATED_RATIO * avg) & (n >= F.greatest(F.lit(float(SATURATED_STYLES)), 1.5 * F.col("median"))) & (F.col("move") <= 0), "saturated")
        .when(F.col("move") > 0, "rising")
    )
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").select("kind", F.col("scope").alias("sub_category"), "attribute", "value", F.col("active_styles").alias("styles"), "units", F.col("now_per_style").alias("per_style"), F.bround(F.bround(avg, 8), 1).alias("average"), "momentum", "trend", "score")
