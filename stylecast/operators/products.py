"""Product cards: what to make more and less of in each sub-category, and existing styles that fit.

overall, inner: rows of `rankings.ranked`, over all styles and within sub-categories.
A value's place in a ranking is its score, best first, then the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .panel import percentile_rank
from .rankings import LEAST_STYLES, move, suggestable

# Colours, fabrics and mixes of a card, colours and fabrics that mixes are held against; values to make more of and to cut back;
# scores and per cents of the levels; what an attribute weighs in a style's fit; how fit and score, design and forecast are weighed; styles listed.
COLOURS, FABRICS, MIXES, WIDE_COLOURS, WIDE_FABRICS, MAKE_MORE, CUT_BACK = 4, 2, 3, 12, 6, 2, 4
PRODUCT_LEVELS, MIX_LEVELS = (70, 50), (15.0, -10.0)
MATCH_WEIGHTS = {"category": 6, "sub_category": 22, "colour": 24, "fabric": 20, "embroidery": 10, "neck": 7}
FIT_SHARE, DESIGN_SHARE, LISTED, TOP_CARDS = 0.7, 0.75, 100, 8
DETAILS = ("neck",)


def _tenth(c: Column) -> Column:
    """Rounded to one digit; what differs from a half by less than 1e-8 is one."""
    return F.bround(F.bround(c, 8), 1)


def level(value: Column, bounds: tuple[float, float]) -> Column:
    """Strong, good or trySmall."""
    return F.when(value >= bounds[0], "strong").when(value >= bounds[1], "good").otherwise("trySmall")


def stage_map(status: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """Attribute and a map from its values to their stages."""
    return status.where(F.col("attribute").isin(*attributes)).groupBy("attribute").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "stage")))).alias("stages"))


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("scope", "attribute").orderBy(F.desc("score"), "value")))


def usable(inner: DataFrame) -> DataFrame:
    """Values of each sub-category that may be suggested: trending or in trend, and not falling; place: the rank among them."""
    return _placed(inner.where((move(F.col("trend")) >= 0) & suggestable(F.col("stage"))))


def make_more(opportunities: DataFrame) -> DataFrame:
    """Values that sell well in few designs: sub_category, attribute, value, styles, times, nth."""
    best = Window.partitionBy("sub_category").orderBy(F.desc("score"), "attribute", "value")
    rows = opportunities.where("kind = 'gap'").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= MAKE_MORE)
    return rows.select("sub_category", "attribute", "value", "styles", F.bround(F.col("per_style") / F.greatest("average", F.lit(1e-9)), 1).alias("times"), "nth")


def used(usable_: DataFrame, more: DataFrame) -> DataFrame:
    """Colours and fabrics that a card uses: its best ones and those to make more of."""
    wanted = more.select(F.col("sub_category").alias("scope"), "attribute", "value", F.lit(True).alias("more"))
    most = F.when(F.col("attribute") == "colour", COLOURS).when(F.col("attribute") == "fabric", FABRICS)
    rows = usable_.where(most.isNotNull()).join(wanted, ["scope", "attribute", "value"], "left")
    return rows.where((F.col("place") <= most) | F.col("more")).select("scope", "attribute", "value", "stage", "trend", "place")


def cut_back(inner: DataFrame, opportunities: DataFrame, used_: DataFrame) -> DataFrame:
    """Colours and fabrics to make less of, never one that is used: sub_category, attribute, value, reason, styles, nth."""
    rank = F.when(F.col("attribute") == "colour", 0).otherwise(1)
    old = _placed(inner.where(F.col("attribute").isin("colour", "fabric"))).where(F.col("stage").isin("fading", "out") & (F.col("active_styles") >= LEAST_STYLES))
    old = old.select("scope", "attribute", "value", F.col("stage").alias("reason"), F.col("active_styles").alias("styles"), F.struct(F.lit(0).alias("kind"), rank.alias("attribute"), "place").alias("at"))
    of = Window.partitionBy("sub_category").orderBy(F.desc("score"), "attribute", "value")
    lost = opportunities.where(F.col("kind").isin("declining", "saturated")).withColumn("place", F.row_number().over(of))
    lost = lost.select(F.col("sub_category").alias("scope"), "attribute", "value", F.col("kind").alias("reason"), "styles", F.struct(F.lit(1).alias("kind"), F.lit(0).alias("attribute"), "place").alias("at"))
    rows = old.unionByName(lost).join(used_, ["scope", "attribute", "value"], "left_anti")
    rows = rows.groupBy("scope", "attribute", "value").agg(F.min_by(F.struct("reason", "styles"), F.struct(-F.col("styles"), "at")).alias("x"), F.min(F.struct(-F.col("styles"), "at")).alias("order"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("scope").orderBy("order"))).where(F.col("nth") <= CUT_BACK)
    return rows.select(F.col("scope").alias("sub_category"), "attribute", "value", "x.reason", "x.styles", "nth")


def _listed(rows: DataFrame, order: str, name: str, *fields: str, key: str = "scope") -> DataFrame:
    """One row a sub-category with its values as an array in order."""
    return rows.groupBy(F.col(key).alias("sub_category")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, *fields))), lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(name))


def cards(overall: DataFrame, inner: DataFrame, opportunities: DataFrame, styles: DataFrame) -> DataFrame:
    """One row for each sub-category that may be suggested: its rank, level and figures, colours, fabrics and details to use, values to make more of and to cut back."""
    products = overall.where((F.col("attribute") == "sub_category") & suggestable(F.col("stage")))
    per = F.col("now_units") / F.greatest(F.lit(1), "active_styles")
    versus = F.when(F.col("avg_now") > 0, F.bround(F.bround(per / F.col("avg_now"), 8), 2))
    products = products.withColumn("nth", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("score"), "value")))
    products = products.select(F.col("value").alias("sub_category"), "nth", "stage", "score", level(F.col("score"), PRODUCT_LEVELS).alias("level"), "now_share", "active_styles", versus.alias("vs_average"), "last_season", "lift", "trend")
    known = inner.select(F.col("scope").alias("sub_category")).distinct()
    modes = styles.where("coalesce(sub_category, '') <> ''").groupBy("sub_category", "category").agg(F.count(F.lit(1)).alias("n")).groupBy("sub_category").agg(F.min_by("category", F.struct(-F.col("n"), "category")).alias("category"))
    best, more = usable(inner), make_more(opportunities)
    use = used(best, more)
    out = products.join(known, "sub_category", "left_semi").join(modes, "sub_category", "left")
    for a, name in (("colour", "colours"), ("fabric", "fabrics")):
        out = out.join(_listed(use.where(F.col("attribute") == a), "place", name, "value", "stage", "trend"), "sub_category", "left")
    details = best.where(F.col("attribute").isin(*DETAILS) & (F.col("place") == 1))
    out = out.join(_listed(details, "place", "details", "attribute", "value"), "sub_category", "left")
    out = out.join(_listed(more, "nth", "make_more", "attribute", "value", "styles", "times", key="sub_category"), "sub_category", "left")
    return out.join(_listed(cut_back(inner, opportunities, use), "nth", "cut_back", "attribute", "value", "reason", "styles", key="sub_category"), "sub_category", "left")


def detail(attribute: str) -> Column:
    """The value of a card's details for an attribute, null if it has none."""
    return F.get(F.filter("details", lambda x: x["attribute"] == attribute), F.lit(0))["value"]


def mixes(candidates: DataFrame, tried: DataFrame) -> DataFrame:
    """The best colours and fabrics together for each card: sub_category, colour, fabric, level, vs_average_pct, tried, nth.

    candidates: sub_category, colour, fabric, listed (both are on the card), p: what the model of seasons predicts.
    """
    average = Window.partitionBy("sub_category")
    best = Window.partitionBy("sub_category").orderBy(F.desc("p"), "colour", "fabric")
    rows = candidates.withColumn("mean", F.avg("p").over(average)).where("listed").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= MIXES)
    versus = F.when(F.col("mean") > 0, (F.col("p") / F.col("mean") - 1) * 100).otherwise(0.0)
    seen = tried.select("sub_category", "colour", "fabric", F.lit(True).alias("seen")).distinct()
    rows = rows.join(seen, ["sub_category", "colour", "fabric"], "left")
    return rows.select("sub_category", "colour", "fabric", level(versus, MIX_LEVELS).alias("level"), F.bround(versus, 1).alias("vs_average_pct"), F.coalesce("seen", F.lit(False)).alias("tried"), "nth")


def mix_candidates(inner: DataFrame, use: DataFrame) -> DataFrame:
    """sub_category, colour, colour_stage, fabric, fabric_stage, listed: the best colours and fabrics of a sub-category, 72 pairs at most."""
    best = usable(inner)
    side = lambda a, n: best.where((F.col("attribute") == a) & (F.col("place") <= n)).join(use.select("scope", "attribute", "value", F.lit(True).alias("on")), ["scope", "attribute", "value"], "left").select(F.col("scope").alias("sub_category"), F.col("value").alias(a), F.coalesce("stage", F.lit("none")).alias(f"{a}_stage"), F.coalesce("on", F.lit(False)).alias(f"{a}_on"))
    rows = side("colour", WIDE_COLOURS).join(side("fabric", WIDE_FABRICS), "sub_category")
    return rows.withColumn("listed", F.col("colour_on") & F.col("fabric_on")).drop("colour_on", "fabric_on")


def recommended_styles(cards_: DataFrame, styles: DataFrame, expected: DataFrame) -> DataFrame:
    """The existing styles that fit a card and are expected to sell, a hundred at most; expected: id, expected.

    A style meets only the card of its own sub-category, and has to have one of its colours.
    """
    shown = cards_.select(
        F.col("nth").alias("card"), "score", F.col("level").alias("product_level"), "sub_category", F.col("category").alias("card_category"),
        F.transform("colours", lambda x: x["value"]).alias("c"), F.coalesce(F.transform("fabrics", lambda x: x["value"]), F.array().cast("array<string>")).alias("f"),
        *(detail(a).alias(f"d_{a}") for a in DETAILS),
    ).where("c IS NOT NULL")
    rows = styles.join(shown, "sub_category").join(expected.where("expected > 0").select(F.col("id").alias("style"), "expected"), "style")
    rows = rows.where(F.array_contains("c", F.col("colour"))).withColumn("colour_place", F.array_position("c", F.col("colour")) - 1)
    given = {"category": F.col("card_category").isNotNull(), "sub_category": F.lit(True), "colour": F.lit(True), "fabric": F.size("f") > 0} | {a: F.col(f"d_{a}").isNotNull() for a in DETAILS}
    same = {"category": F.col("category") == F.col("card_category"), "sub_category": F.lit(True), "colour": F.lit(True), "fabric": F.array_contains("f", F.col("fabric"))} | {a: F.col(a) == F.col(f"d_{a}") for a in DETAILS}
    hit = {a: given[a] & F.coalesce(same[a], F.lit(False)) for a in given}
    total = lambda marks, w: sum((F.when(m, w(a)).otherwise(0) for a, m in marks.items()), F.lit(0))
    fit = F.lit(100.0) * total(hit, MATCH_WEIGHTS.get) / total(given, MATCH_WEIGHTS.get)
    rows = rows.withColumn("fit", fit).withColumn("design_fit", _tenth(F.lit(FIT_SHARE) * F.col("fit") + (1 - FIT_SHARE) * F.col("score")))
    rows = rows.withColumns({"matches": total(hit, lambda _: 1), "suggested": total(given, lambda _: 1), "missing": F.array_compact(F.array(*(F.when(given[a] & ~hit[a], a) for a in given)))})
    rows = percentile_rank(rows, pct="expected").withColumn("forecast_score", _tenth(100 * F.col("pct")))
    rows = rows.withColumns({"fit": _tenth(F.col("fit")), "recommendation": _tenth(DESIGN_SHARE * F.col("design_fit") + (1 - DESIGN_SHARE) * F.col("forecast_score"))})
    order = ["card", "colour_place", F.desc("matches"), F.desc("fit"), F.desc("expected"), "style"]
    top = rows.orderBy(*order).limit(LISTED).withColumn("all_", F.lit(1))
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy("all_").orderBy(*order)))  # a hundred rows
    return ranked.select("rank", "style", "sub_category", "colour", "matches", "suggested", "missing", "fit", "design_fit", "forecast_score", "recommendation", "expected", "product_level")


def overview(cards_: DataFrame) -> DataFrame:
    """One row: the first products, and the colours and fabrics of the first cards by what these sell."""
    top = cards_.where(F.col("nth") <= TOP_CARDS)
    out = top.agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= 3, F.struct("nth", "sub_category")))), lambda x: x["sub_category"]).alias("focus"))
    for a, k in (("colours", 3), ("fabrics", 2)):
        weights = top.select("nth", "now_share", F.posexplode(a).alias("at", "x")).groupBy(F.col("x.value").alias("value")).agg(F.sum("now_share").alias("w"), F.min(F.struct("nth", "at")).alias("first"))
        best = weights.agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.bround("w", 6)).alias("w"), "first", "value"))), 1, k), lambda x: x["value"]).alias(a))  # values of eight cards
        out = out.crossJoin(F.broadcast(best))
    return out
