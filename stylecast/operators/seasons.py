"""The model of seasons: what a style sold in each complete season, settings chosen across styles, effects of attributes.

The model is a Tweedie regression with a log link, so that what an attribute adds to the log of
the mean is its weight less the weight's average over the training rows, and these parts add up.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import calendar as cal
from . import design, rankings
from .model import ATTRIBUTES, Model, _flat

# Bands of prices; the share of rows below the cap; days that the first season may lack; days of a quarter; folds;
# rows of a season and of a value that an effect needs; how far above the cap a sound prediction may be.
BANDS, CAP, SLACK_DAYS, QUARTER_DAYS, FOLDS, LEAST_ROWS, LEAST_OF_VALUE, SOUND = 5, 0.99, 3, 91.0, 5, 30, 5, 20
STAGES = tuple(f"{a}_stage" for a in rankings.TRACKED)
CATEGORICAL = ("season", *ATTRIBUTES, *STAGES, "price_band")
NUMERIC = ("age_quarters",)


def occurrences(sales: DataFrame, snap: date) -> DataFrame:
    """season, year, start, end of each season that is over and whose data is whole; a row a season, few."""
    d = F.col("day")
    days = sales.groupBy("day").agg(F.lit(1).alias("one"))
    first = days.agg(F.min("day").alias("first"))  # one row
    made = days.select(cal.season(d).alias("season"), cal.season_year(d).alias("year")).distinct()
    made = made.withColumns({"start": cal.season_start(F.col("season"), F.col("year")), "end": cal.season_end(F.col("season"), F.col("year"))}).crossJoin(F.broadcast(first))
    return made.where((F.col("end") < F.lit(snap)) & (F.col("start") >= F.date_sub("first", SLACK_DAYS))).drop("first")


def stages_at_start(sales: DataFrame, values: DataFrame, seasons: DataFrame) -> DataFrame:
    """season, year, attribute, value, stage: the trend status (D6) of the day before each season, of all seasons in one pass.

    Report weeks are summed once; each meets the few seasons whose history it belongs to.
    """
    weeks = sales.groupBy("style", "channel", cal.chunk_ord(F.col("day")).alias("ord")).agg(F.sum("qty").alias("qty"))
    last = cal.chunk_ord(F.date_sub("start", 1))
    history = seasons.select("season", "year", last.alias("last")).withColumn("ord", F.explode(F.sequence(F.col("last") - design.BLOCKS * design.TREND + 1, F.col("last"))))
    frame = weeks.join(F.broadcast(history), "ord").select("season", "year", "style", (F.col("ord") - F.col("last")).cast("int").alias("offset"), "channel", "qty")
    keys = ("season", "year")
    return rankings.trend_status(design.weighted(frame, keys), values, keys).select(*keys, "attribute", "value", "stage")


def price_bands(prices: DataFrame) -> DataFrame:
    """style, price_band: fifths of the prices, 0 the lowest; edges that coincide count once, under ten prices give none."""
    edges = F.percentile("price", [k / BANDS for k in range(BANDS + 1)])
    found = prices.where("price IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.transform(edges, lambda e: F.bround(e, 6))).alias("edges"))  # one row
    band = F.when((F.col("n") >= 10) & F.col("price").isNotNull(), F.size(F.filter(F.slice("edges", 2, BANDS), lambda e: e < F.col("price"))))
    return prices.crossJoin(F.broadcast(found)).select("style", band.alias("price_band"))


def training_rows(sales: DataFrame, styles: DataFrame, prices: DataFrame, seasons: DataFrame, stages: DataFrame) -> DataFrame:
    """One row for each style and complete season from its first sale on, seasons without a sale included.

    style, season, year, ATTRIBUTES (Unknown where nothing is said), their stages as the season began
    ('none' if there is none), price_band, age_quarters, units, y (units up to the cap), cap.
    """
    d = F.col("day")
    first = sales.groupBy("style").agg(F.min("day").alias("first"))
    units = sales.groupBy("style", cal.season(d).alias("season"), cal.season_year(d).alias("year")).agg(F.sum("qty").alias("units"))
    said = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "Unknown").otherwise(F.col(c)).alias(c)
    rows = styles.select("style", *map(said, ATTRIBUTES)).join(first, "style").join(F.broadcast(seasons), F.col("first") <= F.col("end"))
    rows = rows.join(units, ["style", "season", "year"], "left").join(price_bands(prices), "style", "left").fillna(0, ["units"])
    for a in rankings.TRACKED:
        of = stages.where(F.col("attribute") == a).select("season", "year", F.col("value").alias(a), F.col("stage").alias(f"{a}_stage"))
        rows = rows.join(of, ["season", "year", a], "left")
    age = F.bround(F.greatest(F.lit(0.0), F.datediff("start", "first") / QUARTER_DAYS), 1)
    rows = rows.fillna("none", list(STAGES)).withColumn("age_quarters", age)
    cap = rows.groupBy("units").agg(F.count(F.lit(1)).alias("n")).agg(F.bround(F.percentile("units", CAP, F.col("n")), 6).alias("cap"))  # one row, from the counts of each number
    rows = rows.crossJoin(F.broadcast(cap)).withColumn("y", F.least(F.col("units").cast("double"), "cap"))
    return rows.select("style", "season", "year", *ATTRIBUTES, *STAGES, "price_band", "age_quarters", "units", "y", "cap")


def style_fold(style: Column, folds: int = FOLDS) -> Column:
    """The fold of a style: all of its rows are in one, whatever other styles there are."""
    return (F.conv(F.substring(F.md5(style.cast("binary")), 1, 8), 16, 10).cast("long") % folds).cast("int")


def vectors(rows: DataFrame) -> tuple[DataFrame, dict[str, list[str]]]:
    """Feature vectors of training rows (their columns, fold, features), and the values of each categorical column, few each."""
    said = rows.withColumns({f"{c}_in": F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in CATEGORICAL} | {f"{c}_in": _flat(F.col(c)) for c in NUMERIC})
    named = lambda kind: [f"{c}_{kind}" for c in CATEGORICAL]
    index = StringIndexer(inputCols=named("in"), outputCols=named("at"), handleInvalid="keep", stringOrderType="alphabetAsc")
    made = Pipeline(stages=[index, OneHotEncoder(inputCols=named("at"), outputCols=named("hot")), VectorAssembler(inputCols=[*(f"{c}_in" for c in NUMERIC), *named("hot")], outputCol="features")]).fit(said)
    out = made.transform(said).select(*rows.columns, style_fold(F.col("style")).alias("fold"), "features")
    return out, dict(zip(CATEGORICAL, map(list, made.stages[0].labelsArray), strict=True))


Fit = Callable[[DataFrame, tuple[float, float]], Callable[[DataFrame], DataFrame]]


def glm(rows: DataFrame, setting: tuple[float, float], max_iter: int = 15):
    """A fit of feature vectors; setting: variance power, ridge."""
    return GeneralizedLinearRegression(family="tweedie", variancePower=setting[0], linkPower=0.0, regParam=setting[1], maxIter=max_iter, labelCol="y", predictionCol="p").fit(rows)


def glm_fit(rows: DataFrame, setting: tuple[float, float]) -> Callable[[DataFrame], DataFrame]:
    return glm(rows, setting).transform


def out_of_fold(rows: DataFrame, grid: Sequence[tuple[float, float]], fit: Fit = glm_fit) -> DataFrame:
    """power, ridge, fold, style, season, year, y, cap, p: each row predicted by the model of the other folds, for each setting.

    The loop is over settings and folds, a few of each; the predictions of all stay one frame.
    """
    folds = sorted(r[0] for r in rows.select("fold").distinct().collect())  # five at most
    parts = [
        fit(rows.where(F.col("fold") != k), setting)(rows.where(F.col("fold") == k)).select(F.lit(float(setting[0])).alias("power"), F.lit(float(setting[1])).alias("ridge"), "fold", "style", "season", "year", "y", "cap", "p")
        for setting in grid
        for k in folds
    ]
    return reduce(DataFrame.unionByName, parts)


def chosen_setting(oof: DataFrame) -> DataFrame:
    """Power, ridge, wape (pooled over all folds), fold_wapes, baseline_wape (the other folds' average), sound, chosen.

    A setting is not sound, and never chosen, if a prediction isn't finite or is far beyond the cap.
    """
    p, y = F.col("p"), F.col("y")
    finite = p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    folds = oof.groupBy("power", "ridge", "fold").agg(
        F.sum(F.when(finite, F.abs(y - p))).alias("error"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"), F.max(~finite | (p > SOUND * F.greatest("cap", F.lit(1.0)))).alias("off")
    )
    all_ = folds.groupBy("power", "ridge").agg(F.sum("y").alias("all_y"), F.sum("n").alias("all_n"))
    mean = ((F.col("all_y") - F.col("y")) / (F.col("all_n") - F.col("n"))).alias("mean")  # of the rows that the fold's model was fitted to
    means = folds.join(F.broadcast(all_), ["power", "ridge"]).select("power", "ridge", "fold", mean)
    flat = oof.join(F.broadcast(means), ["power", "ridge", "fold"]).groupBy("power", "ridge").agg(F.sum(F.abs(y - F.col("mean"))).alias("flat"))
    per = lambda a: F.bround(F.col(a) / F.greatest(F.lit(1e-9), F.col("y")) * 100, 6)
    scores = folds.groupBy("power", "ridge").agg(
        F.sum("error").alias("error"), F.sum("y").alias("y"), F.max("off").alias("off"), F.transform(F.array_sort(F.collect_list(F.struct("fold", F.bround(F.col("error") / F.greatest(F.lit(1e-9), F.col("y")) * 100, 6).alias("w")))), lambda x: x["w"]).alias("fold_wapes")
    ).join(flat, ["power", "ridge"]).select("power", "ridge", per("error").alias("wape"), "fold_wapes", per("flat").alias("baseline_wape"), (~F.col("off")).alias("sound"))
    best = scores.where("sound").agg(F.min(F.struct("wape", "power", "ridge")).alias("b"))
    is_best = (F.col("power") == F.col("b.power")) & (F.col("ridge") == F.col("b.ridge"))
    return scores.crossJoin(F.broadcast(best)).select("power", "ridge", "wape", "fold_wapes", "baseline_wape", "sound", F.coalesce(is_best, F.lit(False)).alias("chosen"))


def fitted(rows: DataFrame, labels: dict[str, list[str]], setting: tuple[float, float]) -> Model:
    """The model of all rows, as weights by column and value."""
    made = glm(rows, setting)
    weights = iter(float(w) for w in made.coefficients)
    numeric = {c: next(weights) for c in NUMERIC}
    return Model(float(made.intercept), numeric, {c: {v: next(weights) for v in labels[c]} for c in CATEGORICAL})


def contributions(rows: DataFrame, model: Model) -> DataFrame:
    """Adds part_<column> for each feature, and base: what each feature adds to the log of the mean, over what it adds on average."""
    columns = (*NUMERIC, *CATEGORICAL)
    raw = rows.withColumns({f"part_{c}": model.part({c: F.col(c) if c in NUMERIC else F.coalesce(F.col(c).cast("string"), F.lit("none"))}) for c in columns})
    means = raw.agg(*(F.avg(f"part_{c}").alias(f"mean_{c}") for c in columns))  # one row
    out = raw.crossJoin(F.broadcast(means)).withColumn("base", sum((F.col(f"mean_{c}") for c in columns), F.lit(model.intercept)))
    return out.withColumns({f"part_{c}": F.col(f"part_{c}") - F.col(f"mean_{c}") for c in columns}).drop(*(f"mean_{c}" for c in columns))


def attribute_effects(parts: DataFrame, season: str, on_sale: DataFrame) -> DataFrame:
    """Attribute, value, effect_pct, rows: by how much a value sells more or less in a season; on_sale: attribute, value."""
    rows = parts.where(F.col("season") == season)
    enough = rows.agg((F.count(F.lit(1)) >= LEAST_ROWS).alias("enough"))
    pair = F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value"), F.col(f"part_{a}").alias("part")) for a in ATTRIBUTES)))
    by_value = rows.select(pair.alias("x")).select("x.*").where("value <> 'Unknown'").groupBy("attribute", "value").agg(F.avg("part").alias("effect"), F.count(F.lit(1)).alias("rows"))
    by_value = by_value.where(F.col("rows") >= LEAST_OF_VALUE).join(on_sale.select("attribute", "value").distinct(), ["attribute", "value"], "left_semi")
    return by_value.crossJoin(F.broadcast(enough)).where("enough").select("attribute", "value", F.bround((F.exp("effect") - 1) * 100, 1).alias("effect_pct"), "rows")
