"""The forecast model: a Tweedie regression with a log link on the panel's features.

The log of the mean is a sum over features, so a fitted model is an expression of columns:
scoring and the recursion over coming weeks stay in one pass, without a step's shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from . import festival, joins, panel
from .evaluation import wape
from ..functions import calendar as cal

HISTORY = (
    *(f"lag_{k}" for k in panel.LAGS), *(f"rolling_mean_{k}" for k in panel.MEANS), *(f"rolling_std_{k}" for k in panel.STDS), "rolling_max_4", "rolling_min_4", "sales_diff_1", "sales_growth_pct",
    "rolling_mean_ratio", "trend_vs_avg", "coefficient_variation", "avg_weekly_sales", "zero_sales_ratio",
)
NUMERIC = (*HISTORY, "age_weeks", "design_level", "launch_drr", "factor", "is_festival", "days_to_peak")
#: Columns of few values each; ids are no feature, their level is.
ATTRIBUTES = ("category", "sub_category", "colour", "fabric", "neck", "embroidery")
CATEGORICAL = (*ATTRIBUTES, "tier", "month", "event", "category_event")


def feature_rows(weekly: DataFrame, styles: DataFrame, tiers: DataFrame, launches: DataFrame, windows_: DataFrame, effects: DataFrame, launch_days: int = 20) -> DataFrame:
    """M6: id, week, y and all features of each week, as they were known before it.

    weekly: id, week, y.  styles: style, ATTRIBUTES.  tiers: name, effective_from, tier.
    launches: id, launch.  The launch rate counts once the launch is over.
    """
    rows = panel.lag_features(panel.dense(weekly))
    rows = joins.with_styles(rows, styles, ATTRIBUTES, key="id")
    rows = joins.tier_as_of(rows, tiers, "id", "week")
    rows = rows.join(panel.launch_rates(weekly, launches, launch_days), "id", "left")
    old = F.datediff("week", "launch") >= launch_days
    rows = rows.join(launches, "id", "left").withColumn("launch_drr", F.when(old, F.coalesce("launch_drr", F.lit(0.0))).otherwise(0.0)).drop("launch")
    rows = panel.product_age(rows, launches)
    level = panel.design_level_before(weekly.where(F.col("y") > 0)).select("id", "week", "design_level")
    rows = rows.join(level, ["id", "week"], "left").fillna(0.0, ["design_level"])
    signals = festival.week_signals(rows.select("week"), windows_, effects)
    return _with_signals(rows.join(F.broadcast(signals), "week")).select("*", *cal.week_features(F.col("week")))


def _with_signals(rows: DataFrame) -> DataFrame:
    """Adds is_festival, event ('None' where there is none) and the cross of category and event; rows has factor and event."""
    rows = rows.withColumn("event", F.coalesce("event", F.lit("None"))).withColumn("is_festival", (F.col("factor") > 1).cast("int"))
    return rows.withColumn("category_event", F.concat_ws("_", "category", "event"))


def _flat(c: Column) -> Column:
    """A figure on a logarithmic scale that keeps its sign; what is unknown is 0."""
    x = F.coalesce(c.cast("double"), F.lit(0.0))
    return F.signum(x) * F.log1p(F.abs(x))


@dataclass(frozen=True)
class Model:
    """Weights by numeric column, and by value of each categorical one; values unseen in training weigh nothing."""

    intercept: float
    numeric: dict[str, float]
    levels: dict[str, dict[str, float]]

    def part(self, columns: dict[str, Column]) -> Column:
        """What the given columns add to the log of the mean."""
        total = F.lit(0.0)
        for name, c in columns.items():
            if name in self.numeric:
                total = total + F.lit(self.numeric[name]) * _flat(c)
            elif self.levels.get(name):
                weights = F.create_map(*(F.lit(v) for kv in self.levels[name].items() for v in kv))
                total = total + F.coalesce(F.try_element_at(weights, c.cast("string")), F.lit(0.0))
        return total

    def mean(self, log_mean: Column) -> Column:
        """The forecast; the exponent is held where it is finite."""
        return F.exp(F.least(log_mean + self.intercept, F.lit(50.0)))


def predicted(rows: DataFrame, model: Model) -> DataFrame:
    """Adds qty, the model's mean for each feature row."""
    return rows.withColumn("qty", model.mean(model.part({c: F.col(c) for c in (*NUMERIC, *CATEGORICAL)})))


@dataclass(frozen=True)
class Design:
    """Feature vectors of the training rows (id, week, y, weight, features) and the values of each categorical column."""

    rows: DataFrame
    labels: dict[str, list[str]]


def design(features: DataFrame, half_life: int = 26) -> Design:
    """Feature vectors with recency weights; the values of CATEGORICAL, few each, come to the driver as names of slots."""
    rows = panel.recency_weights(features, half_life)
    rows = rows.select("id", "week", F.col("y").cast("double").alias("y"), "weight", *(_flat(F.col(c)).alias(c) for c in NUMERIC), *(F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias(c) for c in CATEGORICAL))
    at, hot = [f"{c}_at" for c in CATEGORICAL], [f"{c}_hot" for c in CATEGORICAL]
    index = StringIndexer(inputCols=list(CATEGORICAL), outputCols=at, handleInvalid="keep", stringOrderType="alphabetAsc")
    stages = Pipeline(stages=[index, OneHotEncoder(inputCols=at, outputCols=hot), VectorAssembler(inputCols=[*NUMERIC, *hot], outputCol="features")]).fit(rows)
    out = stages.transform(rows).select("id", "week", "y", "weight", "features")
    return Design(out, dict(zip(CATEGORICAL, map(list, stages.stages[0].labelsArray), strict=True)))


def fitted(rows: DataFrame, labels: dict[str, list[str]], power: float, ridge: float, max_iter: int = 15) -> Model:
    """One weighted fit of feature vectors."""
    glm = GeneralizedLinearRegression(family="tweedie", variancePower=power, linkPower=0.0, regParam=ridge, maxIter=max_iter, labelCol="y", weightCol="weight").fit(rows)
    weights = iter(float(w) for w in glm.coefficients)
    numeric = {c: next(weights) for c in NUMERIC}
    return Model(float(glm.intercept), numeric, {c: {v: next(weights) for v in labels[c]} for c in CATEGORICAL})


def selection(made: Design, features: DataFrame, folds: DataFrame, grid: tuple[tuple[float, float], ...]) -> DataFrame:
    """M9: power, ridge, wape, naive_wape, chosen: the mean WAPE of each setting over rolling folds, and that of the mean of four weeks.

    folds: fold, role, week.  The loop is over settings and folds, a few of each.
    """
    spark = features.sparkSession
    found = []
    for (k,) in folds.select("fold").distinct().orderBy("fold").collect():
        train, val = (F.broadcast(folds.where((F.col("fold") == k) & (F.col("role") == r)).select("week")) for r in ("train", "val"))
        held, rows = features.join(val, "week").persist(), made.rows.join(train, "week").persist()  # each fit reads its rows once an iteration
        if rows.isEmpty() or held.isEmpty():
            continue
        for power, ridge in grid:
            scored = predicted(held, fitted(rows, made.labels, power, ridge))
            score = scored.agg(wape(F.col("y"), F.col("qty")), wape(F.col("y"), F.coalesce("rolling_mean_4", F.lit(0.0)))).first()
            found.append((power, ridge, float(score[0]), float(score[1])))
        held.unpersist(), rows.unpersist()
    scores = spark.createDataFrame(found, "power double, ridge double, wape double, naive_wape double").groupBy("power", "ridge").agg(F.avg("wape").alias("wape"), F.avg("naive_wape").alias("naive_wape"))
    best = scores.agg(F.min(F.struct("wape", "power", "ridge")).alias("b"))
    return scores.crossJoin(F.broadcast(best)).select("power", "ridge", "wape", "naive_wape", ((F.col("power") == F.col("b.power")) & (F.col("ridge") == F.col("b.ridge"))).alias("chosen"))


def importances(made: Design, model: Model) -> DataFrame:
    """Feature, importance: the share of each feature's weight times its spread; a categorical column is the sum of its values."""
    spread = made.rows.select(Summarizer.std(F.col("features")).alias("s")).first()["s"]
    slots = [(c, w) for c, w in model.numeric.items()] + [(c, w) for c in CATEGORICAL for w in model.levels[c].values()]
    rows = made.rows.sparkSession.createDataFrame([(c, abs(w) * float(s)) for (c, w), s in zip(slots, spread, strict=True)], "feature string, part double")
    total = rows.agg(F.sum("part").alias("total"))
    return rows.groupBy("feature").agg(F.sum("part").alias("part")).crossJoin(F.broadcast(total)).select("feature", F.when(F.col("total") > 0, F.col("part") / F.col("total")).otherwise(0.0).alias("importance"))


def _history_features(h: Column, total: Column, n: Column, zeros: Column) -> dict[str, Column]:
    """HISTORY from an array of the latest weeks, the newest last, and running figures of all weeks."""
    size = F.size(h)
    lag = lambda k: F.get(h, size - k)
    last = lambda k: F.slice(h, F.greatest(F.lit(1), size - k + 1), F.lit(k))
    count = lambda k: F.least(size, F.lit(k))
    mean = lambda k: F.when(size > 0, F.aggregate(last(k), F.lit(0.0), lambda a, x: a + x) / count(k))
    squares = lambda k: F.aggregate(last(k), F.lit(0.0), lambda a, x: a + x * x)
    std = lambda k: F.when(size > 1, F.sqrt(F.greatest(F.lit(0.0), squares(k) - count(k) * mean(k) * mean(k)) / (count(k) - 1)))
    per = lambda a, b: F.when(F.coalesce(b, F.lit(0.0)) == 0, 0.0).otherwise(a / b)
    out = {f"lag_{k}": lag(k) for k in panel.LAGS} | {f"rolling_mean_{k}": mean(k) for k in panel.MEANS} | {f"rolling_std_{k}": std(k) for k in panel.STDS}
    return out | {
        "rolling_max_4": F.array_max(last(4)), "rolling_min_4": F.array_min(last(4)), "sales_diff_1": lag(1) - lag(2), "sales_growth_pct": per(lag(1) - lag(2), lag(2)), "rolling_mean_ratio": per(lag(1), mean(4)),
        "trend_vs_avg": lag(1) - mean(4), "coefficient_variation": per(std(4), mean(4)), "avg_weekly_sales": F.when(n > 0, total / n), "zero_sales_ratio": F.when(n > 0, zeros / n),
    }


def recursive_forecast(weekly: DataFrame, static: DataFrame, signals: DataFrame, model: Model, last: date, horizon: int = 40) -> DataFrame:
    """Id, step (from 1), week, qty: each week's forecast is the history of the next one.

    static: id, ATTRIBUTES, tier, launch, design_level, launch_drr.  signals: week, factor,
    event, days_to_peak of the coming weeks.  An id's state is an array of its latest weeks
    and three running figures, folded over the weeks within its row.
    """
    deep, y = max(panel.LAGS), F.col("y").cast("double")
    recent = F.when(F.col("week") > F.date_sub(F.lit(last), 7 * deep), F.struct("week", y.alias("y")))
    hist = panel.dense(weekly).where(F.col("week") <= F.lit(last)).groupBy("id").agg(F.array_sort(F.collect_list(recent)).alias("h"), F.sum(y).alias("total"), F.count(F.lit(1)).cast("double").alias("n"), F.count_if(y == 0).cast("double").alias("zeros"))
    coming = signals.where((F.col("week") > F.lit(last)) & (F.col("week") <= F.date_add(F.lit(last), 7 * horizon)))
    signal = F.struct("week", "factor", "event", "days_to_peak", F.month("week").alias("month"))
    weeks = coming.withColumn("event", F.coalesce("event", F.lit("None"))).agg(F.array_sort(F.collect_list(signal)).alias("weeks"))  # one row of as many weeks as the horizon has
    rows = hist.join(static, "id", "left").fillna("Unknown", ["tier"]).fillna("Unclassified", list(ATTRIBUTES)).crossJoin(F.broadcast(weeks))
    rows = rows.withColumn("fixed", model.part({c: F.col(c) for c in (*ATTRIBUTES, "tier", "design_level", "launch_drr")}))

    def step(s: Column, w: Column) -> Column:
        age = F.when(F.col("launch").isNull(), -1).otherwise(F.greatest(F.floor(F.datediff(w["week"], F.col("launch")) / 7), F.lit(0)))
        ahead = {"age_weeks": age, "factor": w["factor"], "is_festival": (w["factor"] > 1).cast("int"), "days_to_peak": w["days_to_peak"], "month": w["month"], "event": w["event"], "category_event": F.concat_ws("_", F.col("category"), w["event"])}
        q = model.mean(F.col("fixed") + model.part(ahead) + model.part(_history_features(s["h"], s["total"], s["n"], s["zeros"])))
        # the forecast is worked out once: what follows takes it from an array of one
        following = F.transform(F.array(q), lambda v: F.struct(F.slice(F.concat(s["h"], F.array(v)), F.greatest(F.lit(1), F.size(s["h"]) + 2 - deep), F.lit(deep)).alias("h"), (s["total"] + v).alias("total"), (s["n"] + 1).alias("n"), (s["zeros"] + (v == 0).cast("double")).alias("zeros"), F.concat(s["out"], F.array(v)).alias("out")))
        return F.get(following, F.lit(0))

    start = F.struct(F.transform("h", lambda x: x["y"]).alias("h"), "total", "n", "zeros", F.array().cast("array<double>").alias("out"))
    made = rows.select("id", F.aggregate("weeks", start, step, lambda s: s["out"]).alias("out"))
    out = made.select("id", F.posexplode("out").alias("k", "qty"))
    return out.select("id", (F.col("k") + 1).alias("step"), F.date_add(F.lit(last), 7 * (F.col("k") + 1)).alias("week"), F.bround("qty", 3).alias("qty"))
