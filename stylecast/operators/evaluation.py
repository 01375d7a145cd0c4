"""How good forecasts were: errors, walk-forward backtests, grids, data health."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .planning import blended


def wape(y: Column, p: Column) -> Column:
    """M8: 100 * sum of absolute errors / sum of absolute actuals; 0 where nothing sold."""
    total = F.sum(F.abs(y))
    return F.when(total == 0, 0.0).otherwise(F.sum(F.abs(y - p)) / total * 100)


def metrics(rows: DataFrame, y: str, p: str) -> DataFrame:
    """M8: one row: wape, mae, rmse, bias."""
    a, b = F.col(y), F.col(p)
    return rows.agg(wape(a, b).alias("wape"), F.avg(F.abs(a - b)).alias("mae"), F.sqrt(F.avg((a - b) * (a - b))).alias("rmse"), F.when(F.sum(a) != 0, F.sum(b - a) / F.sum(a) * 100).alias("bias"))


def scored(predictions: DataFrame, actual: DataFrame, last_week: date) -> DataFrame:
    """Predictions (snapshot, id, step, week, qty) of matured weeks beside their actuals (id, week, y); no sale is 0."""
    rows = predictions.where(F.col("week") <= F.lit(last_week)).join(actual, ["id", "week"], "left")
    return rows.withColumn("y", F.coalesce("y", F.lit(0)))


def latest_predictions(rows: DataFrame) -> DataFrame:
    """Of several snapshots, the latest one's prediction of each id and week."""
    return rows.groupBy("id", "week").agg(F.max_by("qty", "snapshot").alias("qty"), F.max("y").alias("y"))


def accuracy_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Accuracy (100 - WAPE, not under 0), units and rows, by keys."""
    return rows.groupBy(*keys).agg(F.greatest(F.lit(0.0), 100 - wape(F.col("y"), F.col("qty"))).alias("accuracy"), F.sum("y").alias("units"), F.count(F.lit(1)).alias("n"))


def cutoffs(weekly: DataFrame, step: int = 28, warm_up: int = 120, mature: int = 14) -> DataFrame:
    """E5: cutoff days: every step days after a warm-up, while the week after has matured; weekly: week.  None of a history too short."""
    span = weekly.agg(F.date_add(F.min("week"), warm_up).alias("a"), F.date_sub(F.max("week"), mature).alias("b"))  # one row
    return span.where("a <= b").select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {step} DAYS"))).alias("cutoff"))


def sweep(rows: DataFrame, alphas: list[float]) -> DataFrame:
    """Alpha, festival, wape for each blend, with and without event factors.  rows: y, model, naive, factor."""
    grid = rows.sparkSession.createDataFrame([(float(a), f) for a in alphas for f in (True, False)], "alpha double, festival boolean")
    factor = F.when(F.col("festival"), F.col("factor")).otherwise(1.0)
    q = F.greatest(F.lit(0.0), F.when(F.col("model").isNull(), F.col("naive") * factor).otherwise(F.col("alpha") * F.col("model") + (1 - F.col("alpha")) * F.col("naive") * factor))
    return rows.crossJoin(F.broadcast(grid)).groupBy("alpha", "festival").agg(wape(F.col("y"), q).alias("wape"))


# Rows that a load may lack; days after which data is old; what a day is above a normal one, in the run-rate and without an event;
# days of the run-rate, that unlisted spikes are looked for in, of a normal day; a calendar's factor that should show; least accuracy; days a style counts as selling.
LEAST_LOADED, STALE_DAYS, SPIKE, UNLISTED, RATE_DAYS, RECENT_DAYS, NORMAL_DAYS, EXPECTED, LEAST_ACCURACY, SELLING_DAYS = 0.995, 2, 2.0, 1.8, 60, 21, 91, 1.25, 70.0, 55


def health(daily: DataFrame, event_days: DataFrame, factors: DataFrame, log: DataFrame, sold: DataFrame, loads: DataFrame, today: date) -> DataFrame:
    """Severity, rule, n, value of the rules that fire, each measured on its own table, errors first (rank).

    daily: day, units.  event_days: day.  factors: day, factor.  log: week_start, status, forecast,
    actual.  sold: day, style, sub_category, qty.  loads: part, expected, got (rows); without a row no part is missing.
    """
    last = daily.agg(F.max("day").alias("snap"))  # one row, as are all measures
    days = last.select("snap", F.explode(F.sequence(F.date_sub("snap", NORMAL_DAYS - 1), "snap")).alias("day"))
    days = days.join(daily, "day", "left").join(event_days.select("day", F.lit(True).alias("listed")).distinct(), "day", "left").join(factors.select("day", "factor"), "day", "left")
    days = days.select("snap", "day", F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce("factor", F.lit(1.0)).alias("factor"))
    normal = days.agg(F.get(F.sort_array(F.collect_list("units")), F.lit(NORMAL_DAYS // 2)).alias("normal"))  # of 91 days
    days = days.crossJoin(F.broadcast(normal)).withColumn("ago", F.datediff("snap", "day"))
    above = lambda times, within: (F.col("ago") < within) & (F.col("units") > times * F.col("normal"))
    week = F.col("ago") < 7
    found = days.agg(
        F.max("normal").alias("normal"), F.datediff(F.lit(today), F.max("snap")).alias("old"), F.count_if(above(SPIKE, RATE_DAYS)).alias("spikes"), F.count_if(above(UNLISTED, RECENT_DAYS) & ~F.col("listed")).alias("unlisted"),
        F.avg(F.when(week, F.col("factor"))).alias("calendar"), F.avg(F.when(week, F.col("units"))).alias("real"),
    )
    rule = lambda df, severity, name, fires, n, value: df.where(fires).select(F.lit(severity).alias("severity"), F.lit(name).alias("rule"), n.cast("long").alias("n"), F.bround(value.cast("double"), 6).alias("value"))
    c, some = F.col, F.col("normal") > 0
    lacking = (c("got") < LEAST_LOADED * c("expected")) | (c("got") == 0)
    missing = loads.where(lacking).withColumn("rule_", F.when(c("part") == "sales", "sales_incomplete").when(c("part") == "master", "erp_master_missing").otherwise("erp_stock_missing"))
    missing = missing.groupBy("rule_").agg(F.count(F.lit(1)).alias("n"), (F.sum("got") / F.greatest(F.lit(1), F.sum("expected"))).alias("value"))
    missing = missing.select(F.when(c("rule_") == "erp_master_missing", "warning").otherwise("error").alias("severity"), c("rule_").alias("rule"), "n", F.bround("value", 6).alias("value"))
    done = log.where("status = 'completed' AND actual IS NOT NULL").groupBy("week_start").agg(F.sum(F.coalesce("forecast", F.lit(0))).alias("forecast"), F.sum("actual").alias("actual"))
    done = done.agg(F.max_by(F.struct("forecast", "actual"), "week_start").alias("x")).select("x.*")
    accuracy = F.greatest(F.lit(0.0), (1 - F.abs(c("forecast") - c("actual")) / c("actual")) * 100)
    nameless = sold.crossJoin(F.broadcast(last)).where((F.datediff("snap", "day") <= SELLING_DAYS) & F.coalesce("sub_category", F.lit("")).isin("", "Unclassified"))
    nameless = nameless.groupBy("style").agg(F.sum("qty").alias("qty")).where("qty <> 0").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))
    parts = [
        missing,
        rule(found, "warning", "data_stale", c("old") > STALE_DAYS, c("old"), c("old")),
        rule(found, "warning", "runrate_spike", some & (c("spikes") > 0), c("spikes"), c("normal")),
        rule(found, "warning", "calendar_missing_event", some & (c("unlisted") > 0), c("unlisted"), c("normal")),
        rule(found, "warning", "calendar_event_not_seen", some & (c("calendar") >= EXPECTED) & (c("real") < EXPECTED * c("normal")), F.lit(7), c("calendar")),
        rule(done.where("actual > 0"), "warning", "accuracy_low", accuracy < LEAST_ACCURACY, c("actual"), accuracy),
        rule(nameless, "info", "master_missing", c("n") > 0, c("n"), c("qty")),
    ]
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("rank", F.when(c("severity") == "error", 0).when(c("severity") == "warning", 1).otherwise(2)).orderBy("rank", "rule")


__all__ = ["accuracy_by", "blended", "cutoffs", "health", "latest_predictions", "metrics", "scored", "sweep", "wape"]
