"""The weekly panel and its features.

weekly: id, week (Monday), y.  All windows are by id, so that one shuffle serves them all.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import calendar as cal

LAGS, MEANS, STDS = (1, 2, 4, 8, 12, 26, 52), (4, 8, 12), (4, 8)


def matured(weekly: DataFrame, last_order: date, buffer_days: int = 7) -> DataFrame:
    """M1: weeks that ended a buffer before the last order."""
    return weekly.where(F.date_add("week", 6 + buffer_days) <= F.lit(last_order))


def dense(weekly: DataFrame) -> DataFrame:
    """Every week from an id's first to the last of all, 0 where nothing sold."""
    last = weekly.agg(F.max("week").alias("last"))
    spans = weekly.groupBy("id").agg(F.min("week").alias("first")).crossJoin(F.broadcast(last))
    grid = spans.select("id", F.explode(F.sequence("first", "last", F.expr("interval 7 days"))).alias("week"))
    return grid.join(weekly, ["id", "week"], "left").fillna(0, ["y"])


def capped(weekly: DataFrame, event_weeks: DataFrame, cutoff: date, share: float = 0.99) -> DataFrame:
    """A10: cuts weeks without events at each id's percentile, which is taken over such weeks up to the cutoff."""
    marked = weekly.join(event_weeks.select("week").distinct().withColumn("event_", F.lit(True)), "week", "left")
    quiet = F.col("event_").isNull()
    cap = marked.where(quiet & (F.col("week") <= F.lit(cutoff))).groupBy("id").agg(F.expr(f"percentile(y, {share})").alias("cap"))
    y = F.when(quiet & F.col("cap").isNotNull(), F.least(F.col("y").cast("double"), F.col("cap"))).otherwise(F.col("y").cast("double"))
    return marked.join(cap, "id", "left").select("id", "week", y.alias("y"))


def _over(lo: int | None, hi: int) -> Window:
    w = Window.partitionBy("id").orderBy("week")
    return w.rowsBetween(Window.unboundedPreceding if lo is None else lo, hi)


def lag_features(panel: DataFrame) -> DataFrame:
    """Lags, rolling means, deviations, extremes, trends and expanding figures of the weeks before."""
    w = Window.partitionBy("id").orderBy("week")
    out = panel.select("id", "week", "y", *(F.lag("y", k).over(w).alias(f"lag_{k}") for k in LAGS), *(F.avg("y").over(_over(-k, -1)).alias(f"rolling_mean_{k}") for k in MEANS),
        *(F.stddev_samp("y").over(_over(-k, -1)).alias(f"rolling_std_{k}") for k in STDS), F.max("y").over(_over(-4, -1)).alias("rolling_max_4"), F.min("y").over(_over(-4, -1)).alias("rolling_min_4"),
        F.avg("y").over(_over(None, -1)).alias("avg_weekly_sales"), F.avg((F.col("y") == 0).cast("double")).over(_over(None, -1)).alias("zero_sales_ratio"))
    per = lambda a, b: F.when(F.coalesce(b, F.lit(0)) == 0, 0.0).otherwise(a / b)
    l1, l2, m4 = F.col("lag_1"), F.col("lag_2"), F.col("rolling_mean_4")
    return out.withColumns({"sales_diff_1": l1 - l2, "sales_growth_pct": per(l1 - l2, l2), "rolling_mean_ratio": per(l1, m4), "trend_vs_avg": l1 - m4, "coefficient_variation": per(F.col("rolling_std_4"), m4)})


def design_level_before(design_weeks: DataFrame, n: int = 12) -> DataFrame:
    """The median of a design's weeks with sales before each week; design_weeks: id, week, y."""
    return design_weeks.select("id", "week", "y", F.expr(f"percentile(y, 0.5) OVER (PARTITION BY id ORDER BY week ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)").alias("design_level"))


def recent_level(design_weeks: DataFrame, last: date, n: int = 12) -> DataFrame:
    """The median of a design's weeks with sales among the last n."""
    return design_weeks.where(F.col("week") > F.date_sub(F.lit(last), 7 * n)).groupBy("id").agg(F.expr("percentile(y, 0.5)").alias("level"))


def recency_weights(panel: DataFrame, half_life: int = 26) -> DataFrame:
    """Weight that halves with each half-life of weeks of age."""
    last = panel.agg(F.max("week").alias("last"))
    age = F.greatest(F.datediff("last", "week") / 7, F.lit(0))
    return panel.crossJoin(F.broadcast(last)).withColumn("weight", F.pow(F.lit(0.5), age / half_life)).drop("last")


def launch_rates(weekly: DataFrame, launches: DataFrame, window_days: int = 20) -> DataFrame:
    """M3: daily rate of the weeks that start within the launch window; launches: id, launch."""
    young = weekly.join(launches, "id").where(F.datediff("week", "launch").between(0, window_days - 1))
    return young.groupBy("id").agg((F.sum("y") / (F.count(F.lit(1)) * 7)).alias("launch_drr"))


def launch_dates(master: DataFrame, first: date) -> DataFrame:
    """The earliest plausible launch of each design; master: id, launch."""
    return master.where(F.col("launch") >= F.lit(first)).groupBy("id").agg(F.min("launch").alias("launch"))


def product_age(panel: DataFrame, launches: DataFrame) -> DataFrame:
    """M4: weeks since launch, -1 where unknown."""
    age = F.floor(F.datediff("week", "launch") / 7).cast("int")
    return panel.join(launches, "id", "left").withColumn("age_weeks", F.when(age.isNull(), -1).otherwise(F.greatest(age, F.lit(0)))).drop("launch")


def active_ids(weekly: DataFrame, last: date, weeks: int = 13) -> DataFrame:
    """Ids with sales in the last weeks."""
    return weekly.where((F.col("week") > F.date_sub(F.lit(last), 7 * weeks)) & (F.col("y") > 0)).select("id").distinct()


def rolling_folds(weeks: DataFrame, folds: int = 3, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """M7: fold, role (train or val), week: rolling origins, none of them in the test tail.

    The table of weeks is a calendar of a few hundred rows.
    """
    numbered = weeks.select("week").distinct().withColumn("i", F.row_number().over(Window.orderBy("week")) - 1)
    n = numbered.agg(F.count(F.lit(1)).alias("n"))
    span, tail = F.greatest(F.lit(1), F.floor(F.col("n") * val)), F.greatest(F.lit(1), F.floor(F.col("n") * test))
    rows = numbered.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(weeks.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold"))))
    begin = F.col("n") - tail - span * (folds - F.col("fold"))
    role = F.when(F.col("i") < begin, "train").when(F.col("i") < begin + span, "val")
    return rows.select("fold", role.alias("role"), "week").where(F.col("role").isNotNull())


def forward_targets(panel: DataFrame, horizon: int = 13) -> DataFrame:
    """Id, week (the origin), step (from 1), target_week, target, lag features at the origin."""
    w = Window.partitionBy("id").orderBy("week")
    ahead = panel.withColumn("targets", F.array(*(F.lead("y", s - 1).over(w) for s in range(1, horizon + 1))))
    out = ahead.select("*", F.posexplode("targets").alias("_p", "target")).where(F.col("target").isNotNull())
    return out.withColumn("step", F.col("_p") + 1).withColumn("target_week", F.date_add("week", F.col("_p") * 7)).drop("_p", "targets")


def weekly_of(frame: DataFrame, key: str, day: str = "day", qty: str = "qty") -> DataFrame:
    return frame.groupBy(F.col(key).alias("id"), cal.monday(F.col(day)).alias("week")).agg(F.sum(qty).alias("y"))


#: Ranges that the distinct values of a percentile rank are dealt to.
RANGES = 64


def percentile_rank(rows: DataFrame, **of: str) -> DataFrame:
    """Adds for each name=column the rank in per cent of the count, ties averaged; null stays null.

    Counted by value: the rows of a value are one row, ranges of values are summed up by
    themselves, and what lies below a range comes from one row with the sums of all ranges.
    """
    for out, c in of.items():
        values = rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n_"))
        edges = values.agg(F.percentile_approx(c, [k / RANGES for k in range(1, RANGES)], 10_000).alias("edges_"))
        values = values.crossJoin(F.broadcast(edges)).withColumn("range_", F.size(F.filter("edges_", lambda e: e < F.col(c)))).drop("edges_")
        sums = values.groupBy("range_").agg(F.sum("n_").alias("n")).agg(F.collect_list(F.struct("range_", "n")).alias("sums_"), F.sum("n").alias("all_"))  # RANGES at most
        below = F.aggregate(F.filter("sums_", lambda x: x["range_"] < F.col("range_")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
        upto = F.sum("n_").over(Window.partitionBy("range_").orderBy(c))
        ranks = values.crossJoin(F.broadcast(sums)).select(c, ((below + upto - (F.col("n_") - 1) / 2) / F.col("all_")).alias(out))
        rows = rows.join(ranks, c, "left")
    return rows
