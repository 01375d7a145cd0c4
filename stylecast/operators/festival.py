"""Effects of festivals and sales on daily and weekly demand.

events: name, start_date, end_date, category.  windows: name, start_date, end_date.
effects: name, multiplier.  daily: day, units.
"""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

#: A multiplier this near to 1 is noise; day multipliers are held within the limits.
NOISE, LOWEST, HIGHEST = 0.07, 0.5, 3.0
# Windows derived from an event: name, event, first and last day relative to its start (None: its end).
DERIVED = (("Diwali dip", "Diwali (Festival)", -2, None), ("Pre-Rakhi shopping", "Raksha Bandhan (Festival)", -10, -4))
REPLACED = ("Diwali (Festival)",)


def windows(events: DataFrame) -> DataFrame:
    """Events and the windows derived from them; a replaced event only has its derived window."""
    out = events.where(~F.col("name").isin(*REPLACED)).select("name", "start_date", "end_date")
    for name, event, first, last in DERIVED:
        end = F.col("end_date") if last is None else F.date_add("start_date", last)
        out = out.unionByName(events.where(F.col("name") == event).select(F.lit(name).alias("name"), F.date_add("start_date", first).alias("start_date"), end.alias("end_date")))
    return out


def window_days(windows_: DataFrame) -> DataFrame:
    return windows_.select("name", F.explode(F.sequence("start_date", "end_date")).alias("day")).distinct()


def dense_days(daily: DataFrame, drop_last: bool = False) -> DataFrame:
    """Every day from the first to the last, with 0 where nothing sold; a calendar of days is small."""
    span = daily.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(F.explode(F.sequence("lo", F.date_sub("hi", 1) if drop_last else F.col("hi"))).alias("day"))
    return span.join(daily, "day", "left").fillna(0, ["units"])


def with_units(rows: DataFrame, daily: DataFrame) -> DataFrame:
    """Adds the units sold on the days of each row's start_date to end_date, 0 where nothing sold."""
    keys = rows.columns
    days = rows.withColumn("day", F.explode(F.sequence("start_date", "end_date"))).join(daily, "day", "left")
    return days.groupBy(*keys).agg(F.coalesce(F.sum("units"), F.lit(0)).cast("long").alias("units"))


def same_weekday_baseline(daily: DataFrame, windows_: DataFrame, least: int = 4, most: int = 6, weeks: int = 26) -> DataFrame:
    """day, units, baseline: the median of the nearest quiet days of the same weekday before; the newest day is left out."""
    days = dense_days(daily, drop_last=True)
    quiet = days.join(window_days(windows_).select("day").distinct(), "day", "left_anti").select(F.col("day").alias("quiet_day"), F.col("units").alias("quiet_units"))
    before = F.explode(F.transform(F.sequence(F.lit(1), F.lit(weeks)), lambda k: F.date_add("day", -7 * k)))
    near = days.withColumn("quiet_day", before).join(quiet, "quiet_day")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("quiet_day")))).where(F.col("r") <= most)
    out = near.groupBy("day", "units").agg(F.expr("percentile(quiet_units, 0.5)").alias("baseline"), F.count(F.lit(1)).alias("n"))
    return out.where((F.col("n") >= least) & (F.col("baseline") > 0)).select("day", "units", "baseline")


def normal_equations(daily: DataFrame, windows_: DataFrame) -> DataFrame:
    """a, b, n, xy: days that two events share, and (where b is a) the sum of an event's log ratios; grouped joins over days."""
    y = F.ln(F.least(F.lit(5.0), F.greatest(F.lit(0.2), F.col("units") / F.col("baseline"))))
    x = window_days(windows_).join(same_weekday_baseline(daily, windows_).select("day", y.alias("y")), "day")
    pairs = x.select("day", F.col("name").alias("a"), "y").join(x.select("day", F.col("name").alias("b")), "day")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("y"))).alias("xy"))


def calibrated(daily: DataFrame, windows_: DataFrame, ridge: float = 5.0, least_days: int = 60) -> DataFrame:
    """name, multiplier: a joint log-linear ridge of daily ratios on the events' days.

    Only the square of the event names comes to the driver, to be solved.
    """
    spark = daily.sparkSession
    sums = normal_equations(daily, windows_).collect()
    names = sorted({r["a"] for r in sums})
    if not names or same_weekday_baseline(daily, windows_).count() < least_days:
        return spark.createDataFrame([], "name string, multiplier double")
    at = {n: k for k, n in enumerate(names)}
    xx, xy = np.zeros((len(names),) * 2), np.zeros(len(names))
    for r in sums:
        xx[at[r["a"]], at[r["b"]]] = r["n"]
        if r["a"] == r["b"]:
            xy[at[r["a"]]] = r["xy"]
    beta = np.linalg.solve(xx + ridge * np.eye(len(names)), xy)
    return spark.createDataFrame([(n, round(float(np.exp(b)), 3)) for n, b in zip(names, beta, strict=True)], "name string, multiplier double")


def _real(m: Column) -> Column:
    return F.abs(m - 1) > NOISE


def day_factors(days: DataFrame, windows_: DataFrame, effects: DataFrame) -> DataFrame:
    """day, factor, event: the product of the active effects, and the strongest one; 1 where none is."""
    active = window_days(windows_).join(effects, "name").where(_real(F.col("multiplier")))
    strength = F.abs(F.ln("multiplier"))
    made = active.groupBy("day").agg(F.exp(F.sum(F.ln("multiplier"))).alias("m"), F.min_by("name", F.struct(-strength, F.col("name"))).alias("event"))
    made = made.select("day", F.bround(F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.col("m"))), 9).alias("factor"), "event")
    return days.select("day").distinct().join(made, "day", "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))


def uplift_windows(windows_: DataFrame, effects: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """windows of effects that raise sales, those that overlap a span if one is given."""
    out = windows_.join(effects, "name").where(F.col("multiplier") > 1 + NOISE)
    if start is not None:
        out = out.where((F.col("start_date") <= F.lit(end)) & (F.col("end_date") >= F.lit(start)))
    return out


def week_signals(weeks: DataFrame, windows_: DataFrame, effects: DataFrame, far: int = 999) -> DataFrame:
    """week, factor (mean of its days), event (most days, then name), days_to_peak (signed, to the nearest middle of an uplift)."""
    days = weeks.select("week").distinct().withColumn("day", F.explode(F.sequence("week", F.date_add("week", 6))))
    factors = days.join(day_factors(days, windows_, effects), "day")
    mean = factors.groupBy("week").agg(F.bround(F.sum("factor") / 7, 9).alias("factor"))
    most = factors.where(F.col("event").isNotNull()).groupBy("week", "event").agg(F.count(F.lit(1)).alias("n")).groupBy("week").agg(F.min_by("event", F.struct(-F.col("n"), F.col("event"))).alias("event"))
    middle = uplift_windows(windows_, effects).select(F.date_add("start_date", F.floor(F.datediff("end_date", "start_date") / 2).cast("int")).alias("middle")).distinct()
    gap = F.datediff("middle", "week")
    # the calendar's windows are few and known; both sides are weeks and events
    near = weeks.select("week").distinct().crossJoin(F.broadcast(middle)).groupBy("week").agg(F.min_by(gap, F.struct(F.abs(gap), gap)).alias("gap"))
    out = mean.join(most, "week", "left").join(near, "week", "left")
    return out.select("week", "factor", "event", F.when(F.abs("gap") < far, F.col("gap")).otherwise(far).alias("days_to_peak"))


def next_event(events: DataFrame, category: str, as_of: date) -> DataFrame:
    """the running or next event of a category."""
    return events.where((F.col("category") == category) & (F.col("end_date") >= F.lit(as_of))).orderBy("start_date", "name").limit(1)


def past_occurrence(events: DataFrame, name: str, before: date) -> DataFrame:
    """the latest occurrence of an event before a day."""
    return events.where((F.col("name") == name) & (F.col("end_date") < F.lit(before))).orderBy(F.desc("start_date")).limit(1)


def spikes(weekly: DataFrame, windows_: DataFrame, least_pct: int = 10) -> DataFrame:
    """F8: each id's best uplift of a window over its mean week without events: id, event, event_start, event_end, qty, uplift_pct.

    weekly: id, week, qty.  Quantities are spread over days, those of a window summed.
    """
    hull = weekly.agg(F.min("week").alias("lo"), F.date_add(F.max("week"), 6).alias("hi"))
    clipped = windows_.crossJoin(F.broadcast(hull)).select("name", F.greatest("start_date", "lo").alias("event_start"), F.least("end_date", "hi").alias("event_end")).where(F.col("event_start") <= F.col("event_end"))
    days = clipped.withColumn("day", F.explode(F.sequence("event_start", "event_end"))).withColumn("week", F.date_trunc("week", "day").cast("date"))
    per_week = days.groupBy("name", "event_start", "event_end", "week").agg(F.count(F.lit(1)).alias("n_days"))
    busy = per_week.select("week").distinct().withColumn("busy", F.lit(True))
    marked = weekly.join(busy, "week", "left")
    base = marked.groupBy("id").agg(F.avg(F.when(F.col("busy").isNull(), F.col("qty"))).alias("quiet"), F.avg("qty").alias("mean")).select("id", F.coalesce("quiet", "mean").alias("base")).where("base > 0")
    got = weekly.join(per_week, "week").groupBy("id", "name", "event_start", "event_end").agg(F.sum(F.col("qty") / 7 * F.col("n_days")).alias("qty"))
    got = got.join(base, "id").withColumn("uplift_pct", F.bround((F.col("qty") / (F.datediff("event_end", "event_start") + 1) / (F.col("base") / 7) - 1) * 100, 0).cast("int")).where(F.col("uplift_pct") >= least_pct)
    best = got.groupBy("id").agg(F.min_by(F.struct("name", "event_start", "event_end", "qty", "uplift_pct"), F.struct(-F.col("uplift_pct"), F.col("event_start"), F.col("name"))).alias("b"))
    return best.select("id", F.col("b.name").alias("event"), "b.event_start", "b.event_end", F.bround("b.qty", 0).cast("long").alias("qty"), "b.uplift_pct")


def outlook(sales: DataFrame, start: date, end: date, group: str, top: int) -> DataFrame:
    """What sold in a past event by group, and its change against as many days just before; a top report."""
    n = (end - start).days + 1
    inside, before = F.col("day").between(F.lit(start), F.lit(end)), F.col("day").between(F.lit(start - timedelta(days=n)), F.lit(start - timedelta(days=1)))
    rows = sales.where(inside | before).groupBy(group).agg(F.sum(F.when(inside, F.col("qty"))).alias("qty"), F.sum(F.when(before, F.col("qty")).otherwise(0)).alias("before"))
    pct = F.when(F.col("before") > 0, F.bround((F.col("qty") / F.col("before") - 1) * 100, 0).cast("int"))
    return rows.where(F.col("qty").isNotNull() & F.col(group).isNotNull()).select(group, "qty", pct.alias("uplift_pct")).orderBy(F.desc("qty"), group).limit(top)


def spike_lead_days(daily: DataFrame, events: DataFrame, name: str, start: date, look_back: int = 50, far: int = 45, near: int = 15, ratio: float = 1.2, least_days: int = 8, least_units: float = 3.0) -> DataFrame:
    """One row, lead_days: how many days before an event its sales first rise over the quiet level; null if they don't."""
    first = F.lit(start - timedelta(days=look_back))
    days = daily.sparkSession.range(1).select(F.explode(F.sequence(first, F.lit(start - timedelta(days=1)))).alias("day")).join(daily, "day", "left").fillna(0, ["units"])
    offset = F.datediff("day", F.lit(start))
    other = events.where(F.col("name") != name).select(F.explode(F.sequence("start_date", "end_date")).alias("day")).distinct().withColumn("event", F.lit(True))
    # fifty days: one window over all of them
    rows = days.join(other, "day", "left").select("day", "units", "event", offset.alias("offset"), F.avg("units").over(Window.orderBy("day").rowsBetween(-2, 0)).alias("mean3"))
    quiet = F.col("offset").between(-far, -near) & F.col("event").isNull()
    level = rows.agg(F.avg(F.when(quiet, F.col("units"))).alias("base"), F.count_if(quiet).alias("n"))
    hit = (F.col("offset") > -near) & (F.col("offset") < 0) & (F.col("mean3") >= F.col("base") * ratio) & (F.col("n") >= least_days) & (F.col("base") >= least_units)
    return rows.crossJoin(F.broadcast(level)).agg(F.max(F.when(hit, -F.col("offset"))).alias("lead_days"))


def boosted(forecast: DataFrame, actual: DataFrame, windows_: DataFrame, least: int = 5, most: float = 4.0) -> DataFrame:
    """raises a group's forecast in the weeks of a coming event by what the event did before.

    forecast: id, week, qty, naive.  actual: id, week, units.  windows_: event, week, part
    ('upcoming', 'past' or 'control').  The best of several events counts.
    """
    sums = actual.join(windows_.where(F.col("part") != "upcoming"), "week").groupBy("id", "event").agg(F.sum(F.when(F.col("part") == "past", F.col("units")).otherwise(0)).alias("past"), F.sum(F.when(F.col("part") == "control", F.col("units")).otherwise(0)).alias("control"))
    ratio = F.least(F.lit(most), F.col("past") / F.col("control"))
    sums = sums.where(F.col("control") >= least).select("id", "event", ratio.alias("ratio")).where("ratio > 1")
    best = sums.join(windows_.where("part = 'upcoming'").select("event", "week"), "event").groupBy("id", "week").agg(F.max("ratio").alias("ratio"))
    out = forecast.join(best, ["id", "week"], "left")
    return out.withColumn("qty", F.greatest(F.coalesce(F.bround(F.col("naive") * F.col("ratio"), 0), F.lit(0.0)), F.col("qty").cast("double"))).drop("ratio")
