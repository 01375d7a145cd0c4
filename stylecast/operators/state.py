"""Saved state as tables: a step takes the old state and new values and gives the new state.

Each step is one full outer join; applied twice with the same values it changes nothing.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window, functions as F

FREEZE_DAYS, SETTLE_DAYS, KEEP_WEEKS = 92, 14, 8
FROZEN = "key string, start date, qty double, status string, updated_on date, start_qty double"


def freeze(state: DataFrame, values: DataFrame, periods: DataFrame, today: date) -> DataFrame:
    """Key, start, qty, status (open, locked), updated_on, start_qty.

    An open period that has ended locks at its last open value; one first seen after its end
    locks at today's.  A locked one that hasn't ended opens again.  When a period has
    started, the value saved before its start is kept as start_qty.
    state: as the result.  values: key, start, qty.  periods: start, end.
    """
    now = F.lit(today)
    old = state.select("key", "start", F.col("qty").alias("o_qty"), F.col("status").alias("o_status"), F.col("updated_on").alias("o_on"), "start_qty")
    rows = old.join(values.select("key", "start", F.col("qty").alias("n_qty")), ["key", "start"], "full").join(periods, "start", "left")
    known, given = F.col("o_status").isNotNull(), F.col("n_qty").isNotNull()
    over = F.coalesce(F.col("end") < now, F.lit(False))
    begun = given & (F.col("start") <= now) & F.col("start_qty").isNull() & known & (F.col("o_on") < F.col("start"))
    reopened = known & (F.col("o_status") == "locked") & ~over & F.col("end").isNotNull()
    qty = F.when(~given, F.col("o_qty")).when(~known, F.col("n_qty")).when(over, F.col("o_qty")).otherwise(F.col("n_qty"))
    status = F.when(reopened, "open").when(given & over, "locked").when(known & ~given, F.col("o_status")).otherwise("open")
    status = F.when(known & (F.col("o_status") == "locked") & ~reopened, "locked").otherwise(status)
    changed = ~known | reopened | (given & (F.col("o_status") == "open") & (over | (F.col("o_qty") != F.col("n_qty"))))
    return rows.select("key", "start", qty.cast("double").alias("qty"), status.alias("status"), F.when(changed, now).otherwise(F.col("o_on")).alias("updated_on"), F.when(begun, F.col("o_qty")).otherwise(F.col("start_qty")).alias("start_qty"))


def rolling_snapshot(state: DataFrame, values: DataFrame, first: date, today: date, days: int = FREEZE_DAYS) -> DataFrame:
    """Adds today's value of running and coming periods that have none yet: key, as_of, start, qty."""
    new = values.where((F.col("start") >= F.lit(first)) & (F.col("start") < F.date_add(F.lit(today), days)))
    new = new.join(state.select("key", "start").distinct(), ["key", "start"], "left_anti")
    return state.unionByName(new.select("key", F.lit(today).alias("as_of"), "start", F.col("qty").cast("double").alias("qty")))


def frozen_values(snapshots: DataFrame, as_of: date) -> DataFrame:
    """Key, start, qty, since: the newest snapshot up to a day."""
    return snapshots.where(F.col("as_of") <= F.lit(as_of)).groupBy("key", "start").agg(F.max_by("qty", "as_of").alias("qty"), F.max("as_of").alias("since"))


def refrozen(snapshots: DataFrame, start: date) -> DataFrame:
    """Forgets snapshots of periods from a day on."""
    return snapshots.where(F.col("start") < F.lit(start))


def locked_as_snapshots(snapshots: DataFrame, state: DataFrame, before: date, as_of: date) -> DataFrame:
    """Adds locked values of periods before a day that have no snapshot."""
    new = state.where((F.col("status") == "locked") & (F.col("start") < F.lit(before))).join(snapshots.select("key", "start").distinct(), ["key", "start"], "left_anti")
    return snapshots.unionByName(new.select("key", F.lit(as_of).alias("as_of"), "start", "qty"))


def fallback(snapshot: DataFrame, start: DataFrame, log: DataFrame, locked: DataFrame) -> DataFrame:
    """Key, start, qty: snapshot, else start value, else log, else locked; each has key, start, qty."""
    out = None
    for k, df in enumerate((snapshot, start, log, locked)):
        part = df.select("key", "start", F.col("qty").alias(f"q{k}"))
        out = part if out is None else out.join(part, ["key", "start"], "full")
    return out.select("key", "start", F.coalesce("q0", "q1", "q2", "q3").alias("qty"))


def log_running(log: DataFrame, rows: DataFrame, today: date) -> DataFrame:
    """The running week's rows: new ones are added, open ones get stock and suggestion anew; the forecast at the week's start stays.

    log, and the result: style, week_start, week_end, forecast, available, suggestion, status, captured_on, updated_on, actual.
    rows: style, week_start, week_end, forecast, available, suggestion.
    """
    new = rows.select("style", "week_start", *(F.col(c).alias(f"n_{c}") for c in ("week_end", "forecast", "available", "suggestion")))
    j = log.join(new, ["style", "week_start"], "full")
    fresh, update = F.col("status").isNull(), F.col("n_week_end").isNotNull() & (F.col("status") == "open")
    pick = lambda c: F.when(fresh | update, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    return j.select(
        "style", "week_start", F.coalesce("week_end", "n_week_end").alias("week_end"), F.coalesce("forecast", "n_forecast").alias("forecast"), pick("available"), pick("suggestion"),
        F.coalesce("status", F.lit("open")).alias("status"), F.coalesce("captured_on", F.lit(today)).alias("captured_on"), F.when(fresh | update, F.lit(today)).otherwise(F.col("updated_on")).alias("updated_on"), "actual",
    )


def log_settled(log: DataFrame, actual: DataFrame, data_through: date, settle: int = SETTLE_DAYS) -> DataFrame:
    """Finished weeks get their actual sale; after the settling time they are completed.  Styles that sold but weren't logged are added with zeros.  actual: style, week_start, units."""
    through = F.lit(data_through)
    due = ((F.col("status") == "open") & (F.col("week_end") <= through)) | (F.col("status") == "settling") | ((F.col("status") == "completed") & (F.col("week_end") > F.date_sub(through, settle)))
    weeks = log.where(due).groupBy("week_start").agg(F.max("week_end").alias("week_end_"))
    missing = actual.where("units <> 0").join(weeks, "week_start").join(log.select("style", "week_start"), ["style", "week_start"], "left_anti")
    zero = F.lit(0).cast("long")
    missing = missing.select("style", "week_start", F.col("week_end_").alias("week_end"), zero.alias("forecast"), zero.alias("available"), zero.alias("suggestion"), F.lit("open").alias("status"), through.alias("captured_on"), through.alias("updated_on"), F.lit(None).cast("long").alias("actual"))
    rows = log.select(*missing.columns).unionByName(missing).join(weeks, "week_start", "left").join(actual, ["style", "week_start"], "left")
    mine = F.col("week_end_").isNotNull()
    status = F.when(F.date_add("week_end_", settle) <= through, "completed").otherwise("settling")
    return rows.withColumn("actual", F.when(mine, F.coalesce("units", zero)).otherwise(F.col("actual"))).withColumn("status", F.when(mine, status).otherwise(F.col("status"))).drop("week_end_", "units")


def log_kept(log: DataFrame, weeks: int = KEEP_WEEKS) -> DataFrame:
    """Open rows and those of the latest finished weeks."""
    done = log.where("status <> 'open'").select("week_start").distinct()
    keep = done.withColumn("r", F.row_number().over(Window.orderBy(F.desc("week_start")))).where(F.col("r") <= weeks).select("week_start")  # weeks: a few rows
    return log.where("status = 'open'").unionByName(log.where("status <> 'open'").join(F.broadcast(keep), "week_start", "left_semi").select(log.columns))


def log_totals(log: DataFrame) -> DataFrame:
    """By week: styles, forecast, available, suggestion, actual."""
    return log.groupBy("week_start", "status").agg(F.count(F.lit(1)).alias("styles"), *(F.sum(c).alias(c) for c in ("forecast", "available", "suggestion", "actual")))


def held(state: DataFrame, values: DataFrame) -> DataFrame:
    """Id, week, qty: the value that was held first stays; both: id, week, qty."""
    rows = state.withColumnRenamed("qty", "h").join(values.withColumnRenamed("qty", "v"), ["id", "week"], "full")
    return rows.select("id", "week", F.coalesce("h", "v").alias("qty"))


def latest_snapshot(snapshots: DataFrame, on: date, version: int) -> DataFrame:
    """The latest snapshot up to a day; of one day, the current version, else the highest.  snapshots: version, snapshot."""
    rows = snapshots.select("version", "snapshot").distinct().where(F.col("snapshot") <= F.lit(on))
    return rows.orderBy(F.desc("snapshot"), F.desc(F.col("version") == version), F.desc("version")).limit(1)


def aligned(forecast: DataFrame, snapshot: date, now: date, max_age: int = 28) -> DataFrame:
    """A saved forecast (id, step, qty) as of now: past weeks dropped, steps shifted; empty if too old."""
    shift = (now - snapshot).days
    weeks = (date.fromordinal(now.toordinal() - now.weekday()) - date.fromordinal(snapshot.toordinal() - snapshot.weekday())).days // 7
    return forecast.where(F.lit(0 <= shift <= max_age) & (F.col("step") >= weeks)).withColumn("step", (F.col("step") - weeks).cast("int"))
