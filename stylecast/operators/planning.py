"""The plan: run-rate, blend, horizons, stock cover, lifecycle."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT, STAGES, Config
from .panel import percentile_rank


def clean_days(daily: DataFrame, event_days: DataFrame, snap: date, cfg: Config = DEFAULT) -> DataFrame:
    """Days of the run-rate window and whether each counts: day, units, clean.

    Event days and unlisted spikes (over twice the weekday's median of quiet days) don't
    count, unless too few would be left.  daily: day, units; at most cfg.runrate_days rows.
    """
    first = snap - timedelta(days=cfg.runrate_days - 1)
    days = daily.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(snap))).alias("day")).join(daily, "day", "left").fillna(0, ["units"])
    rows = days.join(event_days.select("day").distinct().withColumn("event", F.lit(True)), "day", "left").withColumn("dow", F.dayofweek("day"))
    quiet = rows.where(F.col("event").isNull())
    medians = quiet.groupBy("dow").agg(F.expr("percentile(units, 0.5)").alias("weekday"))
    overall = quiet.agg(F.expr("percentile(units, 0.5)").alias("overall"), F.count(F.lit(1)).alias("n_quiet"))
    rows = rows.join(medians, "dow", "left").crossJoin(F.broadcast(overall))
    normal = F.greatest(F.lit(1.0), F.coalesce("weekday", "overall"))
    ok = F.col("event").isNull() & (F.col("units") <= normal * cfg.runrate_spike)
    marked = rows.select("day", "units", F.when(F.col("n_quiet") == 0, True).otherwise(ok).alias("ok"))
    enough = marked.agg((F.count_if("ok") >= cfg.runrate_min_clean).alias("enough"))
    return marked.crossJoin(F.broadcast(enough)).select("day", "units", (F.col("ok") | ~F.col("enough")).alias("clean"))


def run_rate(gross: DataFrame, days: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Q1: id, weekly: units of the clean days, times seven by their number.  gross: id, day, qty."""
    ok = days.where("clean")
    n = ok.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    sums = gross.join(F.broadcast(ok.select("day")), "day").groupBy("id").agg(F.sum("qty").alias("units"))
    return sums.crossJoin(F.broadcast(n)).select("id", (F.col("units") * 7 / F.col("n")).alias("weekly"))


def blended(model: Column, naive: Column, factor: Column, alpha: float = DEFAULT.blend, both: bool = False) -> Column:
    """Q2: the published value of a week: model and naive blended; the naive one alone where there is no model."""
    mixed = (alpha * model + (1 - alpha) * naive) * factor if both else alpha * model + (1 - alpha) * naive * factor
    return F.greatest(F.lit(0.0), F.when(model.isNull(), naive * factor).otherwise(mixed))


def horizons(forecast: DataFrame) -> DataFrame:
    """Q3: id, forecast7, forecast10, forecast35.  forecast: id, step (from 0), qty."""
    at = lambda k: F.sum(F.when(F.col("step") == k, F.col("qty")).otherwise(0.0))
    five = F.sum(F.when(F.col("step") < 5, F.bround("qty", 0)).otherwise(0.0))
    return forecast.groupBy("id").agg(F.bround(at(0), 0).cast("long").alias("forecast7"), F.bround(at(0) + at(1) * 3 / 7, 0).cast("long").alias("forecast10"), five.cast("long").alias("forecast35"))


def by_design(parts: DataFrame) -> DataFrame:
    """Q5: id, step, qty: the sum of each design's SKUs.  parts: id, step, qty.

    Sums are freed of the last digits, which depend on the order of the summands: a sum of
    exactly a half is then rounded as one, in whatever order it came about.
    """
    return parts.groupBy("id", "step").agg(F.bround(F.sum("qty"), 6).alias("qty"))


def preferred(own: DataFrame, parts: DataFrame) -> DataFrame:
    """Q4: the design's own series where there is one, else the sum of its SKUs.  own: id, step, qty; parts: id, sku, step, qty."""
    summed = parts.join(own.select("id").distinct(), "id", "left_anti").groupBy("id", "step").agg(F.sum("qty").alias("qty"))
    return own.select("id", "step", "qty").unionByName(summed)


def available(lines: DataFrame) -> DataFrame:
    """Q6: id, inventory, wip, available: the largest of each SKU's lines, rounded.  lines: id, stock, wip."""
    out = lines.groupBy("id").agg(F.bround(F.coalesce(F.max("stock"), F.lit(0.0)), 0).cast("long").alias("inventory"), F.bround(F.coalesce(F.max("wip"), F.lit(0.0)), 0).cast("long").alias("wip"))
    return out.withColumn("available", F.col("inventory") + F.col("wip"))


def cover(forecast: DataFrame, weekly: DataFrame, snap: date, leads: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Q7: id, sigma, safety, p50, p80 over the lead time.

    The deviation is that of the complete weeks with sales among the last cfg.hist_weeks;
    weeks without sales are not filled.  weekly: id, week, y.
    """
    monday = snap - timedelta(days=snap.weekday())
    last = monday if snap.weekday() == 6 else monday - timedelta(weeks=1)
    recent = weekly.where(F.col("week").between(F.lit(last - timedelta(weeks=cfg.hist_weeks - 1)), F.lit(last)))
    sigma = recent.groupBy("id").agg(F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("sigma"))
    rows = forecast if leads is None else forecast.join(leads, "id", "left")
    lead = F.lit(float(cfg.lead_days)) if leads is None else F.coalesce("lead_days", F.lit(float(cfg.lead_days)))
    weeks = F.greatest(F.lit(1), F.least(F.lit(cfg.horizon), F.ceil(lead / 7))).cast("int")
    sums = rows.withColumn("_lead", lead).withColumn("_weeks", weeks).groupBy("id", "_lead", "_weeks").agg(F.sum(F.when(F.col("step") < F.col("_weeks"), F.col("qty")).otherwise(0.0)).alias("_sum"))
    out = sums.join(sigma, "id", "left").fillna(0.0, ["sigma"])
    p50 = F.greatest(F.lit(0), F.bround("_sum", 0)).cast("long")
    out = out.withColumn("p50", p50)
    p80 = F.greatest(F.col("p50"), F.bround(F.col("p50") + cfg.p80_z * F.col("sigma") * F.sqrt("_weeks"), 0).cast("long"))
    safety = F.greatest(F.lit(0), F.bround(cfg.service_z * F.col("sigma") * F.sqrt(F.col("_lead") / 7), 0)).cast("long")
    return out.select("id", "sigma", safety.alias("safety"), "p50", p80.alias("p80"))


def replenishment(plan: DataFrame) -> DataFrame:
    """Q8: adds target, produce and stock_status; plan has p80 and available."""
    return plan.withColumns({"target": F.col("p80"), "produce": F.greatest(F.lit(0), F.col("p80") - F.col("available")), "stock_status": F.when(F.col("available") >= F.col("p80"), "In Stock").otherwise("Needs Production")})


def lifecycle_figures(ids: DataFrame, net: DataFrame, returns: DataFrame, launches: DataFrame, snap: date, cfg: Config = DEFAULT) -> DataFrame:
    """Q9: windows, rates, growth, return rate, turnover, overstock, stockout of each id.

    ids: id, forecast35, available.  net, returns: id, day, qty.  launches: id, launch.
    """
    age_of = F.datediff(F.lit(snap), "day")
    rows = net.join(launches, "id", "left")
    since = F.datediff("day", "launch")
    win = lambda lo, hi: F.sum(F.when((age_of >= lo) & (age_of < hi), F.col("qty")).otherwise(0))
    sums = rows.groupBy("id").agg(win(0, 30).alias("t30"), win(0, cfg.dead_days).alias("t60"), win(30, 60).alias("prior"), win(60, 90).alias("older"), F.sum(F.when((since >= 0) & (since < cfg.launch_window), F.col("qty")).otherwise(0)).alias("lwin"))
    back = returns.groupBy("id").agg(F.sum(F.when((age_of >= 0) & (age_of < 30), F.abs("qty")).otherwise(0)).alias("ret30"))
    out = ids.join(sums, "id", "left").join(back, "id", "left").join(launches, "id", "left").fillna(0, ["t30", "t60", "prior", "older", "lwin", "ret30"])
    out = out.withColumn("age", F.datediff(F.lit(snap), "launch")).withColumn("current", F.col("t30") / 30.0)
    days = F.least(F.col("age"), F.lit(cfg.launch_window))
    out = out.withColumn("at_launch", F.coalesce(F.when(days > 0, F.col("lwin") / days), F.col("current")))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    stock, need = F.greatest(F.col("available"), F.lit(1)), F.greatest(F.col("forecast35"), F.lit(1))
    return out.withColumns({
        "growth": (F.col("current") - F.col("at_launch")) / F.greatest(F.col("at_launch"), F.lit(1e-6)), "return_rate": clip(F.col("ret30") / F.greatest(F.col("t30") + F.col("ret30"), F.lit(1e-6))),
        "turnover": clip(F.col("t30") / stock), "overstock": clip((F.col("available") - F.col("forecast35")) / need), "stockout": clip((F.col("forecast35") - F.col("available")) / need),
    })


def velocity_cuts(figures: DataFrame, column: str, cfg: Config = DEFAULT) -> DataFrame:
    """One row: the tier cuts of a rate over ids that sell, and its median."""
    at = ", ".join(str(x) for x in (*cfg.tier_cuts, 0.5))
    return figures.where(F.col(column) > 0).agg(F.coalesce(F.expr(f"percentile({column}, array({at}))"), F.array(*[F.lit(0.0)] * 4)).alias("p")).select(*(F.get("p", F.lit(k)).alias(f"cut{k}") for k in range(3)), F.get("p", F.lit(3)).alias("median"))


def with_stage(figures: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Q10: adds stage, by the first rule that holds."""
    median = velocity_cuts(figures, "current", cfg).select(F.col("median").alias("_median"))
    g = F.col("growth")
    stage = F.when(F.col("age") <= cfg.launch_window, "Emerging").when(F.col("t60") <= 0, "Dead").when((F.col("older") > 0) & (F.col("prior") <= 0) & (F.col("t30") > 0), "Reviving")
    stage = stage.when(g <= cfg.decline, "Declining").when((g >= cfg.winner) & (F.col("current") >= F.col("_median")), "Emerging").when(g >= cfg.grow, "Growing").otherwise("Stable")
    return figures.crossJoin(F.broadcast(median)).withColumn("stage", stage).drop("_median")


def with_tiers(figures: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Q11: adds launch_tier and current_tier, T0 to T3."""
    for column, prefix in (("current", "Current"), ("at_launch", "Launch")):
        cuts = velocity_cuts(figures, column, cfg).drop("median")
        n = sum(((F.col(column) >= F.col(f"cut{k}")).cast("int") for k in range(3)), F.lit(0))
        label = F.when(F.col(column) <= 0, f"{prefix}_T0").otherwise(F.concat(F.lit(f"{prefix}_T"), n.cast("string")))
        figures = figures.crossJoin(F.broadcast(cuts)).withColumn(f"{prefix.lower()}_tier", label).drop("cut0", "cut1", "cut2")
    return figures.withColumn("launch_tier", F.when(F.col("age").isNull(), "Unknown").otherwise(F.col("launch_tier")))


def with_scores(staged: DataFrame) -> DataFrame:
    """Q12: adds health, risk, priority and the stage's suggestion."""
    spark = staged.sparkSession
    parts = spark.createDataFrame([(k, *v) for k, v in STAGES.items()], "stage string, factor double, h double, r double, p double")
    rows = staged.join(F.broadcast(parts), "stage").withColumn("_g", F.greatest(F.lit(-1.0), F.least(F.lit(5.0), F.col("growth"))))
    rows = percentile_rank(rows, vel="current", grow="_g")
    whole = lambda c: F.bround(F.bround(100 * c, 6), 0).cast("int")
    health = 0.35 * F.col("vel") + 0.20 * F.col("grow") + 0.15 * F.col("turnover") + 0.10 * (1 - F.col("return_rate")) + 0.20 * F.col("h")
    risk = 0.45 * F.col("r") + 0.30 * F.col("overstock") + 0.25 * F.col("return_rate")
    priority = 0.45 * F.col("p") + 0.30 * F.col("vel") + 0.25 * F.col("stockout")
    make = F.greatest(F.lit(0), F.bround(F.col("forecast35") * F.col("factor"), 0) - F.col("available")).cast("long")
    return rows.withColumns({"health": whole(health), "risk": whole(risk), "priority": whole(priority), "suggested": make}).drop("_g", "vel", "grow", "factor", "h", "r", "p")


def naive_forecast(rates: DataFrame, factors: DataFrame) -> DataFrame:
    """The forecast without a model: id, step, week, qty.  rates: id, weekly; factors: step, week, factor (a row a week of the horizon)."""
    return rates.crossJoin(F.broadcast(factors)).select("id", "step", "week", blended(F.lit(None).cast("double"), F.col("weekly"), F.col("factor")).alias("qty"))


def share_shift(rows: DataFrame, keys: list[str], block: str, qty: str) -> DataFrame:
    """Each value's share of its block's total."""
    total = F.sum(F.sum(qty)).over(Window.partitionBy(block))
    return rows.groupBy(*keys, block).agg((F.sum(qty) / total).alias("share"), F.sum(qty).alias("units"))
