"""Reports: filters, paging, report-week cells, totals, views of frozen forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def searched(rows: DataFrame, text: str = "", category: str = "", sub_category: str = "", key: str = "style") -> DataFrame:
    """Rows whose key contains the text in any case, of a category and sub-category; blank is any."""
    if text:
        rows = rows.where(F.lower(key).contains(text.lower()))
    for column, value in (("category", category), ("sub_category", sub_category)):
        if value:
            rows = rows.where(F.col(column) == value)
    return rows


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def style_filter(rows: DataFrame, styles: DataFrame, key: str = "style", **wanted: str) -> DataFrame:
    """Rows of the styles whose columns have the wanted values; a blank value is any."""
    kept = styles
    for column, value in wanted.items():
        if value:
            kept = kept.where(F.upper(F.trim(F.col(column))) == value.strip().upper())
    kept = kept.select(F.upper(F.trim("style")).alias("_style")).distinct()
    return rows.join(kept, F.upper(F.trim(rows[key])) == kept["_style"], "left_semi")


def rebucketed(weekly: DataFrame, key: str = "id") -> DataFrame:
    """Monday weeks as report weeks: a seventh a day, summed, rounded: id, chunk_start, qty.  weekly: id, week, qty."""
    from ..functions.calendar import chunk_start

    days = weekly.withColumn("day", F.explode(F.sequence("week", F.date_add("week", 6))))
    out = days.groupBy(key, chunk_start(F.col("day")).alias("chunk_start")).agg(F.sum(F.col("qty") / 7).alias("q"))
    return out.select(key, "chunk_start", F.bround(F.bround("q", 6), 0).cast("long").alias("qty"))


def cells(actual: DataFrame, forecast: DataFrame, today, key: str = "id") -> DataFrame:
    """One row a cell: id, chunk_start, chunk_end, actual, forecast, state (completed, running, upcoming).

    actual: id, chunk_start, units.  forecast: id, chunk_start, qty.
    """
    from ..functions.calendar import chunk_end

    rows = actual.join(forecast, [key, "chunk_start"], "full").withColumn("chunk_end", chunk_end(F.col("chunk_start")))
    state = F.when(F.col("chunk_end") < F.lit(today), "completed").when(F.col("chunk_start") <= F.lit(today), "running").otherwise("upcoming")
    return rows.select(key, "chunk_start", "chunk_end", F.coalesce("units", F.lit(0)).alias("actual"), F.coalesce("qty", F.lit(0)).alias("forecast"), state.alias("state"))


def totals(cells_: DataFrame, key: str = "id") -> DataFrame:
    """Sums by month and id, by month, by id, and in all; TOTAL stands for all of a side."""
    rows = cells_.withColumn("month", F.date_format("chunk_start", "yyyy-MM"))
    out = rows.groupingSets([[F.col(key), F.col("month")], [F.col("month")], [F.col(key)], []], key, "month").agg(F.sum("actual").alias("actual"), F.sum("forecast").alias("forecast"))
    return out.fillna("TOTAL", [key, "month"])


def accuracy(actual, forecast, finished):
    """1 - |a - f| / a, held between 0 and 1; only for finished periods with sales."""
    return F.when(finished & (actual > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(actual - forecast) / actual)))


def frozen_view(cells_: DataFrame, frozen: DataFrame, key: str = "id") -> DataFrame:
    """Forecasts replaced by frozen ones; without one, 0 and a flag unless the period is completed.  frozen: id, chunk_start, frozen."""
    rows = cells_.join(frozen, [key, "chunk_start"], "left")
    done = F.col("state") == "completed"
    return rows.withColumn("not_frozen", F.col("frozen").isNull() & ~done).withColumn("forecast", F.when(F.col("frozen").isNotNull(), F.col("frozen")).when(done, F.col("forecast")).otherwise(0)).drop("frozen")


def wide(cells_: DataFrame, value: str, columns: list[str], key: str = "id") -> DataFrame:
    """One row an id, a column a period (given as dates in text), for export."""
    rows = cells_.withColumn("_p", F.date_format("chunk_start", "yyyy-MM-dd"))
    return rows.groupBy(key).pivot("_p", columns).agg(F.sum(value)).fillna(0)


def _ahead(c, today):
    """Report weeks from the running one."""
    from ..functions.calendar import chunk_ord

    return chunk_ord(c) - chunk_ord(F.lit(today))


def expected_sale(cells_: DataFrame, today, weeks: int = 9, key: str = "id") -> DataFrame:
    """Id, expected (the forecast of the running report week and those after it), sold_so_far (in the running week)."""
    ahead = _ahead(F.col("chunk_start"), today)
    rows = cells_.where(ahead.between(0, weeks - 1))
    return rows.groupBy(key).agg(F.sum("forecast").alias("expected"), F.sum(F.when(ahead == 0, F.col("actual")).otherwise(0)).alias("sold_so_far"))


def forecast_table(cells_: DataFrame, today, weeks: int = 13, past_weeks: int = 0, key: str = "id") -> DataFrame:
    """Forecasts of the running and coming report weeks (and some past ones) by id and week, id and month, id, week, month, and in all.

    TOTAL stands for all of a side; chunk_start is null on sums over weeks.  Frozen forecasts are given as the cells' forecast.
    """
    rows = cells_.where(_ahead(F.col("chunk_start"), today).between(-past_weeks, weeks - 1)).withColumn("month", F.date_format("chunk_start", "yyyy-MM"))
    k, m, c = F.col(key), F.col("month"), F.col("chunk_start")
    out = rows.groupingSets([[k, m, c], [k, m], [k], [m, c], [m], []], key, "month", "chunk_start").agg(F.sum("forecast").alias("forecast"))
    return out.fillna("TOTAL", [key, "month"])


def tier_forecast(cells_: DataFrame, actual: DataFrame, tiers: DataFrame, today, months: int = 3, weeks: int = 13, past_weeks: int = 4) -> DataFrame:
    """Month, tier, styles, units, prev_units, prev_is_forecast, change_pct: the running month and those after it by current tier.

    The first month is held against the actual units of the month before, later ones against the forecast before.
    actual: style, month, qty.  tiers: style, tier.
    """
    first = F.trunc(F.lit(today), "month")
    month = F.trunc("chunk_start", "month")
    near = cells_.where(_ahead(F.col("chunk_start"), today).between(-past_weeks, weeks - 1) & (month >= first) & (month < F.add_months(first, months)))
    by_style = near.groupBy(F.col("id").alias("style"), month.alias("m")).agg(F.sum("forecast").alias("units")).where("units > 0")
    tier = F.coalesce("tier", F.lit("Unclassified"))
    units = by_style.join(tiers, "style", "left").groupBy("m", tier.alias("tier")).agg(F.count(F.lit(1)).alias("styles"), F.sum("units").alias("units"))
    sold = actual.where(F.col("month") == F.date_format(F.add_months(first, -1), "yyyy-MM")).groupBy("style").agg(F.sum("qty").alias("units"))
    sold = sold.join(tiers, "style", "left").groupBy(tier.alias("tier")).agg(F.sum("units").alias("prev_units")).withColumn("m", first)
    before = units.select("tier", F.col("units").alias("prev_units"), F.add_months("m", 1).alias("m")).unionByName(sold)
    grid = units.select("tier").distinct().select("tier", F.explode(F.array(*(F.add_months(first, k) for k in range(months)))).alias("m"))
    rows = grid.join(units, ["m", "tier"], "left").join(before, ["m", "tier"], "left").fillna(0, ["styles", "units", "prev_units"])
    change = F.when(F.col("prev_units") > 0, F.bround((F.col("units") - F.col("prev_units")) / F.col("prev_units") * 100, 1))
    return rows.select(F.date_format("m", "yyyy-MM").alias("month"), "tier", "styles", "units", "prev_units", (F.col("m") > first).alias("prev_is_forecast"), change.alias("change_pct"))
