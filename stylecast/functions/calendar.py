"""Column functions on dates: Monday weeks, report weeks (1-7, 8-15, 16-23, 24-end), seasons, axes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def monday(d: Column) -> Column:
    return F.date_trunc("week", d).cast("date")


def forecast_week_start(snap: Column, step: Column) -> Column:
    """The Monday of forecast week step (from 0), after the week of snap."""
    return F.date_add(monday(snap), (step + 1) * 7)


def chunk_index(d: Column) -> Column:
    day = F.dayofmonth(d)
    return F.when(day <= 7, 0).when(day <= 15, 1).when(day <= 23, 2).otherwise(3)


def _chunk_day(index: Column) -> Column:
    return F.when(index == 0, 1).when(index == 1, 8).when(index == 2, 16).otherwise(24)


def chunk_start(d: Column) -> Column:
    return F.make_date(F.year(d), F.month(d), _chunk_day(chunk_index(d)))


def chunk_end(d: Column) -> Column:
    i = chunk_index(d)
    return F.when(i == 3, F.last_day(d)).otherwise(F.make_date(F.year(d), F.month(d), F.when(i == 0, 7).when(i == 1, 15).otherwise(23)))


def chunk_ord(d: Column) -> Column:
    """A running number of the report week."""
    return (F.year(d) * 12 + F.month(d) - 1) * 4 + chunk_index(d)


def ord_start(o: Column) -> Column:
    ym = F.floor(o / 4).cast("int")
    return F.make_date(F.floor(ym / 12).cast("int"), (F.pmod(ym, F.lit(12)) + 1).cast("int"), _chunk_day(F.pmod(o, F.lit(4))))


def ord_end(o: Column) -> Column:
    return chunk_end(ord_start(o))


def ord_label(o: Column) -> Column:
    return F.concat(F.date_format(ord_start(o), "MMM"), F.lit(" W"), (F.pmod(o, F.lit(4)) + 1).cast("string"))


def season(d: Column) -> Column:
    m = F.month(d)
    return F.when(m.isin(11, 12, 1), "S1").when(m.isin(2, 3, 4), "S2").when(m.isin(5, 6, 7), "S3").otherwise("S4")


def season_year(d: Column) -> Column:
    """S1 belongs to the year of its November."""
    return F.year(d) - F.when(F.month(d) == 1, 1).otherwise(0)


def season_start(code: Column, year: Column) -> Column:
    return F.make_date(year, F.when(code == "S1", 11).when(code == "S2", 2).when(code == "S3", 5).otherwise(8), F.lit(1))


def season_end(code: Column, year: Column) -> Column:
    return F.date_sub(F.add_months(season_start(code, year), 3), 1)


def season_label(code: Column, year: Column) -> Column:
    return F.when(code == "S1", F.concat_ws("", F.lit("S1 "), year.cast("string"), F.lit("-"), F.substring((year + 1).cast("string"), 3, 2))).otherwise(F.concat_ws(" ", code, year.cast("string")))


def next_season(code: Column, year: Column) -> tuple[Column, Column]:
    return F.when(code == "S4", "S1").when(code == "S1", "S2").when(code == "S2", "S3").otherwise("S4"), year + F.when(code == "S1", 1).otherwise(0)


def week_features(week: Column) -> list[Column]:
    """Calendar features of a week's Monday."""
    flag = lambda c: c.cast("int")
    quarter = F.date_trunc("quarter", week).cast("date")
    return [
        F.weekofyear(week).alias("weekofyear"), F.month(week).alias("month"), F.quarter(week).alias("quarter"), F.year(week).alias("year"), F.dayofyear(week).alias("day_of_year"),
        flag(F.dayofmonth(week) == 1).alias("is_month_start"), flag(week == F.last_day(week)).alias("is_month_end"),
        flag(week == quarter).alias("is_quarter_start"), flag(F.date_add(week, 1) == F.add_months(quarter, 3)).alias("is_quarter_end"),
    ]


def week_axis(snap: DataFrame, start: date, today: date, weeks: int) -> DataFrame:
    """week, kind: Mondays from start's to today's ('past'), and those of the forecast after them ('forecast').

    snap: one row with the date snap, the latest order.
    """
    last = monday(F.lit(today))
    past = snap.select(F.explode(F.sequence(monday(F.lit(start)), last, F.expr("interval 7 days"))).alias("week"), F.lit("past").alias("kind"))
    return past.unionByName(forecast_weeks(snap, weeks).select("week", F.lit("forecast").alias("kind")).where(F.col("week") > last))


def forecast_weeks(snap: DataFrame, weeks: int) -> DataFrame:
    """week: the Mondays of a forecast that starts from the date snap of the one row."""
    return snap.where(F.col("snap").isNotNull()).select("snap", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))).alias("k")).select(forecast_week_start(F.col("snap"), F.col("k")).alias("week"))


def chunk_axis(span: DataFrame) -> DataFrame:
    """chunk_start, chunk_end of each report week from lo's month to hi's; span: one row of the dates lo and hi."""
    months = span.where(F.col("lo") <= F.col("hi")).select(F.explode(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("interval 1 month"))).alias("m"))
    starts = months.select(F.explode(F.array(*(F.date_add("m", k) for k in (0, 7, 15, 23)))).alias("chunk_start"))
    return starts.select("chunk_start", chunk_end(F.col("chunk_start")).alias("chunk_end"))


def week_status(axis: DataFrame, today: date) -> DataFrame:
    """Adds week_end (the day before the next start) and status; axis has week."""
    last = Window.orderBy("week")  # an axis of weeks: a few hundred rows
    end = F.date_sub(F.coalesce(F.lead("week").over(last), F.date_add("week", 7)), 1)
    out = axis.withColumn("week_end", end)
    return out.withColumn("status", F.when(F.col("week_end") < F.lit(today), "completed").when(F.col("week") <= F.lit(today), "running").otherwise("upcoming"))


def snapshot_date(df: DataFrame, today: date, date_col: str = "order_date", sku_col: str = "product_sku_code") -> DataFrame:
    """One row: the latest order date up to today, over rows with a SKU, and the month before."""
    snap = F.max(F.when(F.col(date_col) <= F.lit(today), F.col(date_col))).alias("snap")
    return df.where(F.col(sku_col).isNotNull()).agg(snap).withColumn("last_month", F.date_format(F.add_months("snap", -1), "yyyy-MM"))
