"""Saved tables: offline CSV snapshots, forecast snapshots and daily stock, partitioned, replaced by partition."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F


def _write(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def csv_snapshot(spark: SparkSession, path: str, schema: str, columns: tuple[str, ...]) -> DataFrame:
    """An offline snapshot in CSV with a header; only the columns named are parsed, dates as ISO."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=False, mode="FAILFAST", enforceSchema=False).select(*columns)


def save_forecast(forecast: DataFrame, path: str, level: str, version: int, snapshot: date) -> None:
    """Saves id, step, qty of one level, version and day; the same again replaces it."""
    _write(forecast.select("id", "step", "qty", F.lit(level).alias("level"), F.lit(version).alias("version"), F.lit(snapshot).alias("snapshot")), path, "level", "version", "snapshot")


def load_forecast(spark: SparkSession, path: str, level: str, version: int, snapshot: date) -> DataFrame:
    """Reads only the partition of one level, version and day."""
    return spark.read.parquet(path).where((F.col("level") == level) & (F.col("version") == version) & (F.col("snapshot") == F.lit(snapshot))).select("id", "step", "qty")


def save_stock(stock: DataFrame, path: str, day: date, complete: bool = True) -> bool:
    """Saves sku, style, stock, wip of a day, replacing it; nothing is saved where a feed failed."""
    if complete:
        _write(stock.select("sku", "style", "stock", "wip", F.lit(day).alias("day")), path, "day")
    return complete


def load_stock(spark: SparkSession, path: str, style: str = "", sku: str = "") -> DataFrame:
    rows = spark.read.parquet(path)
    for column, value in (("style", style), ("sku", sku)):
        if value:
            rows = rows.where(F.col(column) == value)
    return rows


def stock_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("day").distinct()
