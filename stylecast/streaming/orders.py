"""Order streams: dedup within the settling time, weekly and daily units, the running week.

What a stream gives is kept as tables in a folder that driver and executors share; nothing
goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

#: How long late orders may still arrive.
SETTLE = "14 days"


def deduplicated(lines: DataFrame, id_cols: list[str], ts: str = "ts", settle: str = SETTLE) -> DataFrame:
    """The first line of each id within the settling time; on a batch, of all."""
    if not lines.isStreaming:
        return lines.dropDuplicates(id_cols)
    return lines.withWatermark(ts, settle).dropDuplicatesWithinWatermark(id_cols)


def units(lines: DataFrame, ts: str = "ts", qty: str = "qty", amount: str = "amount", days: int = 7, settle: str = SETTLE) -> DataFrame:
    """Start, n_orders, units, amount of each Monday week (or day); a week is final after the settling time."""
    # windows are aligned to the epoch, a Thursday: four days on is a Monday
    window = F.window(ts, f"{days} days", f"{days} days", "4 days") if days == 7 else F.window(ts, f"{days} days")
    rows = lines.withWatermark(ts, settle) if lines.isStreaming else lines
    out = rows.groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("n_orders"), F.sum(qty).alias("units"), F.sum(amount).alias("amount"))
    return out.select(F.col("w.start").cast("date").alias("start"), "n_orders", "units", "amount")


def units_by_day(lines: DataFrame, id_col: str = "id", ts: str = "ts", qty: str = "qty", settle: str = SETTLE) -> DataFrame:
    """Id, day, qty; a day is final after the settling time."""
    rows = lines.withWatermark(ts, settle) if lines.isStreaming else lines
    return rows.groupBy(id_col, F.window(ts, "1 day").alias("w")).agg(F.sum(qty).alias("qty")).select(F.col(id_col).alias("id"), F.col("w.start").cast("date").alias("day"), "qty")


def save_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Writes what a micro-batch changed as a folder of its own; a batch that is run again replaces its folder."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def saved(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """The rows that save_batch has kept, the latest one of each key; the batch folder tells which that is."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    values = [c for c in schema.names if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return latest.select(*keys, *(f"v.{c}" for c in values))


def started(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a stream that keeps its changed rows under path, up to the end of its present input."""
    return df.writeStream.foreachBatch(lambda batch, k: save_batch(batch, k, path)).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_week(actual: DataFrame, forecast: DataFrame, today: date) -> DataFrame:
    """The running week: actual so far plus the pace of the last seven days for the days left, beside its forecast.

    actual: id, day, qty.  forecast: id, qty.
    """
    left = 6 - today.weekday()
    monday = F.date_sub(F.lit(today), today.weekday())
    so_far = F.sum(F.when(F.col("day").between(monday, F.lit(today)), F.col("qty")).otherwise(0))
    pace = F.sum(F.when(F.col("day").between(F.date_sub(F.lit(today), 6), F.lit(today)), F.col("qty")).otherwise(0)) / 7
    out = actual.groupBy("id").agg(so_far.alias("so_far"), pace.alias("pace"))
    return out.join(forecast.select("id", F.col("qty").alias("forecast")), "id", "left").select("id", "so_far", "pace", (F.col("so_far") + F.col("pace") * left).alias("expected"), "forecast")


def each_batch(forecast: DataFrame, today: date, path: str, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for the changed rows of units_by_day.

    It keeps them under path and gives the sink the running week of all days kept so far,
    so that its figures hold over any number of micro-batches.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        save_batch(batch, batch_id, path)
        sink(running_week(saved(batch.sparkSession, path, batch.schema, ["id", "day"]), forecast, today), batch_id)

    return run
