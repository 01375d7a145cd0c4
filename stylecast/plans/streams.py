"""Queries: order streams, run to the end of their input."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..registry import query
from ..sources.shared import new_path
from ..streaming import orders as stream


def _lines(df):
    return df.where("event_type = 'purchase'").select("event_id", "ts", "user_id", F.lit(1).alias("qty"), F.col("value").cast("decimal(18,4)").alias("amount"))


def _latest(spark, df, keys):
    """The rows of a stream over finite input, the latest one of each key, through a table in the shared folder."""
    path = new_path(spark, "stream")
    stream.started(df, f"{path}/rows", f"{path}/state").awaitTermination()
    return stream.saved(spark, f"{path}/rows", df.schema, keys)


def _stream(spark, sf):
    # a stream reads a folder; the filter names the table's file or folder in it
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))


@query("x1_dedup_within_watermark", "SELECT count(*) AS n_orders, count(DISTINCT user_id) AS n_users FROM events WHERE event_type = 'purchase'")
def x1(spark, sf):
    rows = stream.deduplicated(_lines(_stream(spark, sf)), ["event_id"])
    path = new_path(spark, "stream")
    kept = rows.select("event_id", "user_id")
    kept.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{path}/rows").agg(F.count(F.lit(1)).alias("n_orders"), F.countDistinct("user_id").alias("n_users"))


@query("x2_weekly_units", "SELECT CAST(date_trunc('week', ts) AS DATE) AS start, count(*) AS n_orders, count(*) AS units, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS amount FROM events WHERE event_type = 'purchase' GROUP BY 1")
def x2(spark, sf):
    return _latest(spark, stream.units(_lines(_stream(spark, sf))), ["start"]).withColumn("amount", F.col("amount").cast("double"))


@query("x2_daily_units", "SELECT CAST(ts AS DATE) AS start, count(*) AS n_orders, count(*) AS units, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS amount FROM events WHERE event_type = 'purchase' GROUP BY 1")
def x2_daily(spark, sf):
    return _latest(spark, stream.units(_lines(_stream(spark, sf)), days=1), ["start"]).withColumn("amount", F.col("amount").cast("double"))


@query(
    "x3_running_week",
    """WITH l AS (SELECT user_id % 10 AS id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase') SELECT id, CAST(count(*) FILTER (WHERE day BETWEEN DATE '2024-01-22' AND DATE '2024-01-24') AS BIGINT) AS so_far, count(*) FILTER (WHERE day BETWEEN DATE '2024-01-18' AND DATE '2024-01-24') / 7 AS pace,
count(*) FILTER (WHERE day BETWEEN DATE '2024-01-22' AND DATE '2024-01-24') + count(*) FILTER (WHERE day BETWEEN DATE '2024-01-18' AND DATE '2024-01-24') / 7 * 4 AS expected, CAST(100 AS BIGINT) AS forecast FROM l GROUP BY id""",
)
def x3(spark, sf):
    path, out = new_path(spark, "stream"), {}

    def sink(week, batch_id):
        out["path"] = f"{path}/weeks-{batch_id}"
        week.write.mode("overwrite").parquet(out["path"])

    days = stream.units_by_day(_lines(_stream(spark, sf)).withColumn("id", F.col("user_id") % 10))
    forecast = spark.range(10).select("id", F.lit(100).cast("long").alias("qty"))
    run = stream.each_batch(forecast, date(2024, 1, 24), f"{path}/days", sink)
    days.writeStream.foreachBatch(run).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out["path"])
