"""Joins: design master, stock and work in progress, as-of tiers, intervals, dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import UNCLASSIFIED
from ..functions import keys


def number(c: Column) -> Column:
    """A quantity that may come as text; what is no number counts as 0."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def with_design(sales: DataFrame, master: DataFrame) -> DataFrame:
    """Adds the master's columns by design key; lines without a match keep their own key as DESIGN_NO, which is cleaned."""
    first = Window.partitionBy("design_key").orderBy("DESIGN_NO")
    dim = master.withColumn("design_key", keys.design_key(F.col("DESIGN_NO"))).where(F.col("design_key").isNotNull()).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    rows = sales.withColumn("design_key", keys.design_key(F.col("product_sku_code"))).join(dim, "design_key", "left")
    return rows.withColumn("DESIGN_NO", keys.clean_design_no(F.coalesce("DESIGN_NO", "design_key"))).drop("design_key")


def wip_by_size(planning: DataFrame, parts: tuple[str, ...] = ("IN_HOUSE_QTY_WIP", "JOB_WORK_QTY_WIP", "ALLOCATION_QTY")) -> DataFrame:
    """A1: work in progress of each design and size."""
    total = sum((number(F.col(c)) for c in parts[1:]), number(F.col(parts[0])))
    return planning.groupBy(keys.stock_design(F.col("DESIGN_NAME")).alias("design"), F.upper(F.trim("SIZE")).alias("size")).agg(F.sum(total).alias("wip"))


def stock_by_size(inventory: DataFrame) -> DataFrame:
    """A2: stock of each design and size."""
    return inventory.groupBy(keys.stock_design(F.col("DESIGN_NO")).alias("design"), F.upper(F.trim("SIZE")).alias("size")).agg(F.sum(number(F.col("PENDING_QTY_PIECES"))).alias("stock"))


def with_stock(sales: DataFrame, wip: DataFrame, stock: DataFrame) -> DataFrame:
    """Adds design, size, wip and stock to order lines; 0 where there is none."""
    design, size = keys.design_and_size(F.col("product_sku_code"))
    return sales.withColumn("design", design).withColumn("size", size).join(wip, ["design", "size"], "left").join(stock, ["design", "size"], "left").fillna(0.0, ["wip", "stock"])


def primary_sku_only(rows: DataFrame) -> DataFrame:
    """Wip and stock stay on one SKU of each design and size (most lines, then the smallest code), 0 on the others.

    Lines are counted by SKU first, so that the window only sees a row a SKU.
    """
    counted = rows.groupBy("design", "size", "product_sku_code").agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy("design", "size").orderBy(F.desc("_n"), "product_sku_code"))
    first = counted.withColumn("_r", rank).where("_r = 1").select("design", "size", F.col("product_sku_code").alias("_primary"))
    out = rows.join(first, ["design", "size"], "left")
    mine = F.col("product_sku_code") == F.col("_primary")
    return out.withColumns({c: F.when(mine, F.col(c)).otherwise(0.0) for c in ("wip", "stock")}).drop("_primary")


def tier_intervals(log: DataFrame, key: str = "name") -> DataFrame:
    """Validity of each tier: key, tier, valid_from, valid_to (exclusive, null for the current one); the last row of a day wins."""
    one = log.groupBy(F.upper(F.trim(F.col(key))).alias("key"), F.col("effective_from").alias("valid_from")).agg(F.max("tier").alias("tier"))
    return one.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("key").orderBy("valid_from")))


def tier_as_of(rows: DataFrame, log: DataFrame, key: str, day: str, unknown: str = "Unknown") -> DataFrame:
    """Adds the tier that held on the day; unknown before the first."""
    t = tier_intervals(log)
    on = (F.upper(F.trim(rows[key])) == t["key"]) & (rows[day] >= t["valid_from"]) & (t["valid_to"].isNull() | (rows[day] < t["valid_to"]))
    return rows.join(t, on, "left").drop("key", "valid_from", "valid_to").withColumn("tier", F.coalesce("tier", F.lit(unknown)))


def current_tier(log: DataFrame) -> DataFrame:
    """Style, tier that holds now."""
    return tier_intervals(log).where(F.col("valid_to").isNull()).select(F.col("key").alias("style"), "tier")


def tier_at_sale(rows: DataFrame, log: DataFrame, key: str, day: str) -> DataFrame:
    """The tier that held on the day, else the current one, else unclassified."""
    now = current_tier(log).select(F.col("style").alias("_style"), F.col("tier").alias("_now"))
    out = tier_as_of(rows, log, key, day, "")
    out = out.join(now, F.upper(F.trim(out[key])) == now["_style"], "left")
    return out.withColumn("tier", F.coalesce(F.nullif("tier", F.lit("")), "_now", F.lit(UNCLASSIFIED))).drop("_style", "_now")


def event_days(events: DataFrame) -> DataFrame:
    """One row for each day of an event: day, name, category."""
    return events.select("name", "category", F.explode(F.sequence("start_date", "end_date")).alias("day"))


def with_events(spans: DataFrame, events: DataFrame, start: str, end: str) -> DataFrame:
    """Adds the names of the events that overlap a span, joined, and their kind: festival, sale or both."""
    days = event_days(events).select("day", "name", "category").distinct()
    mine = spans.select(start, end).distinct().withColumn("day", F.explode(F.sequence(F.col(start), F.col(end))))
    met = mine.join(days, "day").groupBy(start, end).agg(F.array_join(F.sort_array(F.collect_set("name")), " + ").alias("event"), F.bool_or(F.col("category") == "festival").alias("_f"), F.bool_or(F.col("category") == "sale").alias("_s"))
    kind = F.when(F.col("_f") & F.col("_s"), "both").when(F.col("_f"), "festival").when(F.col("_s"), "sale")
    return spans.join(met.withColumn("event_kind", kind).drop("_f", "_s"), [start, end], "left")


def with_styles(rows: DataFrame, styles: DataFrame, columns: tuple[str, ...], key: str = "style") -> DataFrame:
    """Adds a style's columns; unclassified where there is none or it stands for nothing."""
    dim = styles.select(F.upper(F.trim(F.col("style"))).alias("_style"), *(F.nullif(keys.clean_display(F.col(c)), F.lit("")).alias(c) for c in columns)).dropDuplicates(["_style"])
    out = rows.drop(*columns).join(dim, F.upper(F.trim(rows[key])) == dim["_style"], "left").drop("_style")
    return out.fillna(UNCLASSIFIED, list(columns))


def filled_edges(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The fallback's edges only for designs without any of their own; both: design, other, sim."""
    return primary.unionByName(fallback.join(primary.select("design").distinct(), "design", "left_anti"))
