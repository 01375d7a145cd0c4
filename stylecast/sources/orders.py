"""Order lines: scans, cleaning, and the base frames that most operators start from."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import calendar, keys

#: Columns of an order line that the library reads.
ORDER_COLUMNS = ("product_sku_code", "listing_sku_code", "qty", "order_status", "order_date", "total", "buyer_city", "buyer_state", "channel_name", "warehouse_name", "category_name", "brand_name", "source", "channel_order_id", "channel_sub_order_id")


def scan(source: DataFrame, start: date, today: date, columns: tuple[str, ...] = ORDER_COLUMNS) -> DataFrame:
    """The needed columns of the orders of a span of days; both reach a Parquet or JDBC scan."""
    return source.select(*(c for c in columns if c in source.columns)).where(F.col("order_date").between(F.lit(start), F.lit(today)))


def complete(rows: DataFrame, expected: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """One row: rows read, rows the source counts, and whether they agree within the tolerance; expected has n."""
    return rows.agg(F.count(F.lit(1)).alias("n_read")).crossJoin(expected.select(F.col("n").alias("n_source"))).withColumn("complete", F.abs(F.col("n_read") - F.col("n_source")) <= tolerance * F.col("n_source"))


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*(F.col(c) if c in keep or c.startswith(prefix) else F.col(c).alias(prefix + c) for c in df.columns))


def unprefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(c.removeprefix(prefix)) for c in df.columns))


def without_combos(df: DataFrame) -> DataFrame:
    return df.where(~keys.is_combo(F.col("product_sku_code"), F.col("listing_sku_code")))


def without_placeholders(df: DataFrame) -> DataFrame:
    return df.where(~keys.is_placeholder(F.col("product_sku_code")))


def without_channel(df: DataFrame, word: str) -> DataFrame:
    return df.where(~F.coalesce(F.lower("channel_name").contains(word.lower()), F.lit(False)))


def clean(df: DataFrame, today: date, excluded_channel: str = "shopify", by: str | None = None) -> DataFrame:
    """Order lines without combos, placeholders, the excluded channel, future orders, missing SKUs and exact repeats.

    by: a column that equal lines share and that the lines are dealt out by.  It goes; repeats are
    then dropped where they lie, in the one sort that leaves each task's lines in the order of their dates.
    """
    rows = without_channel(without_placeholders(without_combos(df)), excluded_channel)
    rows = rows.where(F.col("product_sku_code").isNotNull() & (F.col("order_date") <= F.lit(today)))
    if by is None:
        return rows.dropDuplicates()
    alike = Window.partitionBy("order_date", by, *(c for c in rows.columns if c not in ("order_date", by))).orderBy(by)
    return rows.withColumn("_before", F.lag(F.lit(True)).over(alike)).where(F.col("_before").isNull()).drop("_before", by)


def labelled(df: DataFrame) -> DataFrame:
    """Adds gross, net and returned flags."""
    s = F.col("order_status")
    return df.withColumns({"gross": keys.is_gross(s), "net": keys.is_net(s), "returned": keys.is_return(s)})


def sales_base(cleaned: DataFrame) -> DataFrame:
    """Gross lines with style, day, month, report week and marketplace; a missing source is OMS."""
    source = F.when(F.trim(F.coalesce("source", F.lit(""))) == "", "OMS").otherwise(F.col("source"))
    rows = cleaned.where(keys.is_gross(F.col("order_status"))).withColumn("source", source)
    rows = rows.select(
        F.coalesce("DESIGN_NO", keys.design_key(F.col("product_sku_code"))).alias("style") if "DESIGN_NO" in cleaned.columns else keys.design_key(F.col("product_sku_code")).alias("style"),
        F.col("product_sku_code").alias("sku"), F.col("order_date").alias("day"), F.date_format("order_date", "yyyy-MM").alias("month"),
        calendar.chunk_start(F.col("order_date")).alias("chunk_start"), keys.marketplace(F.col("channel_name"), F.col("source")).alias("marketplace"), "source", "qty", "total",
    )
    return rows.where(F.col("style").isNotNull() & F.col("day").isNotNull())


def slim(cleaned: DataFrame) -> DataFrame:
    """The gross lines' serving columns with a row number; repeats are dropped on the full row before narrowing."""
    return sales_base(cleaned).select("style", "sku", "day", "qty", "marketplace", "source").withColumn("row_id", F.monotonically_increasing_id())


def calendar_csv(spark: SparkSession, path: str) -> DataFrame:
    """The event calendar: name, start_date, end_date, category; incomplete rows go."""
    rows = spark.read.csv(path, header=True)
    name, start, end = rows.columns[:3]
    day = lambda c: F.try_to_timestamp(F.trim(F.col(c)), F.lit("dd-MM-yyyy")).cast("date")
    out = rows.select(F.trim(F.col(name)).alias("name"), day(start).alias("start_date"), day(end).alias("end_date")).where((F.col("name") != "") & F.col("start_date").isNotNull() & F.col("end_date").isNotNull())
    return out.withColumn("category", F.when(F.col("name").endswith("(Festival)"), "festival").otherwise("sale"))


def attribute_sheet(rows: DataFrame, style_col: str, order_col: str, columns: tuple[str, ...]) -> DataFrame:
    """The first row of each style, values that stand for nothing as empty strings."""
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(F.upper(F.trim(F.col(style_col)))).orderBy(order_col))).where("_r = 1")
    return first.select(F.upper(F.trim(F.col(style_col))).alias("style"), *(keys.clean_display(F.col(c)).alias(c) for c in columns))


def materials(bom: DataFrame, group_col: str = "ARTICLE_GROUP", used_col: str = "USED_IN", suffixes: tuple[str, ...] = ()) -> DataFrame:
    """design, material: each design of a comma list with its material group; section suffixes are cut off."""
    rows = bom.select(F.upper(F.trim(F.col(group_col))).alias("material"), F.explode(F.split(F.col(used_col), ",")).alias("design"))
    rows = rows.withColumn("design", F.upper(F.trim("design"))).where((F.col("design") != "") & (F.col("material") != ""))
    if suffixes:
        rows = rows.withColumn("design", F.regexp_replace("design", rf"[-_ ]?(?:{'|'.join(suffixes)})$", ""))
    return rows.distinct()


def tier_tables(active: DataFrame, log: DataFrame) -> DataFrame:
    """Tier changes of active styles: style, tier, effective_from."""
    return log.join(active.select(F.upper(F.trim("name")).alias("style")).distinct(), F.upper(F.trim(log["name"])) == F.col("style")).select("style", "tier", F.col("effective_from").cast("date").alias("effective_from"))
