"""Sales analysis: month by group, same styles, drill-downs, regions, channels, tiers."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import calendar as cal
from ..functions import keys


def _prev(month: Column) -> Column:
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), -1), "yyyy-MM")


def _next(month: Column) -> Column:
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), 1), "yyyy-MM")


def change_pct(now: Column, before: Column) -> Column:
    """Change in per cent, one decimal, half to even; null where there was nothing before."""
    return F.when(before > 0, F.bround((now - before) / before * 100, 1))


def partial_month(snap: date) -> str | None:
    """The month of the snapshot unless it ends it."""
    return None if (snap + timedelta(days=1)).day == 1 else f"{snap:%Y-%m}"


def months_by_group(frame: DataFrame, snap: date, group: str = "group") -> DataFrame:
    """Month, group, styles, orders, units, prev_units, change_pct, partial.

    frame: month, day, style, qty and the group.  The previous month counts as a whole, but
    for the partial current month, which is held against the same days of it.  The frame is
    summed by month, group and style once; all else works on that.
    """
    partial = partial_month(snap)
    same_days = F.sum(F.when(F.dayofmonth("day") <= snap.day, F.col("qty")).otherwise(0))
    by_style = frame.groupBy("month", group, "style").agg(F.count(F.lit(1)).alias("orders"), F.sum("qty").alias("units"), same_days.alias("early"))
    rows = by_style.groupBy("month", group).agg(F.countDistinct("style").alias("styles"), F.sum("orders").alias("orders"), F.sum("units").alias("units"), F.sum("early").alias("early"))
    before = rows.select(_next(F.col("month")).alias("month"), group, F.col("units").alias("whole"), F.col("early").alias("part"))
    rows = rows.join(before, ["month", group], "left")
    is_partial = F.col("month") == F.lit(partial) if partial else F.lit(False)
    prev = F.coalesce(F.when(is_partial, F.col("part")).otherwise(F.col("whole")), F.lit(0))
    rows = rows.select("month", group, "styles", "orders", "units", prev.alias("prev_units"), is_partial.alias("partial"))
    return rows.withColumn("change_pct", change_pct(F.col("units"), F.col("prev_units")))


def same_styles(frame: DataFrame, snap: date, group: str = "group") -> DataFrame:
    """Month, group, styles_both, same_units, same_prev_units, new_styles, new_units, stopped_styles, same_change_pct."""
    partial = partial_month(snap)
    early = F.sum(F.when(F.dayofmonth("day") <= snap.day, F.col("qty")).otherwise(0))
    su = frame.groupBy("month", group, "style").agg(F.sum("qty").alias("units"), early.alias("early"))
    before = su.select(_next(F.col("month")).alias("month"), group, "style", F.col("units").alias("whole"), F.col("early").alias("part"))
    both_sides = su.join(before, ["month", group, "style"], "full")
    is_partial = F.col("month") == F.lit(partial) if partial else F.lit(False)
    now, whole = F.coalesce("units", F.lit(0)), F.coalesce("whole", F.lit(0))
    prev = F.when(is_partial, F.coalesce("part", F.lit(0))).otherwise(whole)
    both, new = (now > 0) & (prev > 0), (now > 0) & (whole <= 0)
    out = both_sides.groupBy("month", group).agg(
        F.count_if(F.col("units").isNotNull()).alias("_sold"), F.count_if(both).alias("styles_both"), F.sum(F.when(both, now).otherwise(0)).alias("same_units"), F.sum(F.when(both, prev).otherwise(0)).alias("same_prev_units"),
        F.count_if(new).alias("new_styles"), F.sum(F.when(new, now).otherwise(0)).alias("new_units"), F.count_if(F.col("units").isNull()).alias("stopped_styles"),
    )
    return out.where("_sold > 0").drop("_sold").withColumn("same_change_pct", change_pct(F.col("same_units"), F.col("same_prev_units")))


def with_total(rows: DataFrame, group: str = "group", total: str = "TOTAL") -> DataFrame:
    """Adds a row a month for all groups; its change is computed from the sums."""
    sums = ("styles", "orders", "units", "prev_units")
    month = rows.groupBy("month").agg(*(F.sum(c).alias(c) for c in sums), F.bool_or("partial").alias("partial"))
    month = month.withColumn(group, F.lit(total)).withColumn("change_pct", change_pct(F.col("units"), F.col("prev_units")))
    return rows.unionByName(month.select(rows.columns))


def styles_of_month(frame: DataFrame, month: str) -> DataFrame:
    """Style, units, orders, prev_units, state (new, both or stopped) of a month."""
    one = lambda m, tag: frame.where(F.col("month") == m).groupBy("style").agg(F.sum("qty").alias(f"{tag}units"), F.count(F.lit(1)).alias(f"{tag}orders"))
    y, m = map(int, month.split("-"))
    prev = f"{y - (m == 1)}-{(m - 2) % 12 + 1:02d}"
    rows = one(month, "").join(one(prev, "prev_").drop("prev_orders"), "style", "full")
    state = F.when(F.col("prev_units").isNull(), "new").when(F.col("units").isNull(), "stopped").otherwise("both")
    return rows.select("style", F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("prev_units", F.lit(0)).alias("prev_units"), state.alias("state"))


def window_sums(rows: DataFrame, snap: date, days: tuple[int, ...] = (10, 35, 90)) -> DataFrame:
    """Units of trailing windows by SKU, and the price realised over the longest."""
    since = lambda d: F.col("order_date") >= F.lit(snap - timedelta(days=d - 1))
    longest = max(days)
    out = rows.groupBy("product_sku_code").agg(*(F.sum(F.when(since(d), F.col("qty")).otherwise(0)).alias(f"units{d}") for d in days), F.sum(F.when(since(longest), F.col("total").cast("decimal(18,2)"))).alias("_rev"))
    price = F.when(F.col(f"units{longest}") > 0, F.bround(F.col("_rev").cast("double") / F.col(f"units{longest}"), 2)).otherwise(0.0)
    return out.withColumn("price", price).drop("_rev")


def top_places(rows: DataFrame, place: Column, snap: date, cap: int = 100, days: tuple[int, ...] = (10, 30, 90), sort: str = "units30") -> DataFrame:
    """Units and revenue of trailing windows by place, the largest first; a top report."""
    since = lambda d: F.col("order_date") >= F.lit(snap - timedelta(days=d - 1))
    cents = F.col("total").cast("decimal(18,2)")
    sums = [F.sum(F.when(since(d), F.col("qty")).otherwise(0)).alias(f"units{d}") for d in days] + [F.bround(F.coalesce(F.sum(F.when(since(d), cents)), F.lit(0)), 0).cast("long").alias(f"revenue{d}") for d in days]
    out = rows.where(since(max(days))).groupBy(place.alias("name")).agg(*sums).where(F.col("name").isNotNull())
    return out.orderBy(F.desc(sort), "name").limit(cap)


def brand_of_style(lines: DataFrame, sheet: DataFrame | None = None) -> DataFrame:
    """Style, brand: the sheet's, else the most frequent one of its orders, else unclassified."""
    counted = lines.withColumn("brand", F.nullif(keys.norm_brand(F.col("brand_name")), F.lit(""))).groupBy("style", "brand").agg(F.count(F.lit(1)).alias("n"))
    most = counted.groupBy("style").agg(F.min_by("brand", F.when(F.col("brand").isNotNull(), F.struct(-F.col("n"), F.col("brand")))).alias("most"))
    if sheet is None:
        return most.select("style", F.coalesce("most", F.lit("Unclassified")).alias("brand"))
    return most.join(sheet.select("style", F.col("brand").alias("sheet")), "style", "left").select("style", F.coalesce(F.nullif("sheet", F.lit("")), "most", F.lit("Unclassified")).alias("brand"))


def channel_weeks(frame: DataFrame) -> DataFrame:
    """Units by marketplace, source and report week, with the pair's total."""
    cells = frame.groupBy("marketplace", "source", "chunk_start").agg(F.sum("qty").alias("units"))
    return cells.withColumn("total", F.sum("units").over(Window.partitionBy("marketplace", "source")))


def style_years(frame: DataFrame, launches: DataFrame, year: int) -> DataFrame:
    """By sub-category, styles that sold last year, styles launched this year, and both together."""
    sold = frame.where(F.year("day") == year - 1).select("sub_category", "style").distinct().withColumn("sold", F.lit(1))
    new = launches.where(F.year("launch") == year).select("sub_category", "style").distinct().withColumn("new", F.lit(1))
    return sold.join(new, ["sub_category", "style"], "full").groupBy("sub_category").agg(F.count("sold").alias("sold_last_year"), F.count("new").alias("launched"), F.count(F.lit(1)).alias("styles"))


def styles_by_tier(tiers: DataFrame) -> DataFrame:
    """Tier, n_styles, styles (sorted, joined)."""
    return tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("n_styles"), F.array_join(F.sort_array(F.collect_set("style")), ",").alias("styles"))


def month_total(labelled: DataFrame, month: str) -> DataFrame:
    """Gross, net and all units of a month: in all, by source, and by status."""
    rows = labelled.where(F.date_format("order_date", "yyyy-MM") == month)
    flags = [F.sum(F.when(F.col("gross"), F.col("qty")).otherwise(0)).alias("gross"), F.sum(F.when(F.col("net"), F.col("qty")).otherwise(0)).alias("net"), F.sum("qty").alias("all_units")]
    return rows.groupingSets([[], [F.col("source")], [F.col("order_status")]], "source", "order_status").agg(*flags)


def filter_options(styles: DataFrame) -> DataFrame:
    """Category, sub_categories (sorted, joined)."""
    return styles.groupBy("category").agg(F.array_join(F.sort_array(F.collect_set("sub_category")), ",").alias("sub_categories"))


def actuals(labelled: DataFrame, axis_start: date) -> DataFrame:
    """A4: net and gross units of each SKU by week and day, in one pass: sku, week, day, gross_units, net_units."""
    rows = labelled.where(F.col("order_date") >= F.lit(axis_start) if axis_start else F.lit(True))
    return rows.groupBy(F.col("product_sku_code").alias("sku"), cal.monday(F.col("order_date")).alias("week"), F.col("order_date").alias("day")).agg(
        F.sum(F.when(F.col("gross"), F.col("qty")).otherwise(0)).alias("gross_units"), F.sum(F.when(F.col("net"), F.col("qty")).otherwise(0)).alias("net_units")
    )


def split_by_share(rows: DataFrame, keys_: list[str], total: str, weight: str, order: str, out: str = "units") -> DataFrame:
    """Splits a whole total by weights into whole units that add up to it (largest remainder); equal weights where all are 0."""
    w = Window.partitionBy(*keys_)
    sum_w, n = F.sum(weight).over(w), F.count(F.lit(1)).over(w)
    raw = F.when(sum_w > 0, F.col(total) * F.col(weight) / sum_w).otherwise(F.col(total) / n)
    rows = rows.withColumn("_raw", F.when(F.col(total) > 0, raw).otherwise(0.0)).withColumn("_floor", F.floor("_raw"))
    rank = F.row_number().over(w.orderBy(F.desc(F.bround(F.col("_raw") - F.col("_floor"), 9)), order))
    left = F.greatest(F.col(total), F.lit(0)) - F.sum("_floor").over(w)
    return rows.withColumn(out, (F.col("_floor") + F.when(rank <= left, 1).otherwise(0)).cast("long")).drop("_raw", "_floor")
