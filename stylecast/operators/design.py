"""Design suggestions: channel-weighted report weeks, momentum, trends, trend of attribute values, top picks.

frame: style, offset (report weeks before now, 0 or less), channel, qty, adj.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import calendar as cal

# Report weeks of a year, of momentum, of a trend; blocks of a trend's history; least units; strong change in per cent.
YEAR, MOMENTUM, TREND, BLOCKS, LEAST_UNITS, STRONG, ON_SALE, NEW_DAYS = 48, 8, 4, 6, 30, 30, 20, 56
# First days of report weeks; days that hold a pace back; how far it goes at most.
WEEK_STARTS, PACE_PRIOR_DAYS, PACE_LIMITS = (1, 8, 16, 24), 3.0, (0.5, 2.0)


def chunk_frame(sales: DataFrame, snap: date) -> DataFrame:
    """Units by style, report week and channel, and adj: each channel at its usual weight within a week; sales: style, day, channel, qty."""
    now = cal.chunk_ord(F.lit(snap))
    rows = sales.where(F.col("day") <= F.lit(snap)).withColumn("offset", (cal.chunk_ord(F.col("day")) - now).cast("int")).where(F.col("offset") > -(YEAR + MOMENTUM))
    return weighted(rows.groupBy("style", "offset", "channel").agg(F.sum("qty").alias("qty")))


def running_projection(sales: DataFrame, stored: DataFrame, rates: DataFrame, factors: DataFrame, styles: DataFrame, snap: date) -> DataFrame:
    """Style, channel, units: what the running report week is still expected to sell.

    sales: style, day, channel, qty.  stored: style, forecast of the whole week as it was saved.
    rates: style, weekly units, for styles without one.  factors: day, factor of events; 1 where
    none is given.  styles: style, sub_category.  The forecast of the days to come is corrected by
    how each sub-category does against the forecast of the days so far, held back while these are few.
    """
    first = snap.replace(day=max(d for d in WEEK_STARTS if d <= snap.day))
    later = [d for d in WEEK_STARTS if d > first.day]
    end = first.replace(day=later[0]) - timedelta(days=1) if later else (first.replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)
    done, rest, week = (snap - first).days + 1, (end - snap).days, (end - first).days + 1
    extra = lambda a, b: F.coalesce(F.sum(F.when(F.col("day").between(F.lit(a), F.lit(b)), F.col("factor") - 1)), F.lit(0.0))
    seasonal = factors.agg((extra(first, snap) + done).alias("f_done"), (extra(snap + timedelta(days=1), end) + rest).alias("f_rest"))  # one row
    expected = rates.select("style", "weekly").join(stored.select("style", "forecast"), "style", "full").crossJoin(F.broadcast(seasonal))
    part = lambda days, f: F.coalesce(F.col("forecast") * days / week, F.col("weekly") / 7 * F.col(f), F.lit(0.0))
    so_far = sales.where(F.col("day").between(F.lit(first), F.lit(snap))).groupBy("style").agg(F.sum("qty").alias("so_far"))
    group = F.when(F.coalesce("sub_category", F.lit("")) == "", "_").otherwise(F.col("sub_category"))
    rows = expected.select("style", part(done, "f_done").alias("done"), part(rest, "f_rest").alias("rest")).join(so_far, "style", "left").join(styles.select("style", "sub_category"), "style", "left").withColumn("group", group)

    paces = rows.groupBy("group").agg(F.sum(F.coalesce("so_far", F.lit(0))).alias("real"), F.sum("done").alias("planned"))
    raw = F.when(F.col("planned") > 0, F.col("real") / F.col("planned")).otherwise(1.0)
    low, high = PACE_LIMITS
    paces = paces.select("group", F.least(F.lit(high), F.greatest(F.lit(low), 1 + (raw - 1) * (done / (done + PACE_PRIOR_DAYS)))).alias("pace"))

    now = cal.chunk_ord(F.lit(snap))
    o = cal.chunk_ord(F.col("day"))
    mix = sales.where((o >= now - TREND) & (o < now)).groupBy("style", "channel").agg(F.sum("qty").alias("qty"))
    own = mix.groupBy("style").agg(F.sum("qty").alias("all")).where("all > 0")
    shares = mix.join(own, "style").select("style", "channel", (F.col("qty") / F.col("all")).alias("share"))
    by_channel = mix.groupBy("channel").agg(F.sum("qty").alias("qty"))  # a row a channel, few
    total = by_channel.agg(F.sum("qty").alias("n"))
    usual = by_channel.crossJoin(F.broadcast(total)).where("n > 0").agg(F.collect_list(F.struct("channel", (F.col("qty") / F.col("n")).alias("share"))).alias("u"))
    usual = usual.select(F.when(F.size("u") > 0, F.col("u")).otherwise(F.array(F.struct(F.lit("All").alias("channel"), F.lit(1.0).alias("share")))).alias("u"))
    units = rows.join(F.broadcast(paces), "group").select("style", (F.col("rest") * F.col("pace")).alias("units")).where("units > 0")
    known = units.join(shares, "style").select("style", "channel", (F.col("units") * F.col("share")).alias("units"))
    other = units.join(own, "style", "left_anti").crossJoin(F.broadcast(usual)).select("style", "units", F.explode("u").alias("x")).select("style", F.col("x.channel").alias("channel"), (F.col("units") * F.col("x.share")).alias("units"))
    return known.unionByName(other).where("units > 0")


def with_projection(frame: DataFrame, projection: DataFrame) -> DataFrame:
    """The frame with the running week completed; real: the units without what is projected."""
    rows = frame.select("style", "offset", "channel", F.col("qty").cast("double").alias("qty"), F.col("qty").cast("double").alias("real"))
    extra = projection.select("style", F.lit(0).alias("offset"), "channel", F.col("units").alias("qty"), F.lit(0.0).alias("real"))
    sums = rows.unionByName(extra).groupBy("style", "offset", "channel").agg(F.sum("qty").alias("qty"), F.sum("real").alias("real"))
    return weighted(sums.drop("real")).join(sums.select("style", "offset", "channel", "real"), ["style", "offset", "channel"])


def weighted(f: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds adj to units by style, report week and channel; keys: columns of frames that don't mix, seasons say."""
    recent = f.where(F.col("offset") > -BLOCKS * TREND)
    total = recent.groupBy(*keys).agg(F.sum("qty").alias("all"))
    usual = recent.groupBy(*keys, "channel").agg(F.sum("qty").alias("u"))
    usual = usual.join(F.broadcast(total), list(keys)) if keys else usual.crossJoin(F.broadcast(total))
    usual = usual.select(*keys, "channel", (F.col("u") / F.col("all")).alias("w"))
    week, mine = F.sum("qty").over(Window.partitionBy(*keys, "offset")), F.sum("qty").over(Window.partitionBy(*keys, "offset", "channel"))
    # totals by week and channel come from a table of weeks, not from a window over all styles
    weeks = f.groupBy(*keys, "offset", "channel").agg(F.sum("qty").alias("qty")).select(*keys, "offset", "channel", week.alias("tot"), mine.alias("tot_c"))
    out = f.join(weeks, [*keys, "offset", "channel"]).join(usual, [*keys, "channel"], "left").fillna(0.0, ["w"])
    return out.select(*keys, "style", "offset", "channel", "qty", F.when(F.col("tot_c") > 0, F.col("qty") * F.col("w") * F.col("tot") / F.col("tot_c")).otherwise(0.0).alias("adj"))


def momentum(frame: DataFrame) -> DataFrame:
    """D3: style, now, year_ago: the last weeks and the same a year before."""
    o = F.col("offset")
    now, ago = o > -MOMENTUM, (o <= -YEAR) & (o > -YEAR - MOMENTUM)
    return frame.where(now | ago).groupBy("style").agg(F.sum(F.when(now, F.col("adj")).otherwise(0.0)).alias("now"), F.sum(F.when(ago, F.col("adj")).otherwise(0.0)).alias("year_ago"))


def trend(frame: DataFrame) -> DataFrame:
    """Style, now, before (weighted), real_now, real_before."""
    o = F.col("offset")
    now, before = o > -TREND, (o <= -TREND) & (o > -2 * TREND)
    part = lambda c, of: F.sum(F.when(of, F.col(c)).otherwise(0))
    return frame.where(o > -2 * TREND).groupBy("style").agg(part("adj", now).alias("now"), part("adj", before).alias("before"), part("qty", now).alias("real_now"), part("qty", before).alias("real_before"))


def share_trends(trends: DataFrame, styles: DataFrame, attribute: str) -> DataFrame:
    """Value, now, share (per cent), change_pct (null under the least units), active (styles selling)."""
    totals = trends.agg(F.sum("now").alias("tn"), F.sum("before").alias("tb"))
    rows = trends.join(styles.select("style", F.col(attribute).alias("value")), "style").groupBy("value").agg(F.sum("now").alias("now"), F.sum("before").alias("before"), F.count_if(F.col("real_now") > 0).alias("active"))
    rows = rows.crossJoin(F.broadcast(totals))
    share, then = F.when(F.col("tn") > 0, F.col("now") / F.col("tn")).otherwise(0.0), F.when(F.col("tb") > 0, F.col("before") / F.col("tb")).otherwise(0.0)
    change = F.when((F.col("before") >= LEAST_UNITS) & (then > 0), (share / then - 1) * 100)
    return rows.select("value", "now", (share * 100).alias("share"), change.alias("change_pct"), "active")


def direction(change: Column) -> Column:
    """Rising, falling or steady."""
    return F.when(change >= STRONG, "rising").when(change <= -STRONG, "falling").otherwise("steady")


def trending(trends: DataFrame, first_sale: DataFrame, snap: date) -> DataFrame:
    """Styles that gain strongly, with a flag for new launches; first_sale: style, first."""
    rows = trends.where((F.col("real_now") >= ON_SALE) & (F.col("real_now") >= (1 + STRONG / 100) * F.col("real_before"))).join(first_sale, "style", "left")
    growth = F.when(F.col("real_before") >= 10, F.bround((F.col("real_now") / F.col("real_before") - 1) * 100, 1))
    return rows.select("style", "real_now", "real_before", growth.alias("growth_pct"), (F.datediff(F.lit(snap), "first") <= NEW_DAYS).alias("new_launch"))


def reference_season(sales: DataFrame, code: str, year: int, snap: date) -> DataFrame:
    """One row at most: the latest complete occurrence of a season within five years, and whether its data is whole."""
    d = F.col("day")
    seasons = sales.select(cal.season(d).alias("season"), cal.season_year(d).alias("year"), "day").where((F.col("season") == code) & F.col("year").between(year - 5, year - 1))
    first = sales.agg(F.min("day").alias("first"))
    ends = seasons.groupBy("season", "year").agg(F.count(F.lit(1)).alias("n")).where(cal.season_end(F.col("season"), F.col("year")) < F.lit(snap))
    best = ends.orderBy(F.desc("year")).limit(1).crossJoin(F.broadcast(first))
    return best.select("season", "year", (cal.season_start(F.col("season"), F.col("year")) >= F.col("first")).alias("whole"))


def top_pick_hits(rows: DataFrame, share: float = 0.2, least: int = 5) -> DataFrame:
    """L4: one row: of the designs predicted in a season's top fifth, the per cent that were; rows: style, season, y, p."""
    by = lambda c: F.row_number().over(Window.partitionBy("season").orderBy(F.desc(c), "style"))
    n = F.floor(F.count(F.lit(1)).over(Window.partitionBy("season")) * share)
    ranked = rows.select("season", by("y").alias("ry"), by("p").alias("rp"), n.alias("n")).where(F.col("n") >= least)
    hit, pick = F.count_if((F.col("ry") <= F.col("n")) & (F.col("rp") <= F.col("n"))), F.count_if(F.col("rp") <= F.col("n"))
    return ranked.agg(F.when(pick > 0, F.bround(hit / pick * 100, 1)).alias("hit_pct"))
