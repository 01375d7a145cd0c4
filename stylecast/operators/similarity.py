"""Similar designs by shared tokens, and what new designs borrow from them.

tokens: design, token, grp (the group that must agree; null is unknown and agrees with all).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F


def attribute_tokens(styles: DataFrame, columns: tuple[str, ...], grp: str | None = None) -> DataFrame:
    """K3: PREFIX:VALUE of each attribute that says something."""
    cols = F.array(*(F.concat(F.lit(c.upper() + ":"), F.upper(F.trim(F.col(c)))) for c in columns))
    rows = styles.select(F.col("style").alias("design"), F.explode(cols).alias("token"), (F.col(grp) if grp else F.lit(None).cast("string")).alias("grp"))
    return rows.where(F.col("token").isNotNull() & ~F.col("token").endswith(":")).distinct()


def token_weights(tokens: DataFrame) -> DataFrame:
    """K1: token, idf = ln(N / df) + 1."""
    n = tokens.agg(F.countDistinct("design").alias("n"))
    return tokens.groupBy("token").agg(F.countDistinct("design").alias("df")).crossJoin(F.broadcast(n)).select("token", "df", (F.ln(F.col("n") / F.col("df")) + 1).alias("idf"))


def pairs(tokens: DataFrame) -> DataFrame:
    """Design, other, sim: weighted Jaccard of the designs that share a token, groups agreeing."""
    w = tokens.join(token_weights(tokens).select("token", "idf"), "token")
    total = w.groupBy("design").agg(F.sum("idf").alias("total"))
    a, b = w.alias("a"), w.alias("b")
    gate = F.col("a.grp").isNull() | F.col("b.grp").isNull() | (F.col("a.grp") == F.col("b.grp"))
    shared = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.design") < F.col("b.design")) & gate).groupBy(F.col("a.design").alias("design"), F.col("b.design").alias("other")).agg(F.sum("a.idf").alias("shared"))
    rows = shared.join(total.withColumnRenamed("total", "ta"), "design").join(total.select(F.col("design").alias("other"), F.col("total").alias("tb")), "other")
    half = rows.select("design", "other", F.bround(F.col("shared") / (F.col("ta") + F.col("tb") - F.col("shared")), 9).alias("sim"))
    return half.unionByName(half.select(F.col("other").alias("design"), F.col("design").alias("other"), "sim"))


def profiles(tokens: DataFrame) -> DataFrame:
    """One row a design and group: design, grp, terms (idf and token of each, the heaviest first), total (of all idf)."""
    w = tokens.join(token_weights(tokens).select("token", "idf"), "token")
    terms = F.sort_array(F.collect_set(F.struct("idf", "token")), asc=False)
    return w.groupBy("design", "grp").agg(terms.alias("terms")).withColumn("total", F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + t["idf"]))


def pairs_over(of: DataFrame, least: float) -> DataFrame:
    """J9, J10, K2 under a threshold: grp, design < other, sim >= least (over 0), without listing all pairs of a common token.

    of: as ``profiles`` gives it.  Two designs that are so similar share one of the tokens that come first,
    in the one order of all (heaviest, that is rarest, first), down to where the rest of a design
    weighs under ``least`` of its total.  So only these are joined, within a group: a token that
    most designs have comes last and is joined by those only that have hardly another.  Candidates
    are weighed by all tokens.  grp is null in pairs of which a group is unknown.
    """
    near = 1e-9  # sums in different orders differ by less
    rest = lambda i: F.aggregate(F.slice("terms", i + 1, F.size("terms")), F.lit(0.0), lambda acc, t: acc + t["idf"])
    first = F.filter("terms", lambda t, i: rest(i) >= F.col("total") * least - near)
    listed = of.select("design", "grp", "total", F.explode(F.transform(first, lambda t: t["token"])).alias("token"))
    a, b = listed.alias("a"), listed.alias("b")
    alike = (F.least("a.total", "b.total") >= F.greatest("a.total", "b.total") * least - near) & (F.col("a.token") == F.col("b.token"))
    known = a.join(b, alike & (F.col("a.grp") == F.col("b.grp")) & (F.col("a.design") < F.col("b.design"))).select(F.col("a.grp").alias("ga"), F.col("b.grp").alias("gb"), F.col("a.design").alias("design"), F.col("b.design").alias("other"))
    # an unknown group agrees with all; of two unknown ones the smaller design stands first
    loose = a.where("grp IS NULL").join(b, alike & (F.col("a.design") != F.col("b.design")) & (F.col("b.grp").isNotNull() | (F.col("a.design") < F.col("b.design"))))
    swap = F.col("a.design") > F.col("b.design")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    loose = loose.select(pick("a.grp", "b.grp").alias("ga"), pick("b.grp", "a.grp").alias("gb"), pick("a.design", "b.design").alias("design"), pick("b.design", "a.design").alias("other"))
    candidates = known.unionByName(loose).distinct()
    left = of.select(F.col("design").alias("d1"), F.col("grp").alias("ga_"), F.col("terms").alias("x"), F.col("total").alias("tx"))
    right = of.select(F.col("design").alias("d2"), F.col("grp").alias("gb_"), F.col("terms").alias("y"), F.col("total").alias("ty"))
    rows = candidates.join(left, (F.col("design") == F.col("d1")) & F.col("ga").eqNullSafe(F.col("ga_"))).join(right, (F.col("other") == F.col("d2")) & F.col("gb").eqNullSafe(F.col("gb_")))
    shared = F.aggregate(F.array_intersect("x", "y"), F.lit(0.0), lambda acc, t: acc + t["idf"])
    rows = rows.withColumn("shared", shared).withColumn("sim", F.bround(F.col("shared") / (F.col("tx") + F.col("ty") - F.col("shared")), 9))
    return rows.where(F.col("sim") >= least).select(F.when(F.col("ga") == F.col("gb"), F.col("ga")).alias("grp"), "design", "other", "sim")


def neighbours(edges: DataFrame, k: int = 6) -> DataFrame:
    """The k most similar others of each design, with rank."""
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy("design").orderBy(F.desc("sim"), "other"))).where(F.col("rank") <= k)


def eligible(launch: Column, sim: Column, as_of: date, days: int = 90, near: float = 0.9) -> Column:
    """K4: a donor's launch is unknown or long enough ago, or it is nearly the same."""
    return launch.isNull() | (F.datediff(F.lit(as_of), launch) >= days) | (sim >= near)


def donors(edges: DataFrame, launches: DataFrame, as_of: date) -> DataFrame:
    rows = edges.join(launches.select(F.col("id").alias("other"), F.col("launch").alias("donor_launch")), "other", "left")
    return rows.where(eligible(F.col("donor_launch"), F.col("sim"), as_of)).drop("donor_launch")


def similar_designs(edges: DataFrame, tokens: DataFrame) -> DataFrame:
    """K5: neighbours with the tokens both have, sorted and joined."""
    of = tokens.groupBy("design").agg(F.collect_set("token").alias("t"))
    rows = edges.join(of, "design").join(of.select(F.col("design").alias("other"), F.col("t").alias("u")), "other")
    return rows.select("design", "other", "sim", "rank", F.array_join(F.sort_array(F.array_intersect("t", "u")), ",").alias("shared"))


def borrowed_level(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """K6: id, level: mean level of the donors that have one, weighted by similarity."""
    rows = edges.join(levels.where("level > 0").select(F.col("id").alias("other"), "level"), "other")
    return rows.groupBy(F.col("design").alias("id")).agg((F.sum(F.col("sim") * F.col("level")) / F.sum("sim")).alias("level"))


def since_launch(weekly: DataFrame, launches: DataFrame) -> DataFrame:
    """K8: id, offset (weeks since launch), qty."""
    rows = weekly.join(launches, "id").withColumn("offset", F.floor(F.datediff("week", "launch") / 7).cast("int"))
    return rows.where("offset >= 0").groupBy("id", "offset").agg(F.sum("y").alias("qty"))


def borrowed_curve(edges: DataFrame, offsets: DataFrame, start: int, own: DataFrame, weeks: int = 6) -> DataFrame:
    """K7: id, step, qty: the donors' sales at the same weeks since launch, scaled to the design's own first weeks.

    own: id, early (its mean of weeks 0 to 2).  A donor without early sales isn't scaled.
    """
    early = offsets.where("offset BETWEEN 0 AND 2").groupBy("id").agg(F.avg("qty").alias("donor_early"))
    there = offsets.where(F.col("offset").between(start, start + weeks - 1)).select(F.col("id").alias("other"), (F.col("offset") - start).alias("step"), "qty")
    rows = edges.join(there, "other").join(early.select(F.col("id").alias("other"), "donor_early"), "other", "left").join(own.select(F.col("id").alias("design"), "early"), "design")
    scale = F.when(F.coalesce("donor_early", F.lit(0.0)) > 0, F.col("early") / F.col("donor_early")).otherwise(1.0)
    return rows.groupBy(F.col("design").alias("id"), "step").agg((F.sum(F.col("sim") * F.col("qty") * scale) / F.sum("sim")).alias("qty"))


def confidence(active_weeks: Column, saw_event: Column, tier: Column) -> Column:
    """K9: trust in a design's own history."""
    c = F.least(F.lit(1.0), active_weeks / 13)
    c = F.when(saw_event, c).otherwise(F.least(F.lit(0.5), c))
    return F.when(tier == "T0", F.least(F.lit(0.3), c)).when(tier == "T1", F.least(F.lit(0.6), c)).when(tier == "T2", F.least(F.lit(0.8), c)).otherwise(c)


def cold_start(forecast: DataFrame, curve: DataFrame, trust: DataFrame) -> DataFrame:
    """K9: blends forecast (id, step, qty) with the borrowed curve where there is one; trust: id, confidence."""
    rows = forecast.join(curve.withColumnRenamed("qty", "curve"), ["id", "step"], "left").join(trust, "id", "left")
    c = F.coalesce("confidence", F.lit(1.0))
    return rows.select("id", "step", F.when(F.col("curve").isNotNull(), c * F.col("qty") + (1 - c) * F.col("curve")).otherwise(F.col("qty")).alias("qty"))
