"""Connected components of a table of links, by propagating the smallest id and jumping along it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import kept


def components(links: DataFrame) -> DataFrame:
    """links: a, b (either order).  One row for each linked id: id, component (the smallest id that can be reached).

    Each round takes the smallest component of an id's neighbours and then that id's own
    component, so that chains shrink by halves; a hub's links are combined before they are
    shuffled.  Rounds end when nothing changes.
    """
    both = kept(links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*").where(F.col("a") != F.col("b")).distinct())
    state = kept(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("component")))
    while True:
        near = both.join(state.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = state.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("component", "near").alias("next"), "component")
        up = state.select(F.col("id").alias("next"), F.col("component").alias("up"))
        step = kept(step.join(up, "next").select("id", "component", F.least("next", "up").alias("next")))
        if step.where(F.col("next") != F.col("component")).isEmpty():
            return state
        state = step.select("id", F.col("next").alias("component"))
