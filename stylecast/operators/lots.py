"""Production lots: what was issued and what came back.  lots: process, lot, design, party, day, qty."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window, functions as F


def reconciled(lots: DataFrame, issue: str, receipt: str, today: date) -> DataFrame:
    """One row a lot, design and party: issued, received, balance, status, days taken, delay bucket."""
    keys = ["lot", "design", "party"]
    out = lots.where(F.col("process") == issue).groupBy(*keys).agg(F.min("day").alias("issued_on"), F.sum("qty").alias("issued"))
    back = lots.where(F.col("process") == receipt).groupBy(*keys).agg(F.max("day").alias("received_on"), F.sum("qty").alias("received"))
    rows = out.join(back, keys, "left").withColumn("received", F.coalesce("received", F.lit(0)))
    balance = F.greatest(F.col("issued") - F.col("received"), F.lit(0))
    rows = rows.withColumn("balance", balance).withColumn("status", F.when(F.col("balance") == 0, "closed").otherwise("open"))
    days = F.greatest(F.datediff(F.when(F.col("status") == "closed", F.col("received_on")).otherwise(F.lit(today)), "issued_on"), F.lit(0))
    rows = rows.withColumn("days", days)
    return rows.withColumn("bucket", F.when(F.col("days") <= 3, "0-3").when(F.col("days") <= 7, "4-7").when(F.col("days") <= 15, "8-15").otherwise("15+"))


def vendors(lots: DataFrame) -> DataFrame:
    """The parties that were issued lots."""
    return lots.select("party").where(F.col("party").isNotNull()).distinct()


def notes_of_vendors(notes: DataFrame, vendors_: DataFrame) -> DataFrame:
    """Debit notes of known vendors."""
    return notes.join(vendors_, "party", "left_semi")


def unmatched_vendors(vendors_: DataFrame, notes: DataFrame) -> DataFrame:
    return vendors_.join(notes.select("party").distinct(), "party", "left_anti")


def worst_open(rows: DataFrame, top: int = 15) -> DataFrame:
    """The open lots with the largest balance for their age; a top report."""
    risk = F.col("balance") * F.col("days")
    ranked = rows.where("status = 'open'").withColumn("risk", risk)
    return ranked.orderBy(F.desc("risk"), F.desc("days"), "lot", "design", "party").limit(top)


def rank_by_party(rows: DataFrame, top: int = 3) -> DataFrame:
    """The oldest open lots of each party."""
    w = Window.partitionBy("party").orderBy(F.desc("days"), F.desc("balance"), "lot", "design")
    return rows.where("status = 'open'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
