"""Queries: production lots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lots
from ..registry import query
from .fixtures import TODAY, VIEWS, view

ISSUE, RECEIPT = "Cut to Pack Issue", "Cut To Pack Dispatch"
VIEWS["recon_v"] = f"""SELECT *, CASE WHEN days <= 3 THEN '0-3' WHEN days <= 7 THEN '4-7' WHEN days <= 15 THEN '8-15' ELSE '15+' END AS bucket FROM (SELECT *, CAST(greatest((CASE WHEN status = 'closed' THEN received_on ELSE DATE '2001-08-01' END) - issued_on, 0) AS INT) AS days FROM (SELECT *, CASE WHEN balance = 0 THEN 'closed' ELSE 'open' END AS status FROM (
 SELECT i.*, received_on, coalesce(received, 0) AS received, greatest(issued - coalesce(received, 0), 0) AS balance FROM (SELECT LOT_NO AS lot, DESIGN_NO AS design, PARTY_NAME AS party, min(VOUCHER_DATE) AS issued_on, CAST(sum(ISSUE_QTY) AS BIGINT) AS issued FROM lots_v WHERE PROCESS = '{ISSUE}' GROUP BY ALL) i
 LEFT JOIN (SELECT LOT_NO AS lot, DESIGN_NO AS design, PARTY_NAME AS party, max(VOUCHER_DATE) AS received_on, CAST(sum(ISSUE_QTY) AS BIGINT) AS received FROM lots_v WHERE PROCESS = '{RECEIPT}' GROUP BY ALL) r USING (lot, design, party))))"""


def _lots(spark, sf):
    return view(spark, sf, "lots_v").select(F.col("PROCESS").alias("process"), F.col("LOT_NO").alias("lot"), F.col("DESIGN_NO").alias("design"), F.col("PARTY_NAME").alias("party"), F.col("VOUCHER_DATE").alias("day"), F.col("ISSUE_QTY").alias("qty"))


def _recon(spark, sf):
    return lots.reconciled(_lots(spark, sf), ISSUE, RECEIPT, TODAY)


@query("n1_reconciliation", "SELECT lot, design, party, issued_on, issued, received_on, received, balance, status FROM recon_v")
def n1(spark, sf):
    return _recon(spark, sf).drop("days", "bucket")


@query("n2_delay_buckets", "SELECT status, bucket, count(*) AS n_lots, CAST(sum(days) AS BIGINT) AS days FROM recon_v GROUP BY ALL")
def n2(spark, sf):
    return _recon(spark, sf).groupBy("status", "bucket").agg(F.count(F.lit(1)).alias("n_lots"), F.sum("days").alias("days"))


@query("n3_vendor_notes", "SELECT party, count(*) AS n_notes, CAST(sum(qty) AS BIGINT) AS qty FROM (SELECT PARTY_NAME AS party, ISSUE_QTY AS qty FROM lots_v WHERE PROCESS = 'Cut To Pack Dispatch' AND ISSUE_QTY > 45) WHERE party IN (SELECT PARTY_NAME FROM lots_v WHERE VOUCHER_DATE >= DATE '2001-01-01') GROUP BY party")
def n3(spark, sf):
    rows = _lots(spark, sf)
    notes = rows.where((F.col("process") == RECEIPT) & (F.col("qty") > 45)).select("party", "qty")
    known = lots.vendors(rows.where(F.col("day") >= "2001-01-01"))
    return lots.notes_of_vendors(notes, known).groupBy("party").agg(F.count(F.lit(1)).alias("n_notes"), F.sum("qty").alias("qty"))


@query("n3_unmatched_vendors", "SELECT DISTINCT PARTY_NAME AS party FROM lots_v WHERE PARTY_NAME NOT IN (SELECT PARTY_NAME FROM lots_v WHERE PROCESS = 'Cut To Pack Dispatch' AND ISSUE_QTY > 49 AND VOUCHER_DATE >= DATE '2001-06-01')")
def n3_unmatched(spark, sf):
    rows = _lots(spark, sf)
    return lots.unmatched_vendors(lots.vendors(rows), rows.where((F.col("process") == RECEIPT) & (F.col("qty") > 49) & (F.col("day") >= "2001-06-01")))


@query("n4_worst_open_lots", "SELECT lot, design, party, balance, days, balance * days AS risk FROM recon_v WHERE status = 'open' ORDER BY risk DESC, days DESC, lot, design, party LIMIT 15")
def n4(spark, sf):
    return lots.worst_open(_recon(spark, sf)).select("lot", "design", "party", "balance", "days", "risk")
