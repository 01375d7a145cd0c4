"""Column functions and operators on small frames (row ids in brackets)."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from stylecast.functions import calendar as cal
from stylecast.functions import keys
from stylecast.operators import analysis, evaluation, festival, joins, panel, planning, state
from stylecast.sources import orders, snapshots
from stylecast.streaming import orders as orders_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("code,design,want", [("474-03_M", "474-03", "474-03-M"), ("005-03-XL-A", "005-03", "005-03-XL"), ("423-03-427-03-L", "423-03", "423-03-L"), ("001-04-2XL", "001-04", "001-04-XXL")])
def test_sku_key(spark, code, design, want):  # [P9]
    assert one(spark, keys.sku_key(F.lit(code), F.lit(design))) == want


@pytest.mark.parametrize("raw,want", [("050-02-XS-A", "050-02"), ("319-01-SHIRT", "319-01"), ("K-108-01", "K-108-01"), (None, None)])
def test_clean_design_no(spark, raw, want):  # [P7]
    assert one(spark, keys.clean_design_no(F.lit(raw).cast("string"))) == want


def test_flat_size_series(spark):  # [P5]
    assert one(spark, keys.design_key(F.lit("6302-L"))) == "6302"
    assert one(spark, keys.design_key(F.lit("nohyphen"))) is None


def test_places_and_brands(spark):  # [P12, P13, P15]
    assert one(spark, keys.norm_place(F.lit(" chennai  600081 "))) == "Chennai"
    assert one(spark, keys.norm_place(F.lit("n/a"))) is None
    assert one(spark, keys.norm_warehouse(F.lit("DEFAULT 1"))) is None
    assert one(spark, keys.norm_brand(F.lit("Colours Of Earth"))) == "C.O.E"
    assert one(spark, keys.norm_brand(F.lit(None).cast("string"))) == ""


def test_season(spark):  # [T7]
    d = F.lit(date(2026, 1, 5))
    assert one(spark, F.concat(cal.season(d), F.lit(" "), cal.season_year(d).cast("string"))) == "S1 2025"


def test_calendar_file(spark, tmp_path):  # [S7]
    (tmp_path / "c.csv").write_text("Name,Start,End\nA (Festival),20-10-2025,24-10-2025\nB (Shop),01-01-2025,\nC (Shop),02-01-2025,03-01-2025\n")
    rows = orders.calendar_csv(spark, str(tmp_path / "c.csv")).collect()
    assert [(r.name, r.category, r.start_date) for r in rows] == [("A (Festival)", "festival", date(2025, 10, 20)), ("C (Shop)", "sale", date(2025, 1, 2))]


def test_materials(spark):  # [S5]
    bom = spark.createDataFrame([("lace", "101-01, 101-02LH,,"), ("lace", "101-01")], "ARTICLE_GROUP string, USED_IN string")
    assert sorted((r.material, r.design) for r in orders.materials(bom, suffixes=("LH",)).collect()) == [("LACE", "101-01"), ("LACE", "101-02")]


def test_wape(spark):  # [M8]
    rows = spark.createDataFrame([(10, 8), (20, 25)], "y int, p int")
    assert rows.agg(evaluation.wape(F.col("y"), F.col("p"))).first()[0] == pytest.approx(23.3333, abs=1e-3)
    assert rows.select((F.col("y") * 0).alias("y"), "p").agg(evaluation.wape(F.col("y"), F.col("p"))).first()[0] == 0


def test_recency(spark):  # [W13]
    rows = spark.createDataFrame([("a", date(2025, 1, 6), 1), ("a", date(2025, 7, 7), 1)], "id string, week date, y int")
    assert [r.weight for r in panel.recency_weights(rows).orderBy("week").collect()] == [0.5, 1.0]


def test_folds_are_in_order(spark):  # [M7]
    weeks = spark.range(60).select(F.expr("date_add(date'2024-01-01', cast(id as int) * 7)").alias("week"))
    rows = panel.rolling_folds(weeks).collect()
    for fold in range(3):
        train = [r.week for r in rows if r.fold == fold and r.role == "train"]
        val = [r.week for r in rows if r.fold == fold and r.role == "val"]
        assert train and val and max(train) < min(val)
    assert max(r.week for r in rows) < date(2024, 1, 1) + (date(2024, 1, 8) - date(2024, 1, 1)) * 51


def test_blend(spark):  # [Q2]
    m, n, f = F.lit(100.0), F.lit(40.0), F.lit(1.5)
    assert one(spark, planning.blended(m, n, f)) == 80
    assert one(spark, planning.blended(F.lit(None).cast("double"), n, f)) == 60
    assert one(spark, planning.blended(m, n, f, both=True)) == 105


def test_run_rate_drops_events_and_spikes(spark):  # [Q1]
    snap = date(2025, 3, 1)
    gross = spark.range(60).select(F.lit("A").alias("id"), F.date_sub(F.lit(snap), F.col("id").cast("int")).alias("day"), F.when(F.col("id") == 5, 500).otherwise(10).alias("qty"))
    events = spark.createDataFrame([(date(2025, 2, 10),)], "day date")
    days = planning.clean_days(gross.groupBy("day").agg(F.sum("qty").alias("units")), events, snap)
    assert days.where("NOT clean").count() == 2
    assert planning.run_rate(gross, days).first().weekly == 70


def test_halves_are_rounded_alike_in_any_order(spark):  # [Q5]
    for parts in ((0.6, 0.7, 0.2), (0.7, 0.6, 0.2), (0.2, 0.7, 0.6)):
        rows = spark.createDataFrame([("a", 0, q) for q in parts], "id string, step int, qty double").coalesce(1)
        assert planning.horizons(planning.by_design(rows)).first().forecast35 == 2


def test_split_adds_up(spark):  # [W11]
    rows = spark.createDataFrame([("s", "a", 3, 1), ("s", "b", 3, 1), ("t", "c", 5, 0), ("t", "d", 5, 0), ("u", "e", 0, 4)], "style string, sku string, total int, w int")
    got = {r.sku: r.units for r in analysis.split_by_share(rows, ["style"], "total", "w", "sku").collect()}
    assert got == {"a": 2, "b": 1, "c": 3, "d": 2, "e": 0}


def test_tier_as_of(spark):  # [J4, J5]
    log = spark.createDataFrame([("a", "T1", date(2024, 1, 1)), ("a", "T2", date(2024, 6, 1)), ("a", "T3", date(2024, 6, 1))], "name string, tier string, effective_from date")
    rows = spark.createDataFrame([("a", date(2023, 1, 1)), ("a", date(2024, 5, 31)), ("a", date(2024, 6, 1)), ("b", date(2024, 6, 1))], "style string, day date")
    assert sorted((r.style, str(r.day), r.tier) for r in joins.tier_as_of(rows, log, "style", "day").collect()) == [("a", "2023-01-01", "Unknown"), ("a", "2024-05-31", "T1"), ("a", "2024-06-01", "T3"), ("b", "2024-06-01", "Unknown")]
    assert {r.tier for r in joins.tier_at_sale(rows, log, "style", "day").collect()} == {"T3", "T1", "Unclassified"}


def test_calibration_finds_an_effect(spark):  # [F3]
    days = spark.range(400).select(F.expr("date_add(date'2024-01-01', cast(id as int))").alias("day"), F.col("id"))
    hit = F.col("id").between(300, 304) | F.col("id").between(350, 354)
    daily = days.select("day", F.when(hit, 200).otherwise(100).alias("units"))
    windows = spark.createDataFrame([("Fair", date(2024, 10, 27), date(2024, 10, 31)), ("Fair", date(2024, 12, 16), date(2024, 12, 20))], "name string, start_date date, end_date date")
    (row,) = festival.calibrated(daily, windows).collect()
    assert row.name == "Fair" and 1.4 < row.multiplier < 2.0


def test_freeze_is_idempotent_and_reopens(spark):  # [G10]
    values = spark.createDataFrame([("A", date(2025, 1, 1), 5.0), ("A", date(2025, 1, 8), 6.0)], "key string, start date, qty double")
    periods = values.select("start").withColumn("end", F.date_add("start", 6))
    once = state.freeze(spark.createDataFrame([], state.FROZEN), values, periods, date(2024, 12, 20))
    later = values.withColumn("qty", F.col("qty") + 1)
    two = state.freeze(once, later, periods, date(2025, 1, 10))
    got = {str(r.start): (r.qty, r.status, r.start_qty) for r in two.collect()}
    assert got == {"2025-01-01": (5.0, "locked", 5.0), "2025-01-08": (7.0, "open", 6.0)}
    again = state.freeze(two, later, periods, date(2025, 1, 10))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, two.collect()))
    earlier = state.freeze(two, later, periods, date(2025, 1, 5))
    assert {r.status for r in earlier.collect()} == {"open"}


def test_snapshots_replace_their_day(spark, tmp_path):  # [S10, S13]
    path = str(tmp_path / "stock")
    rows = spark.createDataFrame([("s1", "a", 5, 1)], "sku string, style string, stock int, wip int")
    snapshots.save_stock(rows, path, date(2025, 1, 1))
    snapshots.save_stock(rows.withColumn("stock", F.lit(9)), path, date(2025, 1, 1))
    snapshots.save_stock(rows, path, date(2025, 1, 2))
    assert not snapshots.save_stock(rows, path, date(2025, 1, 3), complete=False)
    assert sorted((str(r.day), r.stock) for r in snapshots.load_stock(spark, path, style="a").collect()) == [("2025-01-01", 9), ("2025-01-02", 5)]
    fc = spark.createDataFrame([("a", 0, 1.0)], "id string, step int, qty double")
    snapshots.save_forecast(fc, str(tmp_path / "fc"), "style", 3, date(2025, 1, 1))
    assert snapshots.load_forecast(spark, str(tmp_path / "fc"), "style", 3, date(2025, 1, 1)).count() == 1


def test_health_rules(spark):  # [E7]
    today = date(2025, 3, 1)
    quiet = [(today - timedelta(days=k), 100) for k in range(1, 92)]
    tables = {
        "daily": (quiet, "day date, units long"), "event_days": ([], "day date"), "factors": ([], "day date, factor double"), "log": ([], "week_start date, status string, forecast long, actual long"),
        "sold": ([(today, "a", "Kurta", 5)], "day date, style string, sub_category string, qty long"), "loads": ([("sales", 1000, 996), ("stock", 5, 5)], "part string, expected long, got long"),
    }

    def fired(day=today, **changed):
        frames = {k: spark.createDataFrame(changed.get(k, rows), schema) for k, (rows, schema) in tables.items()}
        return [(r.severity, r.rule, r.n) for r in evaluation.health(**frames, today=day).collect()]

    assert fired() == []
    loud = [(d, 100 if k != 3 else 500) for k, (d, _) in enumerate(quiet)]
    assert fired(daily=loud) == [("warning", "calendar_missing_event", 1), ("warning", "runrate_spike", 1)]
    assert fired(daily=loud, event_days=[(loud[3][0],)]) == [("warning", "runrate_spike", 1)]
    assert fired(today + timedelta(days=4)) == [("warning", "data_stale", 5)]
    assert fired(factors=[(d, 1.5) for d, _ in quiet[:7]]) == [("warning", "calendar_event_not_seen", 7)]
    assert fired(log=[(date(2025, 2, 3), "completed", 10, 100), (date(2025, 2, 10), "completed", 95, 100)]) == []
    assert fired(log=[(date(2025, 2, 10), "completed", 10, 100), (date(2025, 2, 17), "open", 10, 100)]) == [("warning", "accuracy_low", 100)]
    assert fired(sold=[(today, "a", "", 5), (today - timedelta(days=80), "b", None, 9)], loads=[("sales", 1000, 900), ("wip", 5, 0), ("master", 7, 0)]) == [("error", "erp_stock_missing", 1), ("error", "sales_incomplete", 1), ("warning", "erp_master_missing", 1), ("info", "master_missing", 1)]


def test_running_week_holds_over_several_micro_batches(spark, tmp_path):
    source = str(tmp_path / "lines")
    for i, rows in enumerate([[(1, "2024-01-18 09:00:00", 2), (1, "2024-01-22 10:00:00", 3)], [(1, "2024-01-22 12:00:00", 4), (2, "2024-01-23 10:00:00", 5)], [(1, "2024-01-24 08:00:00", 1)]]):
        spark.createDataFrame(rows, "id long, t string, qty long").select("id", F.col("t").cast("timestamp").alias("ts"), "qty").coalesce(1).write.mode("append").parquet(f"{source}/part={i}")
    lines = spark.readStream.schema("id long, ts timestamp, qty long, part int").option("maxFilesPerTrigger", 1).parquet(source)
    seen = []

    def sink(week, batch_id):
        seen.append({r["id"]: (r["so_far"], round(r["pace"] * 7)) for r in week.collect()})

    run = orders_stream.each_batch(spark.createDataFrame([(1, 7)], "id long, qty long"), date(2024, 1, 24), str(tmp_path / "days"), sink)
    q = orders_stream.units_by_day(lines).writeStream.foreachBatch(run).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) >= 3
    assert seen[-1] == {1: (8, 10), 2: (5, 5)}
