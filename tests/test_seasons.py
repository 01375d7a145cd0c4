"""The model of seasons, product cards and the running week on small frames."""

import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from stylecast.operators import design, panel, products, rankings, seasons
from stylecast.operators.model import ATTRIBUTES


def rows_of_sales(styles=12, first=date(1999, 5, 1), days=520):
    """Some units every few days; the last style starts late."""
    out = []
    for k in range(styles):
        for d in range(0 if k < styles - 1 else 300, days, 3 + k % 4):
            out.append((f"S{k:02d}", first + timedelta(days=d), "Amazon" if (d + k) % 3 else "Flipkart", 1 + (d * (k + 1)) % 17))
    return out


@pytest.fixture(scope="module")
def made(spark):
    sales = spark.createDataFrame(rows_of_sales(), "style string, day date, channel string, qty long")
    styles = spark.createDataFrame([(f"S{k:02d}", "Ethnic", f"sub{k % 2}", f"C{k % 3}", None if k == 3 else f"F{k % 2}", "N0", "") for k in range(12)], "style string, category string, sub_category string, colour string, fabric string, neck string, embroidery string")
    prices = spark.createDataFrame([(f"S{k:02d}", float(100 + 10 * k)) for k in range(12)], "style string, price double")
    snap = date(2000, 9, 20)
    over = seasons.occurrences(sales, snap)
    stages = seasons.stages_at_start(sales, rankings.long(styles, rankings.TRACKED), over)
    return sales, styles, prices, over, stages, snap


def test_complete_seasons_only(made):
    over = {(r.season, r.year) for r in made[3].collect()}
    assert over == {("S3", 1999), ("S4", 1999), ("S1", 1999), ("S2", 2000), ("S3", 2000)}


def test_training_rows(made):
    sales, styles, prices, over, stages, _ = made
    rows = seasons.training_rows(sales, styles, prices, over, stages).collect()
    by = {(r.style, r.season, r.year): r for r in rows}
    assert len(rows) == len(by) == 11 * 5 + 2  # the last style begins in S2 2000
    assert sorted({r.price_band for r in rows}) == [0, 1, 2, 3, 4] and by["S00", "S3", 1999].price_band == 0 and by["S11", "S3", 2000].price_band == 4
    assert by["S03", "S4", 1999].fabric == "Unknown" and by["S03", "S4", 1999].embroidery == "Unknown" and by["S03", "S4", 1999].fabric_stage == "none"
    assert by["S00", "S3", 1999].category_stage == "none" and by["S00", "S3", 1999].age_quarters == 0
    assert sum(r.units for r in rows) == sum(q for *_, d, _, q in [(s, d, c, q) for s, d, c, q in rows_of_sales()] if d <= date(2000, 7, 31))
    assert all(r.y == min(float(r.units), r.cap) for r in rows)


def test_stages_know_nothing_of_the_season_itself(made):
    sales, styles, _, over, stages, _ = made
    values = rankings.long(styles, rankings.TRACKED)
    last = over.where("season = 'S2' AND year = 2000")
    before = seasons.stages_at_start(sales.where("day < '2000-02-01'"), values, last)
    assert sorted(map(tuple, before.collect())) == sorted(tuple(r) for r in stages.collect() if (r.season, r.year) == ("S2", 2000))
    alone = rankings.trend_status(design.chunk_frame(sales, date(2000, 1, 31)), values)  # D6 of that day
    assert sorted((r.attribute, r.value, r.stage) for r in alone.collect()) == sorted((r.attribute, r.value, r.stage) for r in before.collect())


def test_no_style_on_both_sides(made):
    sales, styles, prices, over, stages, _ = made
    rows, _ = seasons.vectors(seasons.training_rows(sales, styles, prices, over, stages))
    assert rows.groupBy("style").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    folds = {r.style: r.fold for r in rows.select("style", "fold").distinct().collect()}
    assert set(folds.values()) <= set(range(5)) and len(set(folds.values())) > 1
    fewer = {r.style: r.fold for r in rows.where("style > 'S05'").select("style", "fold").distinct().collect()}
    assert fewer.items() <= folds.items()


def test_settings_by_pooled_error_and_never_one_that_diverges(spark):
    rows = spark.createDataFrame([(f"S{k}", "S1", 2000, float(k % 7), 6.0, k % 5) for k in range(50)], "style string, season string, year int, y double, cap double, fold int")

    def fit(train, setting):
        assert train.select("fold").distinct().count() == 4
        p = {1.0: F.col("y") + 1, 2.0: F.when(F.col("style") == "S7", 1e185).otherwise(F.col("y")), 3.0: F.when(F.col("style") == "S8", F.lit(float("nan"))).otherwise(F.col("y")), 4.0: F.col("y") * 0 + 3}
        return lambda test: test.withColumn("p", p[setting[0]])

    got = {r.power: r for r in seasons.chosen_setting(seasons.out_of_fold(rows, [(k, 0.1) for k in (1.0, 2.0, 3.0, 4.0)], fit)).collect()}
    y = [k % 7 for k in range(50)]
    assert [got[k].sound for k in (1.0, 2.0, 3.0, 4.0)] == [True, False, False, True] and [k for k in got if got[k].chosen] == [1.0]
    assert math.isclose(got[1.0].wape, 50 / sum(y) * 100, abs_tol=1e-5) and math.isclose(got[4.0].wape, sum(abs(v - 3) for v in y) / sum(y) * 100, abs_tol=1e-5)
    means = [sum(y[k] for k in range(50) if k % 5 != f) / 40 for f in range(5)]
    assert math.isclose(got[1.0].baseline_wape, sum(abs(y[k] - means[k % 5]) for k in range(50)) / sum(y) * 100, abs_tol=1e-5)
    assert len(got[1.0].fold_wapes) == 5


def test_no_sound_setting_is_chosen_from_none(spark):
    rows = spark.createDataFrame([(f"S{k}", "S1", 2000, 1.0, 1.0, k % 5) for k in range(10)], "style string, season string, year int, y double, cap double, fold int")
    got = seasons.chosen_setting(seasons.out_of_fold(rows, [(1.0, 0.1)], lambda *_: lambda t: t.withColumn("p", F.lit(1e9)))).collect()
    assert [(r.sound, r.chosen) for r in got] == [(False, False)]


def test_parts_sum_to_the_prediction(made):
    sales, styles, prices, over, stages, _ = made
    training = seasons.training_rows(sales, styles, prices, over, stages).persist()
    rows, labels = seasons.vectors(training)
    rows = rows.persist()
    fit = seasons.fitted(rows, labels, (1.5, 0.1))
    scored = {(r.style, r.season, r.year): r.p for r in seasons.glm(rows, (1.5, 0.1)).transform(rows).collect()}
    parts = seasons.contributions(training, fit)
    names = [f"part_{c}" for c in (*seasons.NUMERIC, *seasons.CATEGORICAL)]
    got = parts.collect()
    assert all(math.isclose(math.exp(r.base + sum(r[c] for c in names)), scored[r.style, r.season, r.year], rel_tol=1e-6) for r in got)
    assert all(abs(sum(r[c] for r in got)) < 1e-6 for c in names)  # on average a feature adds nothing
    on_sale = spark_values(styles)
    assert seasons.attribute_effects(parts, "S3", on_sale).isEmpty()  # under thirty rows
    effects = seasons.attribute_effects(parts.withColumn("season", F.lit("S3")), "S3", on_sale.where("value <> 'C1'")).collect()
    assert {(r.attribute, r.value) for r in effects} >= {("colour", "C0"), ("colour", "C2")} and all(r.value not in ("C1", "Unknown") and r.rows >= 5 for r in effects)


def spark_values(styles):
    return rankings.long(styles, ATTRIBUTES).select("attribute", "value").distinct()


def test_running_week(spark):
    day = date(2001, 8, 3)  # the third of seven days
    sales = [("a", date(2001, 7, 20), "Amazon", 30), ("a", date(2001, 7, 25), "Myntra", 10), ("c", date(2001, 7, 5), "Amazon", 20), ("a", day, "Amazon", 12), ("b", date(2001, 8, 1), "Myntra", 40)]
    sales = spark.createDataFrame(sales, "style string, day date, channel string, qty long")
    stored = spark.createDataFrame([("a", 70.0)], "style string, forecast double")
    rates = spark.createDataFrame([("a", 7.0), ("b", 14.0), ("d", 0.0)], "style string, weekly double")
    factors = spark.createDataFrame([(date(2001, 8, 5), 1.5)], "day date, factor double")
    styles = spark.createDataFrame([("a", "x"), ("b", ""), ("d", "x")], "style string, sub_category string")
    got = {(r.style, r.channel): r.units for r in design.running_projection(sales, stored, rates, factors, styles, day).collect()}
    pace_a, pace_b = 1 + (12 / 30 - 1) * 0.5, 2.0  # b: 40 against 6 is held at the limit
    want = {("a", "Amazon"): 40 * pace_a * 0.75, ("a", "Myntra"): 40 * pace_a * 0.25, ("b", "Amazon"): 2 * 4.5 * pace_b * 50 / 60, ("b", "Myntra"): 2 * 4.5 * pace_b * 10 / 60}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    over = design.running_projection(sales, stored, rates, factors, styles, date(2001, 8, 7))
    assert over.isEmpty()  # no day is left
    new = design.running_projection(sales.limit(0), stored, rates, factors, styles, day).collect()
    assert {(r.style, r.channel) for r in new} == {("a", "All"), ("b", "All")}


def test_projected_units_are_not_selling(spark):
    frame = spark.createDataFrame([("a", 0, "Amazon", 5), ("a", -1, "Amazon", 7)], "style string, offset int, channel string, qty long")
    extra = spark.createDataFrame([("a", "Amazon", 3.0), ("b", "Amazon", 4.0)], "style string, channel string, units double")
    got = {(r.style, r.offset): (r.qty, r.real) for r in design.with_projection(frame, extra).collect()}
    assert got == {("a", 0): (8.0, 5.0), ("a", -1): (7.0, 7.0), ("b", 0): (4.0, 0.0)}


def test_percentile_rank_by_counts(spark):
    values = [3.0, 1.0, None, 2.0, 2.0, 9.0, 2.0, None, *(float(k % 400) for k in range(3000))]
    rows = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    got = {r.id: r.pct for r in panel.percentile_rank(rows, pct="v").collect()}
    known = sorted(v for v in values if v is not None)
    for i, v in enumerate(values):
        want = None if v is None else (sum(x < v for x in known) + (sum(x == v for x in known) + 1) / 2) / len(known) if i < 12 else got[i]
        assert got[i] == want if want is None else math.isclose(got[i], want)
    plan = panel.percentile_rank(rows, pct="v")._jdf.queryExecution().executedPlan().toString()
    assert all("range_" in line for line in plan.split("\n") if "Window [" in line)


def card(spark, **changes):
    base = {"sub_category": "x", "category": "k", "nth": 1, "score": 80, "level": "strong", "now_share": 40.0, "colours": [("C1", "steady", 1.0), ("C2", "trending", 40.0)], "fabrics": [("F1", "steady", 0.0)], "details": [("neck", "N1")]} | changes
    return spark.createDataFrame([tuple(base.values())], "sub_category string, category string, nth int, score int, level string, now_share double, colours array<struct<value string, stage string, trend double>>, fabrics array<struct<value string, stage string, trend double>>, details array<struct<attribute string, value string>>".replace("value string", "value: string").replace("stage string", "stage: string").replace("trend double", "trend: double").replace("attribute string", "attribute: string"))


def test_recommended_styles(spark):
    styles = [("s1", "x", "k", "C1", "F1", "N1"), ("s2", "x", "k", "C2", "F1", "N1"), ("s3", "x", "z", "C1", "F9", None), ("s4", "x", "k", "C9", "F1", "N1"), ("s5", "y", "k", "C1", "F1", "N1"), ("s6", "x", "k", "C1", "F1", "N1")]
    styles = spark.createDataFrame(styles, "style string, sub_category string, category string, colour string, fabric string, neck string")
    expected = spark.createDataFrame([("s1", 10), ("s2", 90), ("s3", 50), ("s4", 70), ("s5", 70), ("s6", 0)], "id string, expected long")
    got = products.recommended_styles(card(spark), styles, expected).orderBy("rank").collect()
    assert [(r.rank, r.style, r.matches, r.suggested) for r in got] == [(1, "s1", 5, 5), (2, "s3", 2, 5), (3, "s2", 5, 5)]  # by colour first; no other colour, sub-category or style without a sale
    assert got[0].fit == 100.0 and got[1].fit == round(100 * 46 / 79, 1) and sorted(got[1].missing) == ["category", "fabric", "neck"]
    assert [r.forecast_score for r in got] == [33.3, 66.7, 100.0] and got[0].design_fit == 94.0
    assert products.recommended_styles(card(spark, colours=None), styles, expected).isEmpty()


def test_overview_weighs_by_share_of_sales(spark):
    two = card(spark).unionByName(card(spark, sub_category="y", nth=2, now_share=60.0, colours=[("C2", "steady", 0.0), ("C3", "steady", 0.0)], fabrics=None))
    row = products.overview(two).first()
    assert row.focus == ["x", "y"] and row.colours == ["C2", "C3", "C1"] and row.fabrics == ["F1"]
