"""The forecast model on small frames: the recursion against loops, the fit against Spark's own scoring."""

import math
import random
import statistics
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from stylecast.operators import model

FIRST, LAST = date(2001, 1, 1), date(2001, 7, 30)
WEIGHTS = {"lag_1": 0.3, "lag_52": 0.1, "rolling_mean_8": 0.2, "rolling_std_4": 0.05, "rolling_max_4": 0.02, "sales_diff_1": -0.01, "rolling_mean_ratio": 0.03, "coefficient_variation": -0.04, "avg_weekly_sales": 0.1, "zero_sales_ratio": -0.2, "age_weeks": 0.01, "factor": 0.5}
FIT = model.Model(-0.2, WEIGHTS, {"category": {"Ethnic": 0.1}, "event": {"Sale": 0.4}, "month": {"8": 0.05}})


def flat(x):
    return 0.0 if x is None else math.copysign(math.log1p(abs(x)), x)


def looped(h, factor_of, category, launch, horizon):
    """The recursion in plain loops; h: the weeks of an id, the newest last."""
    h, out = [float(v) for v in h], []
    for k in range(1, horizon + 1):
        week = LAST + timedelta(weeks=k)
        lag = lambda n: h[-n] if n <= len(h) else None  # noqa: B023, E731
        m4, s4 = statistics.mean(h[-4:]), statistics.stdev(h[-4:]) if len(h) > 1 else None
        x = {"lag_1": lag(1), "lag_52": lag(52), "rolling_mean_8": statistics.mean(h[-8:]), "rolling_std_4": s4, "rolling_max_4": max(h[-4:]), "sales_diff_1": lag(1) - lag(2) if len(h) > 1 else None, "rolling_mean_ratio": lag(1) / m4 if m4 else 0.0,
             "coefficient_variation": (s4 / m4 if s4 is not None else None) if m4 else 0.0, "avg_weekly_sales": statistics.mean(h), "zero_sales_ratio": sum(v == 0 for v in h) / len(h), "age_weeks": -1 if launch is None else max(0, (week - launch).days // 7), "factor": factor_of(week)}
        q = -0.2 + sum(w * flat(x[c]) for c, w in WEIGHTS.items()) + (0.1 if category == "Ethnic" else 0) + (0.4 if factor_of(week) > 1 else 0) + (0.05 if week.month == 8 else 0)
        out.append(math.exp(q))
        h.append(out[-1])
    return out


def test_recursive_forecast_equals_loops(spark):  # [M11]
    r = random.Random(5)
    series = {"A": [r.randrange(9) for _ in range(31)], "B": [0, 3, 0, 5], "C": [2]}
    weekly = [(i, LAST - timedelta(weeks=len(ys) - 1 - k), y) for i, ys in series.items() for k, y in enumerate(ys)]
    statics = [("A", "Ethnic", date(2000, 12, 4)), ("B", "Western", None)]  # of C nothing is known
    static = spark.createDataFrame(statics, "id string, category string, launch date").select("*", *(F.lit(None).cast("string").alias(c) for c in (*model.ATTRIBUTES[1:], "tier")), *(F.lit(None).cast("double").alias(c) for c in ("design_level", "launch_drr")))
    factor_of = lambda w: 1.3 if w.month == 9 else 1.0
    coming = [(w, factor_of(w), "Sale" if factor_of(w) > 1 else None, 10) for w in (LAST + timedelta(weeks=k) for k in range(-1, 60))]
    signals = spark.createDataFrame(coming, "week date, factor double, event string, days_to_peak int")
    got = model.recursive_forecast(spark.createDataFrame(weekly, "id string, week date, y long"), static, signals, FIT, LAST, 40).collect()
    assert len(got) == 3 * 40
    known = {i: (c, launch) for i, c, launch in statics}
    for i, ys in series.items():
        want = looped(ys, factor_of, *known.get(i, ("Unclassified", None)), 40)
        mine = sorted((g["step"], g["week"], g["qty"]) for g in got if g["id"] == i)
        assert [g[1] for g in mine] == [LAST + timedelta(weeks=k) for k in range(1, 41)]
        assert [g[2] for g in mine] == pytest.approx(want, abs=2e-3)


def test_no_rows_give_no_forecast(spark):
    static = spark.createDataFrame([], "id string, launch date").select("*", *(F.lit(None).cast("string").alias(c) for c in (*model.ATTRIBUTES, "tier")), *(F.lit(None).cast("double").alias(c) for c in ("design_level", "launch_drr")))
    signals = spark.createDataFrame([(LAST + timedelta(weeks=1), 1.0, None, 1)], "week date, factor double, event string, days_to_peak int")
    assert model.recursive_forecast(spark.createDataFrame([], "id string, week date, y long"), static, signals, FIT, LAST).count() == 0


def test_fit_beats_the_mean_and_is_scored_as_fitted(spark):  # [M9, M13]
    r = random.Random(7)
    rows = []
    for i in range(12):
        for k in range(40):
            rows.append((f"s{i}", FIRST + timedelta(weeks=k), r.choice((0, 1, 2)) + (9 if i % 2 else 1), float(9 if i % 2 else 1), "X" if i % 2 else "Y"))
    df = spark.createDataFrame(rows, "id string, week date, y long, rolling_mean_4 double, category string")
    others = [c for c in model.NUMERIC if c not in df.columns]
    df = df.select("*", *(F.lit(0.0).alias(c) for c in others), *(F.lit("u").alias(c) for c in model.CATEGORICAL if c != "category"))
    made = model.design(df)
    fit = model.fitted(made.rows, made.labels, 1.3, 0.001)
    assert set(fit.levels["category"]) == {"X", "Y"}
    scored = model.predicted(df, fit).groupBy("category").agg(F.avg("qty").alias("q"), F.avg("y").alias("y")).collect()
    assert all(abs(s["q"] - s["y"]) < 0.3 for s in scored)
    shares = {x["feature"]: x["importance"] for x in model.importances(made, fit).collect()}
    assert sum(shares.values()) == pytest.approx(1) and shares["category"] + shares["rolling_mean_4"] > 0.99
