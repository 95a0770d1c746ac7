import math
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions.series import change_points, stl, stl_many
from tidemark.operators.series import daily, false_alarms, jaccard, onsets, persistence, placebo, price_volume_mix, robust_z, spearman
from tidemark.plans.contract import Materiality
from pyspark.sql import functions as F


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_robust_z(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([2, 4, 4, 4, 5, 5, 7, 9])] + [("b", i, 3.0) for i in range(4)] + [("c", i, float(v)) for i, v in enumerate([1, 1, 1, 1, 9])], "k string, period int, value double")
    z = {(r.k, r.period): r.z for r in robust_z(df, ["k"]).collect()}
    assert math.isclose(z["a", 7], 6.070417, abs_tol=1e-6) and z["b", 0] == 0.0
    assert math.isclose(z["c", 4], 8 / (1.2533 * 8 / 5), abs_tol=1e-9)


def test_persistence(spark):
    runs = {"up": [0, 2, 2, 4], "short": [0, 2, -2, 4], "low": [9, 9, 9, 3], "all": [2, 4, 5, 6], "down": [-2, -1.1, -1.5, -3.5]}
    df = spark.createDataFrame([(k, i, float(z)) for k, v in runs.items() for i, z in enumerate(v)], "k string, period int, z double")
    assert {r.k: r.run for r in persistence(df, ["k"]).collect()} == {"up": 3, "short": 1, "low": 0, "all": 4, "down": 4}


def test_price_volume_mix(spark):
    df = spark.createDataFrame([("a", 10.0, 5.0, 12.0, 6.0)], "item string, q0 double, p0 double, q1 double, p1 double")
    r = one(price_volume_mix(df))
    assert (r.price, r.volume, r.mix, r.residual) == (10, 10, 2, 0)
    new = spark.createDataFrame([("a", None, None, 12.0, 6.0), ("b", 3.0, 2.0, None, None)], "item string, q0 double, p0 double, q1 double, p1 double")
    r = one(price_volume_mix(new))
    assert (r.price, r.volume, r.mix, r.total, r.residual) == (0, 66, 0, 66, 0)


def test_spearman(spark):
    rows = [("a", x, y) for x, y in zip([1, 2, 3, 4, 5], [1, 3, 2, 4, 5])] + [("few", i, i) for i in range(4)] + [("flat", i, 1) for i in range(6)] + [("down", i, -i) for i in range(6)]
    out = {r.k: r for r in spearman(spark.createDataFrame(rows, "k string, x int, y int"), ["k"], "x", "y").collect()}
    assert math.isclose(out["a"].rho, 0.9) and out["a"].outcome == "pass"
    assert out["few"].outcome == out["flat"].outcome == "inconclusive" and out["few"].rho is None and out["down"].outcome == "refute"


def test_placebo(spark):
    treated = [(-30.0,), (-35.0,), (-35.0,)]
    controls = [0.0, 1.0, -1.0, 0.5, -0.5, 0.0]
    df = spark.createDataFrame([(i, 100.0, 100.0 + d, True) for i, (d,) in enumerate(treated)] + [(10 + i, 50.0, 50.0 + d, False) for i, d in enumerate(controls)], "unit int, pre double, post double, treated boolean")
    r = one(placebo(df))
    assert math.isclose(r.effect, -100 / 3) and (r.controls, r.rank, r.outcome) == (6, 1, "pass") and math.isclose(r.pseudo_p, 1 / 7)
    few = one(placebo(df.where("treated OR unit < 13")))
    assert (few.rank, few.outcome, few.pseudo_p) == (0, "inconclusive", None)


def test_jaccard(spark):
    r = one(spark.range(1).select(jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))).alias("a"), jaccard(F.expr("cast(array() as array<int>)"), F.expr("cast(array() as array<int>)")).alias("b")))
    assert math.isclose(r.a, 1 / 3) and r.b is None


def test_stl_adds_up_and_finds_the_season():
    t = np.arange(60)
    season = 5 * np.sin(2 * np.pi * t / 12)
    y = 100 + 0.5 * t + season
    y[40] += 30
    trend, seasonal, rest = stl(y)
    assert np.allclose(trend + seasonal + rest, y) and np.abs(seasonal - season).max() < 0.6 and rest[40] > 25 and np.median(np.abs(rest)) < 0.3
    with pytest.raises(ValueError):
        stl(y[:23])
    with pytest.raises(ValueError):
        stl(y, 1)


@pytest.mark.parametrize("n, period", [(36, 12), (24, 12), (37, 12), (60, 12), (29, 7)])
def test_stl_of_many_is_that_of_each(n, period):
    rng = np.random.default_rng(n)
    y = 100 + 10 * np.sin(2 * np.pi * np.arange(n) / period) + rng.normal(0, 2, (40, n))
    y[5, n // 2] += 50
    y[6], y[7], y[8, ::3], y[9] = 3.0, 0.0, 0.0, rng.integers(0, 2, n)
    for got, want in zip(stl_many(y, period), zip(*(stl(row, period) for row in y))):
        assert np.allclose(got, np.array(want), atol=1e-9)
    assert all(part.shape == (0, n) for part in stl_many(y[:0], period))
    with pytest.raises(ValueError):
        stl_many(y[:, : 2 * period - 1], period)


def alarm(trial, months, noise, season, rules, seed):
    t = np.arange(months)
    y = 100 * (1 + season * np.sin(2 * np.pi * t / 12)) + np.random.default_rng([seed, trial]).normal(0, noise * 100, months)
    r = stl(y)[2]
    z = (r - np.median(r)) / (1.4826 * np.median(np.abs(r - np.median(r))))
    run = 0
    while run < months and abs(z[-1]) > rules.z_threshold and abs(z[-1 - run]) > 1 and z[-1 - run] * z[-1] > 0:
        run += 1
    return run >= rules.min_persistence and abs(y[-1] / y[-2] - 1) >= rules.relative and abs(y[-1] - y[-2]) >= rules.absolute


def test_false_alarms_are_those_of_each_series(spark):
    for rules in (Materiality(0.0, 0.0, 1, 1.0), Materiality(0.01, 1.0, 2, 1.5)):
        r = one(false_alarms(spark.range(200), 36, 0.02, 0.1, rules, 3))
        assert r.trials == 200 and 0 < r.rate and math.isclose(r.rate, sum(alarm(i, 36, 0.02, 0.1, rules, 3) for i in range(200)) / 200)


def test_false_alarms_of_many_series_take_seconds(spark):
    start = time.monotonic()
    r = one(false_alarms(spark.range(30_000), 36, 0.02, 0.1, Materiality(0.03, 1.0)))
    assert r.trials == 30_000 and time.monotonic() - start < 60  # one at a time: some minutes


def best_by_trying(y, least, penalty):
    cost = lambda a, b: ((y[a:b] - y[a:b].mean()) ** 2).sum()
    best = {0: (-penalty, [])}
    for end in range(least, len(y) + 1):
        best[end] = min(((best[s][0] + cost(s, end) + penalty, best[s][1] + [s]) for s in best if end - s >= least), key=lambda x: x[0])
    return best[len(y)][0]


@settings(max_examples=60, deadline=None, derandomize=True)
@given(st.lists(st.integers(0, 9), min_size=8, max_size=40))
def test_change_points_are_the_best_split(values):
    y = np.array(values, float)
    penalty = 2 * np.log(len(y)) * (y.var() or 1.0)
    cuts = [0, *change_points(y), len(y)]
    cost = sum(((y[a:b] - y[a:b].mean()) ** 2).sum() for a, b in zip(cuts, cuts[1:])) + penalty * (len(cuts) - 2)
    assert all(b - a >= 4 for a, b in zip(cuts, cuts[1:])) and math.isclose(cost, best_by_trying(y, 4, penalty), abs_tol=1e-6)


def test_onsets_of_daily_counts(spark):
    rng = random.Random(0)
    rows = [("a", f"2024-01-{d:02d} 10:00:00") for d in range(1, 32) for _ in range(2 if d < 12 else 9)] + [("b", f"2024-01-{rng.randint(1, 31):02d} 08:00:00") for _ in range(3)]
    e = spark.createDataFrame(rows, "k string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    days = daily(e, ["k"], "at", "2024-01-01", "2024-01-31")
    assert days.count() == 62 and days.where("k = 'b'").agg(F.sum("n")).first()[0] == 3
    assert str({r.k: r.onset for r in onsets(days, ["k"]).collect()}["a"]) == "2024-01-12"
    assert change_points(np.zeros(7)) == [] and change_points(np.ones(40)) == []
