import random
from collections import defaultdict
from statistics import median

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranks as module
from tidemark.operators.ranks import at_ranks, mean_ranks, median_selected
from tidemark.operators.series import peer_expectation, spearman
from tidemark.plans.contract import Materiality


def _rows(seed=1):
    rng = random.Random(seed)
    rows = [("hot", round(rng.gauss(0, 1), 2)) for _ in range(3_000)] + [("tie", 5.0)] * 400 + [("one", 1e300)] + [(None, -1e-300), (None, 0.0), (None, None), ("none", None)]
    return rows + [("wide", rng.choice([-1, 1]) * 10.0 ** rng.randint(-200, 200)) for _ in range(500)]


def _groups(rows):
    out = defaultdict(list)
    for g, v in rows:
        if v is not None:
            out[g].append(v)
    return out


@pytest.mark.parametrize("limit", [50_000, 40, 3])
def test_medians_are_those_of_sorted_values(spark, limit):
    rows = _rows()
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.n, r.median) for r in median_selected(df, ["g"], "v", limit).collect()}
    assert got == {g: (len(v), median(v)) for g, v in _groups(rows).items()}


@pytest.mark.parametrize("limit", [50_000, 40])
def test_values_at_places(spark, limit):
    rows = _rows(2)
    df = spark.createDataFrame(rows, "g string, v double")
    places = lambda n: {"first": F.lit(1), "third": F.ceil(n / 3), "last": n, "over": n + 1}
    got = {r.g: (r.first, r.third, r.last, r.over) for r in at_ranks(df, ["g"], "v", places, limit).collect()}
    assert got == {g: (min(v), sorted(v)[-(-len(v) // 3) - 1], max(v), None) for g, v in _groups(rows).items()}
    assert at_ranks(df, [], "v", places, limit).first().n == sum(map(len, _groups(rows).values()))
    assert at_ranks(df.where("false"), ["g"], "v", places, limit).count() == 0


def test_mean_ranks_over_files(spark):
    rows = _rows(3)
    got = {(r.g, r.v): (r.rank, r.n) for r in mean_ranks(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    want = {}
    for g, values in _groups(rows).items():
        for v in set(values):
            n, less = values.count(v), sum(x < v for x in values)
            want[g, v] = (less + (n + 1) / 2, n)
    assert got == want


def test_ranges_rank_as_windows_do(spark):
    rng = random.Random(4)
    rows = [("hot", rng.randint(0, 50) / 7, rng.gauss(0, 1)) for _ in range(2_000)] + [("few", 1.0, 2.0)] * 3 + [(None, i / 1.0, -i / 1.0) for i in range(20)] + [("flat", 1.0, i / 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    both = [sorted((str(r.g), r.n, None if r.rho is None else round(r.rho, 9), r.outcome) for r in spearman(df, ["g"], "x", "y", most).collect()) for most in (10**9, 0)]
    assert both[0] == both[1] and ("None", 20, -1.0, "refute") in both[0]
    plan = spearman(df, ["g"], "x", "y", 0)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    assert windows and all("_file" in x for x in windows)  # within a file, or over a row a file


def test_leave_one_out_medians_gather_nothing(spark, monkeypatch):
    rng = random.Random(5)
    rows = [("k", f"s{i}", "2024-01", 100.0, rng.choice([1.0, 2.0, rng.gauss(0, 9)])) for i in range(301)] + [("j", f"s{i}", "2024-01", 100.0, float(i)) for i in range(2)] + [("l", "s", "2024-01", 100.0, 1.0)]
    df = spark.createDataFrame(rows, "kpi string, slice string, period string, previous double, relative double").withColumns({"value": F.col("previous") * (1 + F.col("relative")), "delta": F.col("previous") * F.col("relative"), "status": F.lit("ok")})
    monkeypatch.setattr(module, "LIMIT", 20)
    out = peer_expectation(df, "slice", "2024-01", Materiality(0.1, 1.0), ["kpi"])
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for kpi in "kj":
        mine = [r for r in rows if r[0] == kpi]
        for i, r in enumerate(mine):
            want[kpi, r[1]] = 100.0 * (1 + median(x[4] for j, x in enumerate(mine) if j != i))
    got = {(r.kpi, r.slice): r.expected for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
