"""Tests of a candidate cause: timing, locality, dose and control, for all causes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.series import placebo, spearman

TESTS = ("timing", "locality", "dose", "control")
#: Overlap from above which a cause is where the effect is, and below which it is not.
LOCAL, ELSEWHERE = 0.5, 0.2


def timing(causes: DataFrame, effects: DataFrame) -> DataFrame:
    """driver, n, worst_lag, outcome. causes: driver, onset, max_lag_days; effects: driver, account_id, effect_on.

    A lag under 0 or over the longest refutes; no onset or no effect decides nothing. The worst lag is the one
    farthest outside the window.
    """
    lag = F.datediff("effect_on", "onset")
    outside = F.when(lag < 0, -lag).otherwise(F.greatest(lag - F.col("max_lag_days"), F.lit(0)))
    joined = causes.join(effects, "driver", "left").withColumn("lag", lag).withColumn("outside", outside)
    out = joined.groupBy("driver").agg(F.count("lag").alias("n"), F.max_by("lag", F.struct("outside", "lag")).alias("worst_lag"), F.max("outside").alias("_out"))
    return out.select("driver", "n", F.when(F.col("n") > 0, F.col("worst_lag")).alias("worst_lag"), F.when(F.col("n") == 0, "inconclusive").when(F.col("_out") > 0, "refute").otherwise("pass").alias("outcome"))


def locality(causes: DataFrame, effect: DataFrame) -> DataFrame:
    """driver, overlap, outcome: Jaccard of the cause's and the effect's accounts. causes: driver, account_id (null: looked, none found).

    A driver without a row has no known footprint and isn't in the result: unknown is not empty. Counts come
    from one join, so no set is gathered in one place.
    """
    hit = causes.join(effect.select("account_id").distinct().withColumn("_e", F.lit(1)), "account_id", "left")
    n = effect.agg(F.count_distinct("account_id").alias("n_effect"))
    out = hit.groupBy("driver").agg(F.count_distinct("account_id").alias("n_cause"), F.count_distinct(F.when(F.col("_e") == 1, F.col("account_id"))).alias("n_both")).crossJoin(F.broadcast(n))  # one row
    j = F.try_divide(F.col("n_both").cast("double"), F.nullif((F.col("n_cause") + F.col("n_effect") - F.col("n_both")).cast("double"), F.lit(0.0)))
    outcome = F.when(j > LOCAL, "pass").when(j < ELSEWHERE, "refute").otherwise("inconclusive")
    return out.select("driver", "n_cause", "n_effect", j.alias("overlap"), outcome.alias("outcome"))


def dose(intensities: DataFrame, magnitudes: DataFrame) -> DataFrame:
    """driver, n, rho, outcome over the accounts that have both. intensities: driver, account_id, intensity; magnitudes: account_id, delta."""
    return spearman(intensities.join(magnitudes, "account_id"), ["driver"], "intensity", "delta")


def peers(accounts: DataFrame, footprint: DataFrame) -> DataFrame:
    """Accounts of the same region and segment as one of the footprint, without those of the footprint."""
    places = accounts.join(footprint.select("account_id"), "account_id", "left_semi").select("region", "segment").distinct()
    return accounts.join(places, ["region", "segment"], "left_semi").join(footprint.select("account_id"), "account_id", "left_anti")


def region_peers(accounts: DataFrame, footprint: DataFrame) -> DataFrame:
    """All accounts of the footprint's regions."""
    regions = accounts.join(footprint.select("account_id"), "account_id", "left_semi").select("region").distinct()
    return accounts.join(regions, "region", "left_semi")


def control(values: DataFrame, accounts: DataFrame, footprint: DataFrame) -> DataFrame:
    """effect, controls, rank, pseudo_p, outcome: the footprint's accounts against their peers. values: account_id, pre, post."""
    treated = values.join(footprint.select("account_id"), "account_id", "left_semi").withColumn("treated", F.lit(True))
    others = values.join(peers(accounts, footprint).select("account_id"), "account_id", "left_semi").withColumn("treated", F.lit(False))
    return placebo(treated.unionByName(others))


def matrix(results: dict[str, DataFrame], drivers: DataFrame, shared_control: DataFrame) -> DataFrame:
    """driver and the outcome of each test, inconclusive where there is none; the control is one row for all."""
    out = drivers.select("driver")
    for name in ("timing", "locality", "dose"):
        df = results[name].select("driver", F.col("outcome").alias(name))
        out = out.join(df, "driver", "left")
    out = out.crossJoin(F.broadcast(shared_control.select(F.col("outcome").alias("control")).limit(1)))  # one row
    return out.select("driver", *(F.coalesce(t, F.lit("inconclusive")).alias(t) for t in TESTS))


def as_evidence(matrix_: DataFrame, coverage: float = 0.0) -> DataFrame:
    """id, driver, test, outcome, supports, contradicts, method, coverage: an item for each test of each driver."""
    each = matrix_.select("driver", F.inline(F.array(*(F.struct(F.lit(t).alias("test"), F.col(t).alias("result")) for t in TESTS))))
    refuted = F.col("result") == "refute"
    return each.select(
        F.concat(F.lit("ev-"), "driver", F.lit("-"), "test", F.lit("-001")).alias("id"),
        "driver",
        "test",
        F.when(F.col("result") == "inconclusive", "uncheckable").otherwise("found").alias("outcome"),
        F.when(~refuted, F.col("driver")).alias("supports"),
        F.when(refuted, F.col("driver")).alias("contradicts"),
        F.when(F.col("test") == "control", "did").otherwise("stat_test").alias("method"),
        F.when(F.col("result") == "inconclusive", F.lit(coverage)).alias("coverage"),
    )
