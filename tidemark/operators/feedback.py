"""What reviewers' marks teach: priors of causes, depth, order and the materiality gate."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.contract import Contract, Driver, Materiality

# Kinds of marks with their steps, and how marks of "not material" widen the gate.
STEPS = {"correct_driver": 1.0, "wrong_driver": -1.0}
KINDS = (*STEPS, "not_material", "missed_cause")
UNMODELLED = "unmodelled"
PROBE_ONLY, RELATIVE_STEP, ABSOLUTE_FACTOR, MOST_STEPS = -2.0, 0.01, 1.05, 10


def invalid(marks: DataFrame) -> DataFrame:
    """Marks of an unknown kind, or without the cause that their kind is about."""
    return marks.where(~F.col("kind").isin(*KINDS) | (F.col("kind").isin(*STEPS) & F.col("driver").isNull()) | ((F.col("kind") == "missed_cause") & F.col("new_driver").isNull()))


def priors(marks: DataFrame) -> DataFrame:
    """kpi, driver, segment, prior and depth: a sum over the log of marks; two wrong ones more than right leave only probes."""
    step = F.try_element_at(F.create_map(*(x for k, v in STEPS.items() for x in (F.lit(k), F.lit(v)))), F.col("kind"))
    out = marks.where(F.col("kind").isin(*STEPS)).groupBy("kpi", "driver", "segment").agg(F.sum(step).alias("prior"))
    return out.withColumn("depth", F.when(F.col("prior") <= PROBE_ONLY, "probe_only").otherwise("full"))


def reordered(hypotheses: DataFrame, prior: DataFrame) -> DataFrame:
    """Adds prior and place: by prior, the highest first, then by priority. hypotheses: kpi, segment, driver, priority. Nothing is left out."""
    from pyspark.sql import Window

    out = hypotheses.join(prior.select("kpi", "driver", "segment", "prior"), ["kpi", "driver", "segment"], "left").withColumn("prior", F.coalesce("prior", F.lit(0.0)))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("kpi", "segment").orderBy(F.desc("prior"), "priority", "driver")))


def gates(marks: DataFrame, base: DataFrame) -> DataFrame:
    """kpi, relative, absolute: the base gates of each KPI, wider with each mark of "not material", up to ten."""
    n = marks.where("kind = 'not_material'").groupBy("kpi").agg(F.count("*").alias("n"))
    steps = F.least(F.coalesce("n", F.lit(0)), F.lit(MOST_STEPS))
    return base.join(n, "kpi", "left").select("kpi", (F.col("relative") + RELATIVE_STEP * steps).alias("relative"), (F.col("absolute") * F.pow(F.lit(ABSOLUTE_FACTOR), steps)).alias("absolute"))


def adjusted(base: Materiality, n: int) -> Materiality:
    steps = min(n, MOST_STEPS)
    return dataclasses.replace(base, relative=base.relative + RELATIVE_STEP * steps, absolute=base.absolute * ABSOLUTE_FACTOR**steps)


def promoted(contract: Contract, driver: Driver) -> Contract:
    """The contract with one cause more, which must be new to it."""
    if any(d.id == driver.id for d in contract.drivers):
        raise ValueError(f"driver {driver.id!r} is registered already")
    return dataclasses.replace(contract, drivers=(*contract.drivers, driver))


def enumerated(contract: Contract, suggested: list[dict]) -> list[dict]:
    """A hypothesis for each registered driver in the contract's order, with the first note that was suggested for it.

    The first suggestion of anything else, whatever it is called, is one more for an unmodelled cause; further ones are dropped.
    """
    known = {d.id for d in contract.drivers}
    notes: dict[str, str] = {}
    for s in suggested:
        notes.setdefault(s["driver"] if s["driver"] in known else UNMODELLED, s.get("rationale", ""))
    out = [{"driver": d.id, "priority": i, "rationale": notes.get(d.id, "")} for i, d in enumerate(contract.drivers, 1)]
    if UNMODELLED in notes:
        out.append({"driver": UNMODELLED, "priority": len(out) + 1, "rationale": notes[UNMODELLED]})
    return out
