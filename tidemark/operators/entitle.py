"""Who may see what: rows, domains, columns, amounts and prose. Denied by default; redactions are always stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import alias, band, scrubbed
from tidemark.plans.contract import Contract, Persona

ALL, OWN = "*", "own_region"


class NotEntitled(PermissionError):
    """A viewer's rows exclude a case."""


def allowed(contract: Contract, persona: Persona, dimension: str) -> list[str] | None:
    """What a viewer may see along a dimension: None is everything, an empty list nothing."""
    grant = contract.access.row.get(dimension, {}).get(persona.role_key)
    if grant is None:
        return []
    return None if ALL in grant else [persona.region if v == OWN and persona.region else v for v in grant]


def rows(df: DataFrame, contract: Contract, persona: Persona, dimensions: list[str]) -> DataFrame:
    """The rows that a viewer may see; the grants are literals, so the filter reaches the scan."""
    for d in dimensions:
        values = allowed(contract, persona, d)
        if values is not None:
            df = df.where(F.col(d).isin(values) if values else F.lit(False))
    return df


def rows_by_rule(df: DataFrame, rules: DataFrame, viewers: DataFrame, dimension: str) -> DataFrame:
    """viewer and the rows that each may see. rules: role_key, allowed ('*', 'own_region' or a value); viewers: viewer, role_key, region.

    Grants are resolved to values first; a viewer without one has no row.
    """
    granted = viewers.join(rules, "role_key").select("viewer", F.when(F.col("allowed") == OWN, F.col("region")).otherwise(F.col("allowed")).alias("allowed")).distinct()
    everything = granted.where(F.col("allowed") == ALL).select("viewer").distinct()
    some = granted.join(everything, "viewer", "left_anti")
    by_value = df.join(some, df[dimension] == some["allowed"]).select("viewer", *df.columns)
    return by_value.unionByName(everything.crossJoin(df))  # viewers of everything, each with all rows: what was granted


def check_case(contract: Contract, persona: Persona, dimensions: dict[str, str]) -> None:
    for d, value in dimensions.items():
        values = allowed(contract, persona, d)
        if values is not None and value not in values:
            raise NotEntitled(f"{persona.label or persona.id} may see {d} {values or 'nothing'}, and the case is {value!r}")


def collapse(nodes: DataFrame, permitted: list[str], domain: str) -> DataFrame:
    """dimension, key, delta, share with all keys outside the permitted domain as one row, which keeps the totals and says how many.

    A key whose domain isn't known stays.
    """
    hidden = F.col(domain).isNotNull() & ~F.col(domain).isin(permitted) if permitted else F.col(domain).isNotNull()
    kept = nodes.where(~hidden).select("dimension", "key", "delta", "share")
    gone = nodes.where(hidden).groupBy("dimension").agg(F.count("*").alias("n"), F.sum("delta").alias("delta"), F.sum("share").alias("share"))
    marker = F.concat(F.col("n").cast("string"), F.lit(f" accounts ({domain} restricted)"))
    return kept.withColumn("key", F.col("key").cast("string")).unionByName(gone.select("dimension", marker.alias("key"), "delta", "share"))


def masked(df: DataFrame, contract: Contract, persona: Persona, names: dict[str, str], money: list[str], prose: list[str], restricted: list[str]) -> DataFrame:
    """Columns as a viewer may see them.

    names: column to account id column, replaced by an alias where account_name isn't theirs; money: banded where
    amounts aren't theirs; prose: without the restricted names and amounts, if either isn't theirs.
    """
    may = lambda field: persona.role_key in contract.access.column.get(field, [])
    if not may("account_name"):
        for column, key in names.items():
            df = df.withColumn(column, alias(F.col(key)))
    if not may("amount_net"):
        for column in money:
            df = df.withColumn(column, band(F.col(column)))
    if not (may("account_name") and may("amount_net")):
        for column in prose:
            df = df.withColumn(column, scrubbed(F.col(column), [] if may("account_name") else restricted))
    return df


def redactions(df: DataFrame, contract: Contract, persona: Persona, dimensions: list[str], domains: dict[str, list[str]]) -> DataFrame:
    """surface, field, n: what a viewer doesn't get to see, counted."""
    out = None
    for surface, field, shown in (*(("row", d, allowed(contract, persona, d)) for d in dimensions), *(("domain", d, v) for d, v in domains.items())):
        if shown is None:
            continue
        hidden: Column = F.col(field).isNotNull() & ~F.col(field).isin(shown) if shown else F.lit(True)
        part = df.agg(F.count_if(hidden).alias("n")).select(F.lit(surface).alias("surface"), F.lit(field).alias("field"), "n")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return df.sparkSession.createDataFrame([], "surface string, field string, n long")
    return out.where("n > 0")


def statement(found: list[tuple[str, str, int]]) -> str:
    """A sentence that says what is withheld, or that nothing is."""
    if not found:
        return "No redactions: this view is complete."
    return "Redacted: " + "; ".join(f"{n} {surface} values of {field} withheld" for surface, field, n in found) + "."
