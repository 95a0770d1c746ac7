"""What the raw tables say about each kind of cause: when it began, whom it touched and how strongly."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.challenge import region_peers
from tidemark.operators.evidence import SPIKE, ticket_spike
from tidemark.operators.series import daily, onsets
from tidemark.plans.contract import Driver


@dataclass(frozen=True)
class Footprint:
    """The accounts of an effect and its window, both ends included."""

    accounts: DataFrame
    start: date
    end: date

    def since(self, days: int) -> date:
        return self.start - timedelta(days=days)

    @property
    def baseline(self) -> date:
        """The first day of the window of equal length before."""
        return self.start - (self.end - self.start)


Tables = dict[str, DataFrame]


def _segments(tables: Tables, at: Footprint) -> DataFrame:
    return tables["account"].join(at.accounts.select("account_id"), "account_id", "left_semi").select("segment").distinct()


def _between(column: str, first: date, last: date):
    return F.to_date(column).between(F.lit(first), F.lit(last))


def _first(df: DataFrame, column: str, first: date, last: date) -> DataFrame:
    return df.where(_between(column, first, last)).agg(F.min(F.to_date(column)).alias("onset"))


def _ticket_onset(tables: Tables, driver: Driver, at: Footprint) -> DataFrame:
    mine = tables["ticket"].join(at.accounts.select("account_id"), "account_id", "left_semi")
    return onsets(daily(mine.withColumn("all", F.lit(1)), ["all"], "created_at", str(at.baseline), str(at.end)), ["all"]).select("onset")


def _price_onset(tables: Tables, driver: Driver, at: Footprint) -> DataFrame:
    return _first(tables["price_book"].join(_segments(tables, at), "segment", "left_semi"), "effective_from", at.since(driver.max_lag_days), at.end)


def _offer_onset(tables: Tables, driver: Driver, at: Footprint) -> DataFrame:
    return _first(tables["news_item"].where("competitor IS NOT NULL"), "published_at", at.since(driver.max_lag_days), at.end)


def _incident_onset(tables: Tables, driver: Driver, at: Footprint) -> DataFrame:
    return _first(tables["incident"], "started_at", at.since(driver.max_lag_days), at.end)


def _spikes(tables: Tables, accounts: DataFrame, at: Footprint) -> DataFrame:
    return ticket_spike(tables["ticket"], accounts, str(at.start), str(at.end), str(at.baseline), str(at.start))


def _ticket_accounts(tables: Tables, driver: Driver, at: Footprint) -> DataFrame:
    """Spiking accounts of all the effect's regions: wider than the effect, so that a broad cause shows as broad."""
    found = _spikes(tables, region_peers(tables["account"], at.accounts), at).where(F.col("ratio") >= SPIKE).select("account_id")
    return _or_none(found)


def _price_accounts(tables: Tables, driver: Driver, at: Footprint) -> DataFrame:
    changed = tables["price_book"].where(_between("effective_from", at.since(driver.max_lag_days), at.end)).join(_segments(tables, at), "segment", "left_semi").select("segment").distinct()
    return _or_none(tables["account"].join(changed, "segment", "left_semi").select("account_id"))


def _offer_accounts(tables: Tables, driver: Driver, at: Footprint) -> DataFrame:
    """Accounts of the regions that news names; without such news there is nothing to look at, so no row at all."""
    named = tables["news_item"].where(_between("published_at", at.since(driver.max_lag_days), at.end) & F.col("competitor").isNotNull() & F.col("region").isNotNull())
    return tables["account"].join(named.select("region").distinct(), "region", "left_semi").select("account_id")


def _or_none(found: DataFrame) -> DataFrame:
    """A known footprint: a row without an account stands for a place that was looked at."""
    return found.unionByName(found.sparkSession.range(1).select(F.lit(None).cast(found.schema["account_id"].dataType).alias("account_id")))


def _ticket_intensity(tables: Tables, driver: Driver, at: Footprint) -> DataFrame:
    return _spikes(tables, at.accounts, at).where("ratio IS NOT NULL").select("account_id", F.col("ratio").alias("intensity"))


Detector = Callable[[Tables, Driver, Footprint], DataFrame]
ONSETS: dict[str, Detector] = {"ticket_spike": _ticket_onset, "price_delta": _price_onset, "lost_reason_scan": _offer_onset, "incident_scan": _incident_onset}
ACCOUNTS: dict[str, Detector] = {"ticket_spike": _ticket_accounts, "price_delta": _price_accounts, "lost_reason_scan": _offer_accounts}
INTENSITIES: dict[str, Detector] = {"ticket_spike": _ticket_intensity}


def _all(registry: dict[str, Detector], tables: Tables, drivers: list[Driver], at: Footprint, *columns: str) -> DataFrame | None:
    out = None
    for d in drivers:
        if d.probe in registry:
            part = registry[d.probe](tables, d, at).select(F.lit(d.id).alias("driver"), *columns)
            part = part.withColumn("max_lag_days", F.lit(d.max_lag_days)) if "onset" in columns else part
            out = part if out is None else out.unionByName(part)
    return out


def detected(tables: Tables, drivers: list[Driver], at: Footprint) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """causes for timing (driver, onset, max_lag_days), for locality (driver, account_id), for dose (driver, account_id, intensity)."""
    return _all(ONSETS, tables, drivers, at, "onset"), _all(ACCOUNTS, tables, drivers, at, "account_id"), _all(INTENSITIES, tables, drivers, at, "account_id", "intensity")


def effects(tables: Tables, at: Footprint) -> DataFrame:
    """account_id, effect_on: the last renewal decision of each account of the footprint in the window."""
    mine = tables["renewal"].where(_between("closed_date", at.start, at.end)).join(at.accounts.select("account_id"), "account_id", "left_semi")
    return mine.groupBy("account_id").agg(F.max("closed_date").alias("effect_on"))
