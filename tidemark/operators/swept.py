"""The whole investigation of all open slices at once: a case is a key of the rows, from footprints to verdicts.

What run_case() does for one case in some dozens of jobs, this does for any number of cases in the same few: tables are
added up by account and day, or account and month, once, and meet the cases' windows by account and time bin.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.challenge import ELSEWHERE, LOCAL, TESTS
from tidemark.operators.decompose import covering
from tidemark.operators.evidence import SPIKE, EvidenceError, sql_text
from tidemark.operators.intervals import overlapping, per_day, spike_counts, within
from tidemark.operators.outcome import adjudicate, priority
from tidemark.operators.probes import COMPETITOR_CODES, sql_items
from tidemark.operators.series import onsets, placebo, price_volume_mix, spearman
from tidemark.plans.contract import Contract
from tidemark.plans.formula import parse
from tidemark.plans.gathered import definitions
from tidemark.plans.panel import Model, bounds, in_force, joined, labelled, scoped, term_panel, valued
from tidemark.sources.scratch import settled

Tables = dict[str, DataFrame]


def windowed(openings: DataFrame) -> DataFrame:
    """Openings with previous (the month before period), start and end (first and last day of the two), and baseline, as long before start."""
    first, last = bounds(F.col("period"))
    start = F.add_months(first, -1)
    return openings.withColumns({"previous": F.date_format(start, "yyyy-MM"), "start": start, "end": last, "baseline": F.date_sub(start, F.datediff(last, start))})


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _by_account(model: Model, contract: Contract, dims: list[str], months: tuple[str, ...]) -> DataFrame:
    """kpi, period, dims, account_id, num and den by the formula of today, and value by the one in force."""
    keys = [*dims, "account_id"]
    panel, names = term_panel(model, contract, definitions(contract), keys, months=months)
    epochs = sorted(contract.epochs, key=lambda e: e.effective_from)
    texts = list(dict.fromkeys(e.formula for e in epochs)) or [contract.formula]
    columns = {t: valued(parse(t, frozenset(model.facts)), names) for t in {*texts, contract.formula}}
    num, den, _ = columns[contract.formula]
    value = in_force(epochs, texts[0], columns, bounds(F.col("period"))[1])[2]
    return panel.select(F.lit(contract.id).alias("kpi"), "period", *keys, num.alias("num"), F.coalesce(den, F.lit(0.0)).alias("den"), value.alias("value"))


def _on_cases(rows: DataFrame, cases: DataFrame, dims: list[str]) -> DataFrame:
    """Rows of kpi, period and dims with the case that they belong to, and whether they are of its own period or the one before."""
    of = cases.select("case_id", "kpi", *dims, F.col("period").alias("_now"), F.col("previous").alias("_before"))
    met = joined(rows, of, ["kpi", *dims], "inner").where(F.col("period").isin(F.col("_now"), F.col("_before")))
    return met.withColumn("_is_now", F.col("period") == F.col("_now")).drop("_now", "_before")


def changes(model: Model, contracts: list[Contract], cases: DataFrame, dims: list[str], months: tuple[str, ...]) -> DataFrame:
    """case_id, account_id, key, pre, post, delta: each case's accounts, with their part of its movement.

    One grouping a table and contract, whatever the number of cases; a ratio's parts are over the case's denominators.
    """
    spark = cases.sparkSession
    rules = spark.createDataFrame([(c.id, bool(c.parsed.denominator), float(c.parsed.divisor)) for c in contracts], "kpi string, _ratio boolean, _divisor double")
    rows = _on_cases(_union(_by_account(model, c, dims, months) for c in contracts), cases, dims)
    side = lambda c, now: F.coalesce(F.sum(F.when(F.col("_is_now") == now, F.col(c))), F.lit(0.0))
    sums = {f"{c}{int(now)}": side(c, now) for c in ("num", "den", "value") for now in (False, True)}
    out = rows.groupBy("case_id", "kpi", "account_id").agg(*(v.alias(k) for k, v in sums.items()))
    whole = out.groupBy("case_id").agg(F.sum("den0").alias("_d0"), F.sum("den1").alias("_d1"))
    out = out.join(whole, "case_id").join(F.broadcast(rules), "kpi")  # a row a contract
    over = lambda i: F.coalesce(F.try_divide(f"num{i}", F.nullif(f"_d{i}", F.lit(0.0))), F.lit(0.0))
    delta = F.when(F.col("_ratio"), over(1) - over(0)).otherwise(F.col("num1") - F.col("num0")) / F.col("_divisor")
    return out.select("case_id", "account_id", F.col("account_id").cast("string").alias("key"), F.col("value0").alias("pre"), F.col("value1").alias("post"), delta.alias("delta"))


def price_effects(model: Model, contracts: list[Contract], cases: DataFrame, dims: list[str], months: tuple[str, ...]) -> DataFrame | None:
    """case_id, price: the price part of each case's movement, of contracts with a driver by prices and a table that has prices and quantities."""
    parts = []
    for c in contracts:
        tables = [t.table for t in c.parsed.numerator if {"product_id", "account_id", "qty", "amount_net"} <= set(model.facts[t.table].df.columns)]
        if tables and any(d.probe == "price_delta" for d in c.drivers):
            lines = labelled(scoped(model, tables[0], [], dims, months=months))
            parts.append(lines.groupBy(F.lit(c.id).alias("kpi"), "period", *dims, "account_id", "product_id").agg(F.sum("qty").alias("q"), F.sum("amount_net").alias("a")))
    if not parts:
        return None
    rows = _on_cases(_union(parts), cases, dims)
    side = lambda c, now: F.sum(F.when(F.col("_is_now") == now, F.col(c)))
    sums = rows.groupBy("case_id", "account_id", "product_id").agg(*(side(c, bool(i)).alias(f"{c}{i}") for i in (0, 1) for c in ("q", "a")))
    there = [F.coalesce(F.col(f"q{i}"), F.lit(0.0)) != 0 for i in (0, 1)]
    sold = sums.where(there[0] | there[1])
    cols = [F.when(there[i], F.col(f"q{i}").cast("double")).alias(f"q{i}") for i in (0, 1)] + [F.when(there[i], F.col(f"a{i}") / F.col(f"q{i}")).alias(f"p{i}") for i in (0, 1)]
    return price_volume_mix(sold.select("case_id", *cols), ["case_id"]).select("case_id", "price")


def timing(causes: DataFrame, effects: DataFrame) -> DataFrame:
    """challenge.timing() by case: causes are case_id, driver, onset, max_lag_days; effects case_id, account_id, effect_on.

    The lag farthest outside its window is that of a case's first or last effect, so two days a case are joined, not all.
    """
    of = effects.groupBy("case_id").agg(F.count("*").alias("n"), F.min("effect_on").alias("_first"), F.max("effect_on").alias("_last"))
    both = causes.where("onset IS NOT NULL").join(of, "case_id").withColumn("lag", F.explode(F.array(F.datediff("_first", "onset"), F.datediff("_last", "onset"))))
    outside = F.when(F.col("lag") < 0, -F.col("lag")).otherwise(F.greatest(F.col("lag") - F.col("max_lag_days"), F.lit(0)))
    out = both.withColumn("_out", outside).groupBy("case_id", "driver").agg(F.max("n").alias("n"), F.max_by("lag", F.struct("_out", "lag")).alias("worst_lag"), F.max("_out").alias("_out"))
    return out.select("case_id", "driver", "n", "worst_lag", F.when(F.col("_out") > 0, "refute").otherwise("pass").alias("outcome"))


def locality(causes: DataFrame, footprint: DataFrame) -> DataFrame:
    """challenge.locality() by case: causes are case_id, driver, account_id (null: looked, none found)."""
    mine = footprint.select("case_id", "account_id").withColumn("_e", F.lit(1))
    hit = causes.distinct().join(mine, ["case_id", "account_id"], "left")
    out = hit.groupBy("case_id", "driver").agg(F.count("account_id").alias("n_cause"), F.count("_e").alias("n_both"))
    out = out.join(mine.groupBy("case_id").agg(F.count("*").alias("n_effect")), "case_id", "left").withColumn("n_effect", F.coalesce("n_effect", F.lit(0)))
    j = F.try_divide(F.col("n_both").cast("double"), F.nullif((F.col("n_cause") + F.col("n_effect") - F.col("n_both")).cast("double"), F.lit(0.0)))
    return out.select("case_id", "driver", j.alias("overlap"), F.when(j > LOCAL, "pass").when(j < ELSEWHERE, "refute").otherwise("inconclusive").alias("outcome"))


def control(values: DataFrame, accounts: DataFrame, footprint: DataFrame) -> DataFrame:
    """challenge.control() by case: the footprint's accounts against those of its cases' rows that share a region and segment with one."""
    own = footprint.select("case_id", "account_id").withColumn("_own", F.lit(True))
    rows = values.select("case_id", F.col("account_id"), "pre", "post").join(accounts.select("account_id", "region", "segment"), "account_id", "left").join(own, ["case_id", "account_id"], "left")
    places = rows.where("_own").select("case_id", "region", "segment").distinct().where("region IS NOT NULL AND segment IS NOT NULL")
    peers = rows.where("_own IS NULL").join(places, ["case_id", "region", "segment"], "left_semi")
    treated = rows.where("_own").withColumn("treated", F.lit(True)).unionByName(peers.withColumn("treated", F.lit(False)))
    return placebo(treated.select("case_id", "pre", "post", "treated"), ["case_id"])


class _Found:
    """What probes see of the cases' causes: onsets, accounts, intensities and support, each by case and driver."""

    def __init__(self, tables: Tables, causes: DataFrame, cases: DataFrame, footprint: DataFrame):
        self.tables, self.causes = tables, causes
        self.feet = footprint.join(cases.select("case_id", "start", "end", "baseline"), "case_id")
        self.cases = cases.select("case_id", "start", "end", "baseline")
        self.onsets: list[DataFrame] = []
        self.accounts: list[DataFrame] = []
        self.support: list[DataFrame] = []
        self.intensities: list[DataFrame] = []

    def of(self, probe: str) -> DataFrame:
        """The probe's drivers of each case, with the days in which a cause may have begun."""
        mine = self.causes.where(F.col("probe") == probe).select("case_id", "driver", "max_lag_days")
        return mine.join(self.cases.select("case_id", "start", "end"), "case_id").withColumn("since", F.expr("date_sub(start, max_lag_days)"))

    def _onset(self, drivers: DataFrame, days: DataFrame) -> None:
        self.onsets.append(drivers.join(days, "case_id" if "driver" not in days.columns else ["case_id", "driver"]).select("case_id", "driver", "onset", "max_lag_days"))

    def _first(self, drivers: DataFrame, events: DataFrame, at: str) -> None:
        """The first day of events of all accounts in each driver's days."""
        days = events.select(F.to_date(at).alias("day")).distinct()
        self._onset(drivers, within(days, drivers.select("case_id", "driver", "since", "end"), [], "day", "since", "end", closed=True).groupBy("case_id", "driver").agg(F.min("day").alias("onset")))

    def tickets(self) -> None:
        drivers, account = self.of("ticket_spike"), self.tables["account"]
        asked = self.feet.join(drivers.select("case_id").distinct(), "case_id", "left_semi")
        days = per_day(self.tables["ticket"], ["account_id"], "created_at")
        # every account of the effect's regions, so that a broad cause shows as broad
        regions = asked.join(account.select("account_id", "region"), "account_id").select("case_id", "region").distinct().join(self.cases, "case_id")
        area = account.select("account_id", "region").join(regions, "region").drop("region")
        mine = asked.select("case_id", "account_id", F.lit(True).alias("mine"), "delta")
        spikes = settled(spike_counts(days, area, ["account_id"]).join(mine, ["case_id", "account_id"], "left"))
        self.accounts.append(self._known(drivers, spikes.where(F.col("ratio") >= SPIKE).select("case_id", "account_id")))
        self.support.append(drivers.join(spikes.where(F.col("mine") & (F.col("ratio") >= SPIKE)).select("case_id").distinct(), "case_id", "left_semi").select("case_id", "driver"))
        rated = spearman(spikes.where(F.col("mine") & F.col("ratio").isNotNull()), ["case_id"], "ratio", "delta")
        self.intensities.append(drivers.join(rated, "case_id").select("case_id", "driver", "rho", "outcome"))
        counted = within(days, asked.select("case_id", "account_id", "baseline", "end"), ["account_id"], "day", "baseline", "end", closed=True)
        counted = counted.groupBy("case_id", "baseline", "end", "day").agg(F.sum("n").alias("n"))
        spine = counted.select("case_id", "baseline", "end").distinct().withColumn("day", F.explode(F.sequence("baseline", "end")))
        dense = spine.select("case_id", "day").join(counted.select("case_id", "day", "n"), ["case_id", "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        self._onset(drivers, onsets(dense, ["case_id"]).select("case_id", "onset"))

    def prices(self) -> None:
        drivers, account = self.of("price_delta"), self.tables["account"]
        segments = self.feet.join(account.select("account_id", "segment"), "account_id").select("case_id", "segment").distinct()
        windows = drivers.join(segments, "case_id").select("case_id", "driver", "segment", "start", "since", "end")
        met = within(per_day(self.tables["price_book"], ["segment"], "effective_from"), windows, ["segment"], "day", "since", "end", closed=True)
        found = met.groupBy("case_id", "driver", "segment").agg(F.min("day").alias("onset"), F.bool_or((F.col("day") >= F.col("start")) & (F.col("day") < F.col("end"))).alias("inside"))
        found = settled(found)  # a row a case and segment
        self._onset(drivers, found.groupBy("case_id", "driver").agg(F.min("onset").alias("onset")))
        self.support.append(found.where("inside").select("case_id", "driver").distinct())
        touched = account.select("account_id", "segment").join(found.select("case_id", "driver", "segment"), "segment").select("case_id", "driver", "account_id")
        self.accounts.append(touched.unionByName(self._nobody(drivers)))

    def offers(self) -> None:
        drivers = self.of("lost_reason_scan")
        if "news_item" in self.tables:
            news = self.tables["news_item"].where("competitor IS NOT NULL")
            self._first(drivers, news, "published_at")
            named = news.where("region IS NOT NULL").select(F.to_date("published_at").alias("day"), "region").distinct()
            places = within(named, drivers.select("case_id", "driver", "since", "end"), [], "day", "since", "end", closed=True).select("case_id", "driver", "region").distinct()
            self.accounts.append(self.tables["account"].select("account_id", "region").join(places, "region").select("case_id", "driver", "account_id"))
        if "opportunity" in self.tables:
            named = self.tables["opportunity"].where((F.col("closed_won") == 0) & F.col("lost_reason_code").isin(*COMPETITOR_CODES))
            hit = within(per_day(named, ["account_id"], "close_date"), self.feet.select("case_id", "account_id", "start", "end"), ["account_id"], "day")
            self.support.append(drivers.join(hit.select("case_id").distinct(), "case_id", "left_semi").select("case_id", "driver"))

    def incidents(self) -> None:
        drivers, incident = self.of("incident_scan"), self.tables["incident"]
        self._first(drivers, incident, "started_at")
        each = incident.select("started_at", "resolved_at", F.explode(F.split("affected_accounts", r"\|")).alias("key"))
        windows = self.feet.join(drivers.select("case_id").distinct(), "case_id", "left_semi").select("case_id", "key", "start", "end")
        hit = overlapping(each, windows, ["key"], "started_at", "resolved_at", skewed=True)
        self.support.append(drivers.join(hit.select("case_id").distinct(), "case_id", "left_semi").select("case_id", "driver"))

    def own(self, path: str) -> None:
        """A contract's own probe over all cases' footprints: what it finds in a case, if it supports, supports its drivers there."""
        drivers = self.of(path)
        asked = self.feet.join(drivers.select("case_id").distinct(), "case_id", "left_semi").select("case_id", "account_id", "start", "end")
        items = sql_items(self.feet.sparkSession, path, self.tables | {"footprints": asked}, {}, ["case_id"])
        hit = items.where("outcome = 'found' AND supported").select("case_id").distinct()
        self.support.append(drivers.join(hit, "case_id", "left_semi").select("case_id", "driver"))

    def _known(self, drivers: DataFrame, found: DataFrame) -> DataFrame:
        return drivers.select("case_id", "driver").join(found, "case_id").unionByName(self._nobody(drivers))

    def _nobody(self, drivers: DataFrame) -> DataFrame:
        """A row without an account stands for a place that was looked at."""
        return drivers.select("case_id", "driver", F.lit(None).cast(self.tables["account"].schema["account_id"].dataType).alias("account_id"))


#: Which tables a probe can't do without.
_READS = {"ticket_spike": ("ticket",), "price_delta": ("price_book",), "lost_reason_scan": (), "incident_scan": ("incident",)}


def investigated(model: Model, contracts: list[Contract], openings: DataFrame, tables: Tables, dims: list[str] | None = None) -> DataFrame:
    """case_id, kpi, period, dims, driver, the four tests, tier, status, confidence, share, rank, priority, found_support, total_delta, footprint_delta.

    openings: case_id, kpi, period, dims and ceiling, a row a case, of any number of contracts, periods and slices. A row
    out for each case and driver with a probe; cases of contracts without one have none. Values are those of
    run_case(). tables are the raw tables, with account; drivers whose tables aren't there stay inconclusive. A probe that is
    a file of SQL runs over all cases at once if it reads {footprints} (case_id, account_id, start, end) and keeps case_id,
    see evidence(); one that is written for a single case, with {footprint}, can't be, and is an error.

    The number of jobs depends on the contracts and probes, not on the cases. What is read on the driver is the first and
    the last period. No key has more rows than an account has days, or a case accounts, before they are grouped.
    """
    dims = dims or ["region"]
    contracts = [c for c in contracts if any(d.probe for d in c.drivers)]
    if not contracts:
        raise ValueError("no contract has a driver with a probe")
    spark = openings.sparkSession
    cases = settled(windowed(openings.select("case_id", "kpi", "period", *dims, "ceiling")).where(F.col("kpi").isin([c.id for c in contracts])))
    span = cases.agg(F.min("previous"), F.max("period")).first()
    months = (span[0], span[1]) if span[0] else ("1970-01", "1970-01")
    moved = settled(changes(model, contracts, cases, dims, months))
    footprint = settled(covering(moved.where("delta <> 0").select("case_id", "account_id", "key", "delta"), ["case_id"]))
    sums = moved.where("delta <> 0").groupBy("case_id").agg(F.sum("delta").alias("total_delta")).join(footprint.groupBy("case_id").agg(F.sum("delta").alias("footprint_delta")), "case_id", "left")

    drivers = [(c.id, d.id, d.probe, d.max_lag_days) for c in contracts for d in c.drivers if d.probe]
    each = spark.createDataFrame(drivers, "kpi string, driver string, probe string, max_lag_days int")
    causes = cases.select("case_id", "kpi").join(F.broadcast(each), "kpi").drop("kpi")  # a row a driver of a contract
    found = _Found(tables, causes, cases, footprint)
    for name, read in (("ticket_spike", found.tickets), ("price_delta", found.prices), ("lost_reason_scan", found.offers), ("incident_scan", found.incidents)):
        if any(p == name for _, _, p, _ in drivers) and all(t in tables for t in _READS[name]):
            read()
    for path in dict.fromkeys(p for _, _, p, _ in drivers if p.endswith(".sql")):
        if "{footprints}" not in sql_text(spark, path):
            raise EvidenceError(f"{path} reads one case's {{footprint}}; of many cases a probe reads {{footprints}}")
        found.own(path)

    results = {"dose": _union(found.intensities) if found.intensities else None}
    if found.onsets and "renewal" in tables:
        renewed = tables["renewal"].select("account_id", F.to_date("closed_date").alias("effect_on")).distinct()
        met = within(renewed, found.feet.select("case_id", "account_id", "start", "end"), ["account_id"], "effect_on", closed=True)
        results["timing"] = timing(_union(found.onsets), met.groupBy("case_id", "account_id").agg(F.max("effect_on").alias("effect_on")))
    if found.accounts:
        results["locality"] = locality(_union(found.accounts), footprint)
    out = causes.select("case_id", "driver", (F.col("probe") == "price_delta").alias("is_price"))
    for name in ("timing", "locality", "dose"):
        df = results.get(name)
        out = out.withColumn(name, F.lit(None).cast("string")) if df is None else out.join(df.select("case_id", "driver", F.col("outcome").alias(name)), ["case_id", "driver"], "left")
    held = control(moved, model.accounts, footprint) if model.accounts is not None else None
    out = out.withColumn("control", F.lit(None).cast("string")) if held is None else out.join(held.select("case_id", F.col("outcome").alias("control")), "case_id", "left")
    out = out.withColumns({t: F.coalesce(F.col(t), F.lit("inconclusive")) for t in TESTS})
    if found.support:
        out = out.join(_union(found.support).distinct().withColumn("_probed", F.lit(True)), ["case_id", "driver"], "left")
    else:
        out = out.withColumn("_probed", F.lit(False))
    passed: Column = functools.reduce(Column.__or__, (F.col(t) == "pass" for t in TESTS if t != "control"))
    out = out.withColumn("found_support", F.coalesce("_probed", F.lit(False)) | passed).drop("_probed")
    price = price_effects(model, contracts, cases, dims, months)
    out = out.withColumn("price", F.lit(None).cast("double")) if price is None else out.join(price, "case_id", "left")
    out = out.withColumn("price_effect", F.when(F.col("is_price"), F.col("price"))).drop("price", "is_price")
    rows = out.join(sums, "case_id", "left").join(cases.select("case_id", "kpi", "period", *dims, "ceiling"), "case_id").withColumn("unmodelled", F.lit(False))
    ranked = adjudicate(rows, ["case_id"]).withColumn("priority", priority(F.col("total_delta"), F.col("confidence")))
    return ranked.select("case_id", "kpi", "period", *dims, "driver", *TESTS, "tier", "status", "confidence", "share", "rank", "priority", "found_support", "total_delta", "footprint_delta")
