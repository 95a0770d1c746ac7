"""One case from end to end: verify, decompose, test the candidate causes, judge, recommend."""

from __future__ import annotations

import dataclasses
import functools
import json
import re
import time
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import alias, band
from tidemark.functions.provider import Replay, Stub, Usage
from tidemark.operators import probes
from tidemark.operators.causes import Footprint, detected, effects
from tidemark.operators.challenge import as_evidence, control, dose, locality, matrix, timing
from tidemark.operators.decompose import contributions, covering, pvm
from tidemark.operators.entitle import check_case, collapse, statement
from tidemark.operators.evidence import supported_claims
from tidemark.operators.feedback import UNMODELLED, enumerated
from tidemark.operators.incremental import next_batch
from tidemark.operators.outcome import FALLBACKS, adjudicate, cited, menu, page, priority, questions, recommend
from tidemark.operators.retrieval import SOURCES, bm25, documents, scope, top
from tidemark.operators.scan import sweep
from tidemark.operators.verify import verify
from tidemark.plans.contract import Contract, Driver, Persona
from tidemark.plans.gathered import definitions
from tidemark.plans.panel import Fact, Model, kpi_panel, term_panel
from tidemark.sources.scratch import settled

Provider = Stub | Replay
#: Prices of a million tokens in and out, for the cost of calls.
PRICES = (3.0, 15.0)


@dataclass(frozen=True)
class Case:
    """The frames of a case. A case that verification closed has no more than that."""

    case_id: str
    verification: DataFrame
    contributions: DataFrame | None = None
    footprint: DataFrame | None = None
    matrix: DataFrame | None = None
    evidence: DataFrame | None = None
    verdict: DataFrame | None = None
    question: DataFrame | None = None
    recommendation: DataFrame | None = None
    notes: dict[str, str] = field(default_factory=dict)
    hypotheses: list[dict] = field(default_factory=list)
    quotes: list[tuple] = field(default_factory=list)
    telemetry: DataFrame | None = None


def sliced(model: Model, dims: dict[str, str]) -> Model:
    """The model with accounts of a slice only; facts follow by their join, or by their own column."""
    accounts = model.accounts
    for d, v in dims.items():
        if accounts is not None and d in accounts.columns:
            accounts = accounts.where(F.col(d) == v)
    facts = {}
    for name, f in model.facts.items():
        df = f.df
        own = [d for d in dims if d in df.columns]
        for d in own:
            df = df.where(F.col(d) == dims[d])
        if len(own) < len(dims) and accounts is not None and "account_id" in df.columns:
            df = df.join(accounts.select("account_id"), "account_id", "left_semi")
        facts[name] = Fact(df, f.period, f.ingested)
    return dataclasses.replace(model, facts=facts, accounts=accounts)


def _before(period: str) -> str:
    y, m = int(period[:4]), int(period[5:])
    return f"{y - (m == 1):04d}-{m - 1 or 12:02d}"


def _window(period: str) -> tuple[date, date]:
    first = date.fromisoformat(f"{_before(period)}-01")
    y, m = int(period[:4]), int(period[5:])
    last = date(y + (m == 12), m % 12 + 1, 1)
    return first, date.fromordinal(last.toordinal() - 1)


class _Clock:
    """Rows of telemetry: a stage's time, and the calls and cost of models in it."""

    def __init__(self, case_id: str):
        self.case_id, self.rows, self.begun = case_id, [], time.perf_counter()

    def stage(self, name: str, used: list[Usage] | None = None) -> None:
        now = time.perf_counter()
        self.rows.append((self.case_id, name, 1000 * (now - self.begun), sum(u.calls for u in used or ()), sum((u.cost(*PRICES) for u in used or ()), 0.0)))
        self.begun = now

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "case_id string, stage string, wall_ms double, calls long, cost double")


def _price_effect(model: Model, contract: Contract, period: str, previous: str) -> DataFrame | None:
    """The price part of the slice's movement, one row, if a table of the numerator has prices and quantities of products."""
    for t in contract.parsed.numerator:
        if {"product_id", "account_id", "qty", "amount_net"} <= set(model.facts[t.table].df.columns):
            return pvm(model, t.table, [], period, previous).select(F.col("price").alias("price"))
    return None


def extracted(tables: dict[str, DataFrame], drivers: list[Driver], at: Footprint, provider: Provider) -> tuple[list[tuple], list[Usage]]:
    """Claims that a model quotes from the best documents of each driver's sources: (id, driver, doc_id, quote), of documents that have the quote.

    A driver has at most 15 documents, which is all that is read on the driver.
    """
    found, used = [], []
    for d in drivers:
        sources = [s for s in d.evidence_sources if all(t in tables for t in SOURCES.get(s, ("?",)))]
        if not sources:
            continue
        docs = scope(documents(tables, sources), at.accounts, str(at.start), str(at.end), d.max_lag_days)
        docs = docs.select("doc_id", F.concat_ws(" ", "title", "body").alias("text"))
        asked = docs.sparkSession.createDataFrame([(1, d.id.replace("_", " "))], "query_id int, query string")
        best = top(bm25(docs, asked), ["doc_id"]).join(docs, "doc_id").orderBy("rank").select("doc_id", "text").collect()
        if not best:
            continue
        answer, usage = provider.complete("extract", f"{d.id}\n" + "\n".join(f"[{r.doc_id}] {r.text}" for r in best), {"claims": [{"doc_id": "string", "quote": "string"}]})
        used.append(usage)
        claims = [(str(c.get("doc_id")), str(c.get("quote", ""))) for c in answer.get("claims", ())]
        if claims:
            read = docs.sparkSession.createDataFrame([(r.doc_id, r.text) for r in best], "doc_id string, text string")
            kept = supported_claims(docs.sparkSession.createDataFrame(claims, "doc_id string, quote string"), read).collect()
            found += [(f"ev-{d.id}-doc-{i:03d}", d.id, r.doc_id, r.quote) for i, r in enumerate(sorted(kept), 1)]
    return found, used


def run_case(model: Model, contract: Contract, period: str, dims: dict[str, str], first: str, tables: dict[str, DataFrame] | None = None, force: bool = False, provider: Provider | None = None, priors: DataFrame | None = None) -> Case:
    """A slice of one or more dimensions in a period. tables are the raw tables that causes are looked for in.

    Closes after verification unless that passed, or force. A provider may add notes to hypotheses and quote documents;
    no number depends on it, and quotes that aren't in their document are dropped. priors are those of reviewers'
    marks: a driver that they leave only its probe isn't tested. The few rows that decide how to go on are read on the driver.
    """
    case_id = "-".join([contract.id, period, *dims.values()])
    clock, spark = _Clock(case_id), next(iter(model.facts.values())).df.sparkSession
    mine = sliced(model, dims)
    checks = settled(verify(mine, contract, list(dims), period, first))
    head = checks.head(1)
    clock.stage("verify")
    if not force and not (head and head[0].passed):
        return Case(case_id, checks, notes={"closed": "at verification"}, telemetry=clock.frame(spark))
    previous = _before(period)
    free = [d for d in ("region", "segment", "product_id", "account_id") if d not in dims and all(mine.has(t, d) for t in contract.parsed.tables)]
    if not free:
        raise ValueError(f"{contract.id} has no dimension left to decompose by")
    nodes = settled(contributions(mine, contract, free, period, previous))
    covered = covering(nodes.where("dimension = 'account_id'"), ["dimension"]).select(F.col("key").alias("account_id"), "delta")
    kind = (model.accounts if model.accounts is not None else mine.facts[contract.parsed.tables[0]].df).schema["account_id"].dataType
    covered = settled(covered.withColumn("account_id", F.col("account_id").cast(kind)))
    clock.stage("decompose")
    if tables is None:
        return Case(case_id, checks, nodes, covered, telemetry=clock.frame(spark))

    start, end = _window(period)
    at = Footprint(covered.select("account_id"), start, end)
    answer, usage = provider.complete("hypothesise", f"{contract.id} {period} " + " ".join(d.id for d in contract.drivers), {"hypotheses": [{"driver": "string", "rationale": "string"}]}) if provider else ({}, Usage())
    hypotheses = enumerated(contract, answer.get("hypotheses", []))
    clock.stage("hypothesise", [usage])
    drivers = [d for d in contract.drivers if d.probe]
    if not drivers:
        raise ValueError(f"{contract.id} has no driver with a probe")
    probed = settled(probes.evidence(tables, drivers, at))
    clock.stage("probe")
    quoted, used = extracted(tables, drivers, at, provider) if provider else ([], [])
    clock.stage("extract", used)
    shallow = {r.driver for r in priors.where((F.col("kpi") == contract.id) & (F.col("depth") == "probe_only")).select("driver").distinct().collect()} if priors is not None else set()  # drivers of a contract
    onset, where, strength = detected(tables, [d for d in drivers if d.id not in shallow], at)
    names = spark.createDataFrame([(d.id, d.probe == "price_delta") for d in drivers], "driver string, is_price boolean")
    nothing = names.where("false").withColumn("outcome", F.lit(""))
    hit = effects(tables, at)
    panel = kpi_panel(mine, contract, ["account_id"], terms=term_panel(mine, contract, definitions(contract), ["account_id"], months=(previous, period))).where(F.col("period").isin(period, previous))
    values = panel.groupBy("account_id").agg(F.coalesce(F.max(F.when(F.col("period") == previous, F.col("value"))), F.lit(0.0)).alias("pre"), F.coalesce(F.max(F.when(F.col("period") == period, F.col("value"))), F.lit(0.0)).alias("post"))
    results = {
        "timing": nothing if onset is None else timing(onset, onset.select("driver").crossJoin(hit)),  # drivers of a contract
        "locality": nothing if where is None else locality(where, covered),
        "dose": nothing if strength is None else dose(strength, covered),
    }
    tested = settled(matrix(results, names, control(values, model.accounts, covered)))
    items = as_evidence(tested)
    clock.stage("challenge")
    facts = ["id", "driver", "outcome", "supports", "contradicts", "method"]
    quotes = spark.createDataFrame([(i, d, "found", d, None, "extraction") for i, d, *_ in quoted], ", ".join(f"{n} string" for n in facts))
    ledger = settled(items.unionByName(probed, allowMissingColumns=True).unionByName(quotes, allowMissingColumns=True))
    support = ledger.where("outcome = 'found' AND supports IS NOT NULL AND method <> 'did'").select("driver").distinct().withColumn("found_support", F.lit(True))
    total = nodes.where("dimension = 'account_id'").agg(F.sum("delta").alias("total_delta"))
    part = covered.agg(F.sum("delta").alias("footprint_delta"))
    price = _price_effect(mine, contract, period, previous)
    price = spark.range(1).select(F.lit(None).cast("double").alias("price")) if price is None else price
    one = lambda df: F.broadcast(df)  # noqa: E731  one row each
    rows = tested.join(support, "driver", "left").join(names, "driver").crossJoin(one(total)).crossJoin(one(part)).crossJoin(one(price)).crossJoin(one(checks.select("ceiling").limit(1)))
    rows = rows.withColumns({
        "case_id": F.lit(case_id),
        "found_support": F.coalesce("found_support", F.lit(False)),
        "unmodelled": F.lit(hypotheses[-1]["driver"] == UNMODELLED),
        "price_effect": F.when(F.col("is_price"), F.col("price")),
    }).drop("is_price", "price")
    ranked = settled(adjudicate(rows, ["case_id"]).withColumn("priority", priority(F.col("total_delta"), F.col("confidence"))))
    who = F.lit(_listed(covered))
    asked, advice = questions(ranked, contract, who), recommend(ranked, contract, who)
    clock.stage("adjudicate")
    return Case(case_id, checks, nodes, covered, tested, ledger, ranked, asked, advice, hypotheses=hypotheses, quotes=quoted, telemetry=clock.frame(spark))


#: So many accounts are named in a sentence; of more, their number is.
NAMED = 20


def _listed(covered: DataFrame) -> str:
    first = sorted(str(r.account_id) for r in covered.orderBy(F.desc(F.abs("delta")), "account_id").limit(NAMED).collect())
    more = covered.count() - len(first)
    return ", ".join(first) + (f" and {more} more" if more else "")


def facts_of(case: Case, contract: Contract, dims: dict[str, str], period: str) -> dict:
    """What menu() reads of a case: a few rows of a contract's drivers."""
    head = case.verification.first()
    out = {"case_id": case.case_id, "kpi": contract.id, "period": period, "dimensions": dims, "delta": head.delta or 0.0, "relative": head.relative or 0.0, "priority": 0.0}
    if case.verdict is None:
        return out
    rows = [r.asDict() for r in case.verdict.orderBy("rank").collect()]
    if rows:
        out |= {"confidence": rows[0]["confidence"], "causes": rows, "priority": rows[0]["priority"], "delta": rows[0]["total_delta"] or out["delta"]}
    for name, df in (("recommendation", case.recommendation), ("question", case.question)):
        found = df.limit(1).collect()
        if found:
            out[name] = found[0].asDict()
    return out


def told(case: Case, contract: Contract, persona: Persona, dims: dict[str, str], period: str, provider: Provider | None = None, domain: str | None = None, accounts: DataFrame | None = None) -> tuple[dict[str, str], DataFrame | None, str]:
    """A case as one viewer may have it: its page, its contributions, and the statement of what is withheld.

    A viewer whose rows exclude the case isn't told anything. Keys of accounts outside the viewer's domain become one
    row; account names and amounts that aren't theirs an alias and a band.
    """
    check_case(contract, persona, {d: v for d, v in dims.items() if d in contract.access.row})
    withheld, nodes = [], case.contributions
    grant = contract.access.domain.get(domain or "", {}).get(persona.role_key)
    if nodes is not None and grant is not None and accounts is not None:
        of = accounts.select(F.col("account_id").cast("string").alias("key"), F.lit("account_id").alias("dimension"), F.col(domain))
        marked = nodes.join(of, ["dimension", "key"], "left")
        n = marked.where(F.col(domain).isNotNull() & ~F.col(domain).isin(grant)).count()
        nodes = collapse(marked, grant, domain)
        withheld += [("domain", domain, n)] if n else []
    facts = facts_of(case, contract, dims, period)
    may = lambda name: persona.role_key in contract.access.column.get(name, [])
    if nodes is not None:
        if not may("account_name"):
            n = nodes.where("dimension = 'account_id'").count()
            hashed = F.when((F.col("dimension") == "account_id") & ~F.col("key").contains("restricted"), alias(F.col("key"))).otherwise(F.col("key"))
            nodes = nodes.withColumn("key", hashed)
            withheld += [("column", "account_name", n)] if n else []
            for name, key in (("recommendation", "action"), ("question", "question")):
                if name in facts:
                    ids = [str(r.account_id) for r in case.footprint.orderBy(F.desc(F.abs("delta")), "account_id").limit(NAMED).collect()]
                    for i in sorted(ids, key=len, reverse=True):
                        facts[name][key] = re.sub(rf"(?<!\w){re.escape(i)}(?!\w)", "[restricted]", facts[name][key])
        if not may("amount_net"):
            nodes = nodes.withColumn("delta", band(F.col("delta")))
            withheld.append(("column", "amount_net", nodes.count()))
    answer = provider.complete("narrate", json.dumps(menu(facts, contract, persona), sort_keys=True, ensure_ascii=False), dict.fromkeys(FALLBACKS, "string"))[0] if provider else {}
    asked = sorted(cited(answer))  # as many as the written text has
    ids = {r.id for r in case.evidence.where(F.col("id").isin(asked)).select("id").distinct().collect()} if case.evidence is not None and asked else set()
    return page(facts, contract, persona, answer, ids), nodes, statement(withheld)


def aliased(footprint: DataFrame) -> DataFrame:
    return footprint.withColumn("account", alias(F.col("account_id"))).drop("account_id")


def replayed(model: Model, contracts: list[Contract], periods: list[str], first: str, batches: int = 0, seed: int = 0) -> DataFrame:
    """The sweep of each of several periods, as it would have run at the time, and then of a number of simulated ones, each
    after its month of billing came in (next_batch())."""
    out = [sweep(model, contracts, p, first) for p in periods]
    for n in range(batches):
        period, model = next_batch(model, seed + n)
        out.append(sweep(model, contracts, period, first))
    return functools.reduce(DataFrame.unionByName, out)
