import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators.kept import KeptPanel
from tidemark.operators.scan import sweep
from tidemark.plans.gathered import gathered
from tidemark.sources.star import CONTRACTS, CURRENT, FIRST, model
from tidemark.streaming.scheduled import on_arrival, stream_of

NAMES = ["net_sales", "discount_rate", "mean_quantity"]


def _rows(df):
    return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.001"
    m, contracts = model(spark, sf), [CONTRACTS[n] for n in NAMES]
    panel = KeptPanel(spark, str(tmp_path_factory.mktemp("kept") / "panel"), contracts, ["region"])
    early = F.col("ingested_on") <= "2000-01-31"
    for version, when in ((1, early), (2, ~early)):
        for name in ("sales", "refunds"):
            panel.add(m, name, m.facts[name].df.where(when), version)
    return m, contracts, panel, early


def test_a_sweep_of_kept_rows_is_that_of_all(kept):
    m, contracts, panel, _ = kept
    assert _rows(sweep(m, contracts, CURRENT, FIRST, kept=panel)) == _rows(sweep(m, contracts, CURRENT, FIRST))


def test_a_batch_that_comes_again_changes_nothing_and_merging_neither(spark, kept):
    m, contracts, panel, early = kept
    want = _rows(gathered(m, contracts, ["region"], "1999-01", "2001-07").panels(contracts))
    got = lambda: _rows(panel.gathered(m, "1999-01", "2001-07").panels(contracts))
    assert got() == want
    panel.add(m, "sales", m.facts["sales"].df.where(early), 1)
    assert got() == want
    panel.merged(m)
    assert got() == want
    panel.add(m, "sales", m.facts["sales"].df.where(early), 1)  # merged since: left out
    assert got() == want
    more = m.facts["sales"].df.where("sold_on >= '2001-07-01' AND sold_on < '2001-08-01'")
    panel.add(m, "sales", more, 3)
    now = {r.period: r.value for r in panel.gathered(m, "2001-06", "2001-07").panels(contracts).where("kpi = 'net_sales'").groupBy("period").agg(F.sum("value").alias("value")).collect()}
    before = {r.period: r.value for r in gathered(m, contracts, ["region"], "2001-06", "2001-07").panels(contracts).where("kpi = 'net_sales'").groupBy("period").agg(F.sum("value").alias("value")).collect()}
    assert now["2001-06"] == pytest.approx(before["2001-06"]) and now["2001-07"] > before["2001-07"]


def test_only_the_months_that_are_asked_for_are_read(spark, kept, tmp_path):
    m, contracts, panel, _ = kept
    rows = panel.gathered(m, "2001-05", "2001-07").rows
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan and "l_orderkey" not in plan and "o_orderkey" not in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        execution = panel.gathered(m, "2001-05", "2001-07").rows._jdf.queryExecution()
        leaves = execution.executedPlan().collectLeaves()
        files = [p for i in range(leaves.size()) for p in re.findall(r"period=[\d-]+", "\n".join(leaves.apply(i).relation().location().inputFiles()))]
        selected = {leaves.apply(i).selectedPartitions().toString() for i in range(leaves.size())} if hasattr(leaves.apply(0), "selectedPartitions") else set()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(set(files)) > 3 or selected


def test_batches_of_a_stream(spark, tmp_path):
    m, contracts = model(spark, "/root/testdata/sf0.001"), [CONTRACTS["gross_sales"]]
    folder = str(tmp_path / "in")
    lines = m.facts["sales"].df
    lines.repartition(3).write.parquet(folder)
    panel = KeptPanel(spark, str(tmp_path / "panel"), contracts, ["region"])
    on_arrival(stream_of(spark, folder, 1), lambda df, v: panel.add(m, "sales", df, v + 1), str(tmp_path / "cp")).awaitTermination()
    got, want = panel.gathered(m, FIRST, CURRENT).panels(contracts), gathered(m, contracts, ["region"], FIRST, CURRENT).panels(contracts)
    assert _rows(got) == _rows(want)


def test_medians_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="median_price"):
        KeptPanel(spark, str(tmp_path), [CONTRACTS["median_price"]], ["region"])
    with pytest.raises(FileNotFoundError):
        KeptPanel(spark, str(tmp_path / "none"), [CONTRACTS["gross_sales"]], ["region"]).gathered(model(spark, "/root/testdata/sf0.001"), FIRST, CURRENT)
