"""Times the headline queries: one JSON line. Each is run once to warm up, then BENCH_RUNS times (3), and the median counts.

The session's start is not in the times. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores, BENCH_ALL=1 all queries.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "kpi_two_term_net", "kpi_ratio_month", "kpi_median_month", "kpi_epoch_switch", "movement_lag", "robust_z_panel", "materiality_gate", "peer_expectation", "stl_decomposition", "completeness_share", "artefact_check", "definition_drift",
    "verify_all_slices", "scan_status", "contribution_by_dim", "ratio_contribution", "greedy_footprint", "nested_contribution", "pvm_split", "cross_kpi_partition", "event_spike_ratio", "bm25_topk", "cosine_topk", "placebo_rank", "spearman_dose",
    "change_points", "challenge_matrix", "adjudicate_rubric", "row_entitlement", "domain_collapse", "case_upsert_latest",
]


def main() -> None:
    from tidemark import queries as engine
    from tidemark.session import session

    folder, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "16g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in sorted(engine.QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE:
        each = []
        for _ in range(runs + 1):
            begun = time.perf_counter()
            engine.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - begun)
        took[name] = round(median(each[1:]), 3)
    print(json.dumps({"metric": "sum of medians of warm runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
