"""Seconds for the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import time
from pathlib import Path

from mailprism.plans import catalog
from mailprism.session import session, ship

QUERIES = [
    "shared_infrastructure", "two_hop_counts", "ioc_timeline", "temporal_correlation", "hunt_without", "reputation", "bfs_levels", "mail_graph_stats",
    "dq_length_stats", "exact_dedup", "group_split", "jaccard_contamination", "near_dedup_greedy", "url_extract", "html_text", "bec_keyword_counts",
    "content_structure", "pii_masking", "hop_chain", "chain_build", "budget_topn", "intel_agreement", "roc_auc", "threshold_sweep", "feature_summary",
    "ks_wasserstein", "risk_canonical", "fusion_strategies", "features", "session_counts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    spark.range(1000).selectExpr("sum(id)").collect()  # the first job compiles and starts threads
    seconds = {}
    for name in QUERIES:
        began = time.perf_counter()
        catalog.REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(folder).name}))
    spark.stop()


if __name__ == "__main__":
    main()
