"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is executed fully with the ``noop`` sink (no collect to the driver). The first query
also pays the JVM warm-up, so a warm-up query runs before timing starts.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "cost_by_model", "model_statistics", "hourly_cost_timechart", "budget_alerts", "top_users",
    "customer_360", "inventory_status", "reconcile_summary", "ticket_triage",
    "dlp_violations", "document_pii_risk", "protected_documents",
    "model_routing", "document_chunks", "secure_chunk_search", "embedding_knn",
    "item_similarity", "popularity_evaluation", "hybrid_recommendations",
    "cleaned_orders", "revenue_pivot_region_channel", "doc_quality_metrics", "doc_quality_lift",
    "seasonal_naive_metrics", "ridge_backtest_summary", "windowed_alerts", "remediation_decisions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["--all"]:
        names = None
    from tessera.session import get_session
    spark = get_session(f"local[{cpus}]", int(cpus) * 2, driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
    from tessera.plans.catalog import QUERIES
    names = names or list(QUERIES)
    QUERIES["cost_by_model"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for n in names:
        t0 = time.perf_counter()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
