"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tracesieve.session import build_session  # noqa: E402
from workload import catalog  # noqa: E402

HEADLINE = (
    "redact_log_fields", "token_count", "validate_logs", "log_quality_report", "log_summary", "trace_logs",
    "edits_for_case", "apply_reviews", "review_guidance", "list_runs", "regression_diff", "latest_result",
    "sample_random", "sample_failure_biased", "sample_diverse", "cluster_centroids", "nearest_centroid",
    "representatives", "similar_approved", "check_duplicates", "dedup_ordered", "similarity_pairs",
    "density_cluster", "score_candidates", "top_candidates", "run_cases",
    "similarity_pairs_raw", "dedup_ordered_raw", "sample_diverse_many", "trace_in_order", "llm_map", "generate_labels", "judge_labels",
    "embed_text", "ingest_stream", "upsert_by_key", "export_versioned",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
