"""Times the headline queries and prints one JSON line.

Settings: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.catalog import QUERIES  # noqa: E402
from tessera.session import local_session  # noqa: E402

HEADLINE = [
    "sparse_topk", "dense_topk", "hybrid_rrf", "hybrid_filtered", "rag_context", "redact_text", "html_strip", "doc_sections",
    "sliding_windows", "code_chunks", "python_edges", "graph_for_files", "incremental_refresh", "upsert_latest", "merge_nodes",
    "merge_edges", "detach_delete", "call_graph", "file_history", "explore", "degree_top", "global_stats", "repo_status",
    "health_evidence", "event_retention", "job_status", "quota_rejections", "push_changes",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.read.parquet(f"{folder}/region.parquet").count()  # start the executors before timing
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
