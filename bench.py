"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from emberkeep.plans import catalog
from emberkeep.session import local_session

HEADLINE = [
    "search_topk", "search_threshold", "search_topk_batch", "similarity_join", "scan_rules", "detect_pii", "encode_table", "read_line_table",
    "request_metrics", "enforce_memory_ceiling", "retain_recent", "upsert_checkpoints", "current_status", "resolve_versions", "version_diff",
    "latest_asof", "document_text", "budget_status", "related_artefacts", "keyword_search",
]
REPEATS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="emberkeep-bench")
    queries = catalog.queries()
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(REPEATS):
            started = time.perf_counter()
            # The noop sink computes every row and column without collecting them.
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({
        "metric": "headline queries, median of 3", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
