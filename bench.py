"""Headline queries, timed: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = (
    "edge_dedupe", "edge_lift", "fan_instability", "top_nodes", "graph_layers", "graph_dependents", "pagerank", "line_counts", "word_entropy", "cvss_scores",
    "secret_scan", "rule_scan_capped", "code_rules", "signature_scan", "imports_python", "symbols", "endpoints", "manifest_dependencies", "import_resolution",
    "reconcile", "advisories", "forward_fill", "top_per_group", "dedupe_findings", "ignore_rules", "capabilities", "review_merge", "spdx",
)


def main() -> None:
    from codecensus.plans.all_queries import QUERIES
    from codecensus.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    took: dict[str, float] = {}
    for name in names:
        start = time.time()
        # Every row and column is computed; nothing is sent to the driver.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").count() + spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    scan = took.get("code_rules", 0) + took.get("signature_scan", 0)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")),
        "files_per_minute": round(files / scan * 60) if scan else None,
    }))


if __name__ == "__main__":
    main()
