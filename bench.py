"""Times the headline queries and prints one JSON line.

Every query is written to the no-op sink, so all of its columns are computed. The first one is run once
beforehand; a query of under ten seconds counts by the median of three runs.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from cartorio.gallery import QUERIES
from cartorio.session import build_session

HEADLINE = [
    "classify_documents", "classified_documents", "classify_fuzzy", "classification_candidates", "normalized_text", "text_lines", "pii_findings", "pii_summary",
    "name_scan", "duplicate_content", "identifier_audit", "date_audit", "money_audit", "document_listing", "daily_numbering", "latest_per_key",
    "retention_resolve", "purge_apply", "erasure_execute", "fan_out", "lifecycle_fold", "metrics", "problems", "spatial_neighbours", "gap_clusters",
    "cell_assignment", "extract_fields", "classify_by_join", "replay_guard", "fuzzy_sql_function", "read_recall", "canonical_result", "reprocess_outcomes",
]
TABLES = ["documents", "events", "lineitem", "orders", "customer", "benchmark", "conversations"]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    wanted = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run(wanted[0])
    seconds = {}
    for name in wanted:
        times = [run(name)]
        if times[0] < 10:
            times += [run(name), run(name)]
        seconds[name] = round(median(times), 3)
    rows = {name: spark.read.parquet(f"{root}/{name}.parquet").count() for name in TABLES}
    scale = root.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "input_rows": rows, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
