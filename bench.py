"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparksymbols.plans import QUERIES
from sparksymbols.session import build_session

HEADLINE = (
    "F1_content_hash",
    "F2_git_blob_id",
    "F9_line_number",
    "F13_brace_block",
    "S1_tree_scan",
    "S5_index_sink_keyed",
    "P8_file_summary",
    "P9_search_exports",
    "P12_repo_metrics",
    "J1_snapshot_diff",
    "J4_change_gate",
    "J5_missing_only",
    "J7_cascade_delete",
    "J8_import_resolution",
    "A4_outcome_tally",
    "A6_repo_rollup",
    "A7_batch_progress",
    "W3_latest_per_key",
    "W4_first_occurrence",
    "M1_upsert",
    "M2_patch",
    "X1_ts_exports",
    "X3_py_exports",
    "X5_class_members",
    "X11_rich_signature",
    "X13_py_typed_defs",
    "X14_named_imports",
    "N2_flatten_imports",
    "E1_index_files",
    "T1_change_stream_index",
    "T2_ordered_gate",
    "T3_lease_grant",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.sparksymbols.input.tasks": cpus,  # the tables are single files, which one task would read
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's threads and code paths before the first measured query.
    QUERIES["A1_language_distribution"](spark, folder).write.format("noop").mode("overwrite").save()
    wanted = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in wanted:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "total_query_time", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder)}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
