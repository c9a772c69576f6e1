"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS
(default 8) the local cores. Each query is run to completion into the noop
sink; the better of two runs counts. ``rates`` compares with the
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "document_overview",
    "page_upsert",
    "assembled_documents",
    "stage1_text",
    "rule_merged_text",
    "resume_pages",
    "page_batches",
    "batch_status",
    "batch_progress",
    "batch_results",
    "job_results",
    "latest_metrics",
    "last_samples",
    "job_log_summary",
    "memory_deltas",
    "metrics_history",
    "expired_files",
    "job_by_id",
    "events_of_job",
    "old_events",
    "block_types",
    "chat_commands",
    "scored_pages",
    "checkpoint_marks",
    "text_snapshots",
    "text_snapshot_stream",
    "stream_rows",
    "reassembled_text",
)


def main() -> None:
    from pagemill.plans import all_queries
    from pagemill.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = sys.argv[1:] or HEADLINE
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    seconds: dict[str, float] = {}
    for name in queries if wanted == ["all"] else wanted:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            queries[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)

    rows = {
        t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("lineitem", "events", "documents")
    }
    table_of = {
        "page_upsert": ("upserts_per_s", "lineitem"),
        "assembled_documents": ("documents_assembled_per_s", "documents"),
        "metrics_history": ("log_rows_scanned_per_s", "events"),
        "job_log_summary": ("log_rows_summarised_per_s", "events"),
        "expired_files": ("files_checked_for_expiry_per_s", "documents"),
        "old_events": ("items_checked_for_age_per_s", "events"),
    }
    ratio = {}
    if "text_snapshots" in seconds:
        from pagemill.sources.standins import line_chunks

        chunks = line_chunks(spark, sf_dir).count()
        ratio["snapshots_per_chunk"] = round(queries["text_snapshots"].build(spark, sf_dir).count() / max(1, chunks), 4)
    rates = ratio | {label: round(rows[t] / seconds[q]) for q, (label, t) in table_of.items() if q in seconds}
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "rates": rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
