"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from docketlab.plans import catalogue

HEADLINE = [
    "lien_position", "foreclosure_requirements", "page_hint", "page_ledger", "run_sheet_segment", "shard_pack", "fuzzy_grounding", "dedup_anchors", "majority_string", "merge_instruments",
    "reconcile_amounts", "chain_continuity", "qc_reduce", "accuracy_areas", "latest_decision", "graph_edges", "retrieve_pages", "export_warnings",
]
#: Queries of later rounds: timed too, and summed apart, so that the headline total stays comparable.
LATER = [
    "check_evaluation", "fold_entries", "reconcile_cascade", "record_checks", "foreclosure_rules", "six_audit_areas", "title_graph_edges", "relevant_graph_nodes", "instruments_merged", "question_pages", "anchor_ledger", "manifest_items", "profile_lines",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["lien_position"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the executors
    took = {}
    for name in HEADLINE + LATER:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took[n] for n in HEADLINE), 3), "later_total": round(sum(took[n] for n in LATER), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
