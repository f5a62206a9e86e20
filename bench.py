"""Times the headline queries and prints one JSON line.

Each query is built and run to the end once after a short warm-up of the session;
building is part of the time, because some operators count a side before they
choose a join.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = ["event_tokens", "possessions", "possession_breakdown", "freeze_frame_features",
            "filtered_candidates", "document_vocab", "tfidf_postings", "sparse_search",
            "similar_sparse", "dense_topk", "hybrid_rrf", "shape_search", "search_job",
            "search_notes", "rubric_matrix", "rubric_statistics", "ranking_metrics",
            "possession_detail", "playback_steps", "xg_metrics", "xg_auc", "calibration_bins",
            "phrase_hits", "nearest_binding", "entity_longest", "plan_queries"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("fieldseq-bench")
             .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
             .config("spark.ui.enabled", "false")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from fieldseq.plans.catalog import QUERIES
    QUERIES["event_tokens"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    wanted = sys.argv[1:] or HEADLINE
    took = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {took[name]}", file=sys.stderr)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
