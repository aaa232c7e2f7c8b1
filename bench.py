"""Times headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = ("day_buckets", "library_counts", "timeline_page", "ranked_timeline", "index_of", "moments", "trips", "suggestions", "burst_pairs", "components", "near_dup_pairs", "exact_dups", "verify_dups", "vector_topk", "similar", "indexed_topk", "similar_pairs", "loose_mates", "text_index", "bm25_search", "hybrid_search", "reconcile", "geocode", "bracket_series", "memory_proposals", "cleanup_report")


def main() -> None:
    root = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, root)
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (root, os.environ.get("PYTHONPATH"))))  # workers import the package from any folder
    from lightframe.plans.queries import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    names = sys.argv[1:] or HEADLINE
    QUERIES["day_buckets"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts workers and code paths
    for name in names:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0) if os.path.basename(sf_dir.rstrip("/")).startswith("sf") else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
