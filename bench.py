"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "ag_2_noisy_or", "pl_6_rescore", "ag_5_top_category_counts", "ag_9_coverage",
    "ag_11_precision_by_level", "ag_13_what_if_weights", "pl_9_search", "so_2_markers_topk",
    "jn_1_city_box_join", "jn_4_link_match", "jn_5_nearby_match", "pl_1_resolve_entities", "fn_4_keyword_signals",
    "fn_22_page_text", "sc_3_places_to_listing", "pl_2_detect_and_place", "pl_2_scan_to_score", "st_1_missing_records",
    "ag_20_monthly_quota",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("vouch-bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.files.maxPartitionBytes", "4m")
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from vouch.workload import QUERIES

    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    took: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    listings = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(took.values()), 3),
        "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf"),
        "listings_per_sec_scan_to_score": round(listings / took["pl_2_scan_to_score"]),
    }))


if __name__ == "__main__":
    main()
