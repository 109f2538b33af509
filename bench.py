"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The tables come as one Parquet row group each, which Spark can't split, so that text queries would run on one core
whatever there is.  They are laid out first as tables of many row groups are, a file for each core; that isn't timed.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

from quire.plans import queries

NAMES = ["text_stats", "lane_histogram", "review_override", "describe_text", "agreement_jaccard", "segment_runs", "manifests", "eval_metrics", "isotonic_curves", "near_duplicates", "route_once_per_file", "bomb_predicate", "job_state", "gcra_waits", "routed_pages", "state_assembly", "page_states", "eval_report", "vision_schema"]


def laid_out(spark: SparkSession, folder: str, out: str, files: int) -> None:
    for name in sorted(os.listdir(folder)):
        rows = spark.read.parquet(f"{folder}/{name}")
        rows.repartition(files, rows.columns[0]).write.parquet(f"{out}/{name}")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    work = tempfile.mkdtemp(prefix="quire-bench-")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.checkpoint.dir", f"{work}/checkpoint").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        laid_out(spark, folder, f"{work}/tables", int(cpus))
        tables = f"{work}/tables"
        queries.doc_pages(spark, tables).write.format("noop").mode("overwrite").save()  # starts the JVM's pools
        took = {}
        for name in NAMES:
            began = time.time()
            queries.QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
        pages = queries.doc_pages(spark, tables).count()
    finally:
        spark.stop()
        shutil.rmtree(work, ignore_errors=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1], "pages": pages, "pages_per_sec_routing": round(pages / took["review_override"], 1), "note": f"no rendering, OCR or model call is included; tables laid out in {cpus} files first"}))


if __name__ == "__main__":
    main()
