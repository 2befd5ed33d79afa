"""Times the headline queries on BENCH_SF_DIR with local[BENCH_CPUS]; prints one JSON line.

A query is timed from its definition to the end of a write to the noop sink, so every column of every row is made.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from stepweave.plans import queries as core

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "edges_bookends", "nodes_fold", "edge_weight_clean", "edge_modal_condition", "pitfall_failure_prone", "pitfall_repetition_loop", "ngram_o3", "backoff_rank",
    "edit_verify_rate", "fusion_rrf", "holdout_eval", "recall_position", "order_chains", "lineitem_chains", "credential_screen", "leak_containment",
)


def main() -> None:
    folder = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", folder).config("spark.checkpoint.dir", f"file://{folder}/checkpoints").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF}/events.parquet").groupBy("event_type").count().collect()  # start the executors
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        core.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
