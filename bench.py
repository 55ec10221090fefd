"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from vecloom.plans import queries as engine

HEADLINE = [
    "knn_graph_k10", "knn_query_batch", "graph_stats", "rng_edges", "hnsw_prune", "connected_components_k1", "mst_exact", "mst_knn_kruskal", "core_distance",
    "mutual_reachability_heights", "dendrogram_single_linkage", "cophenetic_distances", "flat_cut_k5_min10", "bridged_msf_k1", "index_dendrogram", "layered_index", "index_queries",
    "quality_pearson", "ari_vs_label", "pareto_frontier", "best_time_over_threshold", "grouped_max_inner", "param_json_flatten",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    made = engine.queries()
    made["graph_stats"](spark, d).write.format("noop").mode("overwrite").save()  # starts the JVM's and Python's workers
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        made[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
