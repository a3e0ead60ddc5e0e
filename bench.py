"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from loomgraph.plans.session import local_session
from loomgraph.plans.workspace import Workspace
from loomgraph.queries import QUERIES, edges_of
from loomgraph.streaming.ingest import EdgeStore

INGEST_EDGES = 10_000_000

HEADLINE = [
    "degree_all", "ordered_neighbors", "sample_k", "symmetrize", "csr_offsets", "degree_histogram_all", "unit_cumulative", "work_imbalance",
    "bfs", "bfs_multi20", "pagerank_gap", "pagerank_push", "connected_components", "triangle_count", "triangle_count_merge", "load_dataset", "ingest_throughput",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    times: dict[str, float] = {}
    for name in HEADLINE:
        if os.path.isdir(warm):
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    edges = edges_of(spark, sf_dir).count()
    # Ingest of ten million edges, as one batch, so that fixed costs weigh little.
    end = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000))
    batch = spark.range(INGEST_EDGES).select(end(1).alias("src"), end(2).alias("dst"))
    store = EdgeStore(spark, f"{Workspace(spark, 'bench').root}/table")
    start = time.perf_counter()
    store.append(batch, 0)
    times["ingest_10m"] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline graph queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")), "edges": edges, "ingest_meps": round(INGEST_EDGES / times["ingest_10m"] / 1e6, 3),
            }
        )
    )


if __name__ == "__main__":
    main()
