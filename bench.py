"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
window covers expiry, refill, query, explanation and eviction together.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tripletide.operators.quality import MEASURES
from tripletide.plans.replay import replay
from tripletide.plans.spec import WindowSpec
from tripletide.scratch import store
from tripletide.workload.queries import registered, truth
from tripletide.workload.tables import EXPLAIN_CLASS, QUERY_CLASS, clock_entries, event_quads, table, tbox

HEADLINE = (
    "match_distinct", "bgp_join", "count_quads", "instances_of", "instances_of_trade", "explain_leaves",
    "graph_usage", "window_quality", "assign_graphs", "assign_graphs_keyed", "transitive_closure_prop",
    "restriction_types", "evict_lfu", "evict_net_of_expired", "nt_scan", "quad_store_scan",
)


# Published settings to compare: policy, triples per graph, graphs, evicted graphs, evictions.
SETTINGS = (
    ("FEFO", 1, 10, 2, 10), ("FEFO", 10, 100, 50, 5), ("FEFO", 100, 1000, 750, 3),
    ("LRU", 10, 100, 50, 5), ("LFU", 100, 1000, 750, 3),
)


def published_setting(policy: str, n: int, size: int, out: int, evictions: int):
    def run(spark: SparkSession, sf_dir: str):
        quads = event_quads(spark, sf_dir, n)
        spec = WindowSpec(size, out, policy, QUERY_CLASS, EXPLAIN_CLASS, n, evictions)
        known = store(truth(spark, sf_dir), "truth").df
        return replay(quads, clock_entries(quads), tbox(spark, "events"), spec, known)

    return run


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tripletide-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()
    for which in ("events", "trade"):
        tbox(spark, which)
    queries["instances_of"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds: dict[str, float] = {}
    windows: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)

    def timed_windows(name: str, run) -> None:
        start = time.perf_counter()
        rows = run(spark, sf_dir).select("epoch", *MEASURES).collect()
        seconds[name] = round(time.perf_counter() - start, 3)
        windows[name] = round(1000 * seconds[name] / len(rows), 1)

    for name in HEADLINE:
        timed(name, queries[name])
    timed_windows("window_replay", queries["window_replay"])
    timed_windows("policy_sweep", queries["policy_sweep"])
    for policy, *setting in SETTINGS:
        timed_windows(f"replay_{policy.lower()}_{'_'.join(map(str, setting[:3]))}", published_setting(policy, *setting))
    n_triples = table(spark, sf_dir, "events").count() * 3
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "ms_per_window": windows,
                "triples": n_triples,
                "triples_per_sec_instances_of": round(n_triples / seconds["instances_of"]),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
