"""
E1 on documents, M17 on features, plus M10 and the fold assignment).

Each query runs to completion through the ``noop`` sink (every row computed,
nothing collected).  Prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES (comma list, optional)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("evaluate", "fairness_summary", "counterfactual_notes", "mean_pool", "iterative_mute",
            "reject_option_grid", "stratified_folds", "group_auc")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]

    from equilibra.plans.registry import load_all
    from equilibra.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=max(8, cpus))
    queries = load_all()
    # warm-up: JVM start, class loading and code generation paths
    queries["group_confusion"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()

    timings: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        queries[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
