"""Benchmark the headline queries; prints ONE JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1)  BENCH_CPUS (default 8)  BENCH_RUNS (default 3)

Each query is timed end to end (plan construction, including eager model fits, plus full
execution into Spark's ``noop`` sink, so no driver collect distorts the number). One warm-up
pass runs every query first; the reported time per query is the median of BENCH_RUNS runs;
``value`` is the sum of the medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["predict", "evaluate", "ood_detect", "stratified_split", "domain_classifier_auc",
            "drift_ratio", "drift_detect", "ood_by_time_window", "rank_informative", "category_by_year"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from labelflow.plans import REGISTRY
    from labelflow.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus))

    from labelflow import session as sess
    from labelflow.plans import q_active, q_model

    def once(name: str) -> float:
        # forget fitted models / written score tables: every timed run does the full work
        sess._MATERIALISED.clear()
        q_model._MODELS.clear()
        q_active._LOGS.clear()
        t0 = time.perf_counter()
        REGISTRY[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for name in HEADLINE:  # warm-up: JVM, Python workers, code generation
        once(name)
    results = {}
    for name in HEADLINE:
        results[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(results.values()), 3),
                      "unit": "sec", "queries": results, "sf": sf, "cpus": cpus, "runs": runs,
                      "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
