"""Benchmark the headline queries.

Runs each query over the whole tables at ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and materialises it with the
``noop`` sink (full execution, no driver collect).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from agrolens.plans.registry import load_all  # noqa: E402
from agrolens.session import get_spark  # noqa: E402

HEADLINE = [
    "rule_top3",            # rule scoring + top-3 + yields (flagship)
    "baseline_accuracy",    # rule scoring + accuracy aggregate
    "validation_checks",    # fused validation suite
    "yield_median_by_crop", # skew-safe exact median
    "per_class_prf",        # evaluation metrics
    "latency_percentiles",  # global exact percentiles
    "export_scores",        # export opportunity scoring
    "location_profile",     # location enrichment joins
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=cpus)
    reg = load_all()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in reg]
    # Warm-up on the smallest scale factor: JVM JIT, codegen caches and the
    # Python workers start before timing (not counted).
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for n in names:
            reg[n].build(spark, warm_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    builds: dict[str, float] = {}
    runs: dict[str, float] = {}
    for n in names:
        t0 = time.time()  # building counts: some queries plan or fit there
        df = reg[n].build(spark, sf_dir)
        t1 = time.time()
        df.write.format("noop").mode("overwrite").save()
        t2 = time.time()
        times[n], builds[n], runs[n] = round(t2 - t0, 3), round(t1 - t0, 3), round(t2 - t1, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "build": builds, "run": runs, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
