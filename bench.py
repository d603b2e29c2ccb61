"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
{"metric": "...", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is fully materialised with a ``noop`` write (no collect to the
driver), timed after one untimed warm-up run of the flagship on sf0.001;
query times include building inputs that are written once per query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "b05_score",                # flagship: score per project from the supplier graph
    "a06_detect",               # extraction + resolution + all detectors on code files
    "j08_cycles",               # iterative SCC on the part graph
    "h03_module_history",       # change history aggregation + windows
    "h05_change_coupling",      # pair counting per commit
    "w07_suggest_rules",        # snapshot history windows
    "w09_project_context",      # text assembly per project
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("REPOLENS_SCRATCH", tempfile.mkdtemp(prefix="bench-"))
    from repolens.plans import all_queries
    from repolens.session import get_spark
    spark = get_spark("repolens-bench", master=f"local[{cpus}]",
                      shuffle_partitions=int(os.environ.get("BENCH_PARTITIONS", "16")))
    qs = all_queries()
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    # untimed warm-up: JVM JIT and codegen caches, on the smallest tables
    qs["b05_score"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
