"""Benchmark: headline catalogue queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Each query is run to completion (collect) twice after one warm-up of the session; the
faster run is reported (the first run also pays Python-worker start-up).
"""

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallsketch.plans import catalogue  # noqa: E402
from tallsketch.session import local_session  # noqa: E402

HEADLINE = [
    "ls_high_cw", "ls_high_plain", "ls_high_sampling", "ls_low_cw", "ls_low_gaussian", "ls_low_rademacher",
    "ls_low_srdht", "ls_low_sampling_cw", "exact_solution", "sketch_cw", "sketch_gaussian", "leverage_scores",
    "residual_norms", "row_index", "eval_median_low",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "2"))
    spark = local_session(cpus, shuffle_partitions=max(2, int(cpus) if cpus.isdigit() else 8))
    spark.sparkContext.setLogLevel("ERROR")
    qs = catalogue.queries()
    names = sys.argv[1:] or HEADLINE
    qs["exact_solution"](spark, sf_dir).collect()  # warm-up: JVM, codegen, Arrow Python workers
    times, failed = {}, {}
    for name in names:
        best = None
        try:
            for _ in range(reps):
                t = time.time()
                qs[name](spark, sf_dir).collect()
                dt = time.time() - t
                best = dt if best is None else min(best, dt)
            times[name] = round(best, 3)
        except Exception as e:  # keep measuring the others; report the failure
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
