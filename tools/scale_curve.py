"""Scale curve on generated ill-conditioned matrices (G1 over spark.range keys): seconds per
sketch kind, per LSQR pass and for TSQR.  A measurement tool, not a catalogue query.
    python tools/scale_curve.py 1000000 10 [cores]
"""

import json
import os
import sys
import time

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallsketch.operators.generate import gen_matrix  # noqa: E402
from tallsketch.operators.lsqr import lsqr_pass  # noqa: E402
from tallsketch.operators.sketch import sketch  # noqa: E402
from tallsketch.operators.small_solve import exact_solve, factors_to_numpy, solve_sketch  # noqa: E402
from tallsketch.plans.solve import JobParams, solve  # noqa: E402
from tallsketch.session import local_session  # noqa: E402


def timed(fn):
    t = time.time()
    fn()
    return round(time.time() - t, 2)


def main():
    m, n = int(sys.argv[1]), int(sys.argv[2])
    cores = sys.argv[3] if len(sys.argv) > 3 else "8"
    spark = local_session(cores, shuffle_partitions=int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    keys = spark.range(0, m, 1, int(cores) * 4).withColumnRenamed("id", "k")
    mf = gen_matrix(keys, "k", n, seed=1).persist()
    out = {"m": m, "n": n, "cores": cores, "layout": mf.layout}
    out["materialize_s"] = timed(lambda: mf.df.count())
    for kind, c in (("cw", 400), ("gaussian", 200), ("rademacher", 200), ("srdht", 200)):
        out[f"sketch_{kind}_c{c}_s"] = timed(lambda: sketch(mf, kind, c, 1, 3).df.collect())
    sk = sketch(mf, "cw", 400, 1, 3)
    out["sketch_solve_cw_s"] = timed(lambda: solve_sketch(sk).collect())
    N = factors_to_numpy(solve_sketch(sk), n)
    P = np.stack([N[0] @ np.ones(n)])
    lsqr_pass(mf, P, np.ones(1))
    out["lsqr_pass_s"] = round(np.median([timed(lambda: lsqr_pass(mf, P, np.ones(1))) for _ in range(3)]), 2)
    out["tsqr_exact_s"] = timed(lambda: exact_solve(mf).collect())
    p = JobParams(precision="high", sketch="projection", kind="cw", c=400, iters=12, seed=3, persist=False)
    out["ls_high_cw_q12_s"] = timed(lambda: solve(mf, p).solutions.collect())
    print(json.dumps(out))


if __name__ == "__main__":
    main()
