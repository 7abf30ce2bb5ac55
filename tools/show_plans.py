"""Write PLANS.md: the physical plans of the core operators (sf0.01 inputs).
    python tools/show_plans.py [sf_dir]
"""

import io
import os
import re
import sys
from contextlib import redirect_stdout

import numpy as np

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from tallsketch.operators import leverage as L  # noqa: E402
from tallsketch.operators.lsqr import lsqr_pass  # noqa: E402,F401
from tallsketch.operators.shape import row_index  # noqa: E402
from tallsketch.operators.sketch import sketch  # noqa: E402
from tallsketch.operators.small_solve import exact_solve  # noqa: E402
from tallsketch.session import local_session  # noqa: E402
from tallsketch.sources.matrix import events_matrix, orders_matrix  # noqa: E402


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain()
    text = re.sub(r"#\d+L?", "", buf.getvalue())  # expression ids only add noise
    return "\n".join(line[:220] for line in text.splitlines())


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    om, ev = orders_matrix(spark, sf), events_matrix(spark, sf)
    feats = om.features()
    u = F.lit(0.5) * F.col("b")
    for i, f in enumerate(feats):
        u = u + F.lit(0.1 * (i + 1)) * f
    lsqr_like = om.df.select(*feats, u.alias("u")).agg(F.sum(F.col("u") * F.col("u")).alias("s"),
                                                       *[F.sum(F.col("u") * f).alias(f"g{i}") for i, f in enumerate(feats)])
    items = [
        ("Matrix view: orders x aggregated line items", "Pruned scans, partial aggregation before the shuffle, AQE join choice.", om.df),
        ("Count-sketch (k=2, c=200)", "Staged keyed hashes, Generate for the trials, partial aggregate, exchange on (trial, bucket).",
         sketch(ev, "cw", 200, 2, 42).df),
        ("Count-sketch with LSQR start sums (flagship first pass)",
         "One more generated row per input row (trial -1, sign = b): Aᵀb and bᵀb come out of the same aggregate.",
         sketch(om, "cw", 200, 1, 42, with_normal_sums=True).df),
        ("Gaussian sketch, Arrow path (c=50)", "MapInArrow partials per task, then the same aggregate.", sketch(ev, "gaussian", 50, 1, 42).df),
        ("Gaussian sketch, SQL path (c=50)", "explode(sequence) + staged entry expression + partial aggregate, all JVM.",
         sketch(ev, "gaussian", 50, 1, 42, method="sql").df),
        ("One LSQR pass (k=1, n=3)", "A single global aggregate with partial aggregation; p and q are literals.", lsqr_like),
        ("Leverage sample (cw factor)", "Quadratic form as an expression; the k-row leverage sum is the only broadcast.",
         L.leverage_sample(om, {0: np.eye(3) * 1e-3}, 500, 42)),
        ("Exact solution by TSQR", "MapInArrow R factors per task, then a per-trial combine.", exact_solve(om)),
    ]
    out = ["# Physical plans of the core operators", "",
           f"Generated by `tools/show_plans.py` on `{sf}` (`local[8]`); expression ids removed.", ""]
    for title, note, df in items:
        out += [f"## {title}", "", note, "", "```", plan(df), "```", ""]
    ev_ids = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")
    out += ["## Global row index", "", "Range partitioning + local sort, checkpoint, then one broadcast row per partition.",
            "", "```", plan(row_index(ev_ids, ["value", "event_id"], "idx")), "```", ""]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))


if __name__ == "__main__":
    main()
