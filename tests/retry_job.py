"""Run by test_retries.py in its own process: a session whose tasks may be retried
(local[2, 3]) and a source whose first attempt of every task fails."""

import json
import os
import sys
import tempfile

sys.path.insert(0, sys.argv[1])

import numpy as np  # noqa: E402
from pyspark import TaskContext  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from tallsketch.operators.lsqr import lsqr  # noqa: E402
from tallsketch.operators.sketch import sketch  # noqa: E402
from tallsketch.operators.small_solve import factors_to_numpy, solve_sketch  # noqa: E402
from tallsketch.sources.matrix import orders_matrix  # noqa: E402


def make_flaky(marker_dir):
    # accumulators of failed attempts are discarded, so failures leave marker files
    # (single machine: this is a local-mode test)
    def flaky(batches):
        ctx = TaskContext.get()
        if ctx.attemptNumber() == 0:
            open(os.path.join(marker_dir, f"fail-{ctx.stageId()}-{ctx.partitionId()}"), "w").close()
            raise RuntimeError("simulated executor loss")
        yield from batches
    return flaky


def snapshot(mf):
    sk = sketch(mf, "gaussian", 30, 2, 7)
    rows = sorted((r["trial"], r["bucket"], *[round(r[f"v{i}"], 6) for i in range(4)]) for r in sk.df.collect())
    N = factors_to_numpy(solve_sketch(sketch(mf, "cw", 100, 1, 7)), 3)
    hist = lsqr(mf, N, 4).final()[0]
    return {"sketch": rows, "x": [round(float(v), 6) for v in hist]}


spark = (SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
mf = orders_matrix(spark, sys.argv[2])
clean = snapshot(mf)
markers = tempfile.mkdtemp(prefix="retry-markers-")
mf_flaky = mf.with_df(mf.df.repartition(3, "key").mapInArrow(make_flaky(markers), mf.df.schema))
retried = snapshot(mf_flaky)
print("RESULT", json.dumps({"same": clean == retried, "x": clean["x"], "failed_attempts": len(os.listdir(markers))}))
