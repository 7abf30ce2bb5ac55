"""Per-trial solves on sketches and samples (R1-R4), by TSQR.

Rows of each trial (a c x (n+1) sketch, a leverage sample, or the whole matrix for the
exact solution E5) are reduced to an (n+1) x (n+1) R factor:

1. ``mapInArrow``: each task folds its rows into one R per trial (incremental QR over
   Arrow batches, bounded memory);
2. the factors are dealt to FANOUT groups per trial and each group's stream is folded the
   same way, so a group holds one factor whatever the number of tasks is;
3. a last task per trial combines at most FANOUT factors and solves: thin SVD of R11 gives N = V/s (R2), x (R1/R3), the
   singular values, the numerical rank and the residual norm.

Nothing is vstacked whole in one task, and the normal equations are never formed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallsketch.functions.blocks import arrow_block, qr_r, solve_from_r
from tallsketch.sources.matrix import MatrixFrame
from tallsketch.session import ship_package

FANOUT = 256

SOLUTION_SCHEMA = "trial int, x array<double>, N array<double>, sv array<double>, rank int, resid double, rows bigint"
_R_SCHEMA = "trial int, grp bigint, rows bigint, R array<double>"


def _local_r(width: int, n: int, layout: str | None, value_cols: list[str] | None):
    def fn(batches):
        acc: dict[int, np.ndarray] = {}
        cnt: dict[int, int] = {}
        pid = 0
        for rb in batches:
            if rb.num_rows == 0:
                continue
            pid = int(rb.column("__pid")[0].as_py())
            trials = rb.column("trial").to_numpy(zero_copy_only=False).astype(np.int64)
            _, X = arrow_block(rb, n, layout or "wide", value_cols=value_cols, key_col=None)
            for t in np.unique(trials):
                Xt = X[trials == t]
                prev = acc.get(int(t))
                acc[int(t)] = qr_r(Xt if prev is None else np.vstack([prev, Xt]), width)
                cnt[int(t)] = cnt.get(int(t), 0) + len(Xt)
        if not acc:
            return
        ts = sorted(acc)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ts, pa.int32()), pa.array([pid] * len(ts), pa.int64()),
             pa.array([cnt[t] for t in ts], pa.int64()),
             pa.array([acc[t].reshape(-1).tolist() for t in ts], pa.list_(pa.float64()))],
            names=["trial", "grp", "rows", "R"])
    return fn


def _fold(width: int):
    """One R factor per (trial, grp) of a stream sorted by both; one factor is held at a time."""
    def fn(batches):
        key, R, count = None, None, 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([count], pa.int64()),
                 pa.array([R.reshape(-1).tolist()], pa.list_(pa.float64()))], names=["trial", "grp", "rows", "R"])

        for rb in batches:
            for i in range(rb.num_rows):
                at = (rb.column("trial")[i].as_py(), rb.column("grp")[i].as_py())
                part = np.asarray(rb.column("R")[i].values, dtype=np.float64).reshape(width, width)
                if at != key:
                    if key is not None:
                        yield row()
                    key, R, count = at, part, 0
                else:
                    R = qr_r(np.vstack([R, part]), width)
                count += rb.column("rows")[i].as_py()
        if key is not None:
            yield row()
    return fn


def _final(width: int, n: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        stacked = np.vstack([np.asarray(r, dtype=np.float64).reshape(width, width) for r in pdf["R"]])
        R = qr_r(stacked, width)
        rows = int(pdf["rows"].sum())
        sol = solve_from_r(R, n)
        return pd.DataFrame({"trial": [int(pdf["trial"].iloc[0])], "x": [sol["x"].tolist()],
                             "N": [sol["N"].reshape(-1).tolist()], "sv": [sol["sv"].tolist()],
                             "rank": [sol["rank"]], "resid": [sol["resid"]], "rows": [rows]})
    return fn


UNKNOWN_SIZE = 1 << 55  # the optimizer reports Long.MaxValue, or a share of it, when it cannot size a plan


def estimated_partitions(df: DataFrame) -> int | None:
    """Upper estimate of a DataFrame's partition count from the optimizer's size statistic
    and the session's split and shuffle settings -- planning only, no job.  (``df.rdd``
    would execute an adaptive plan's shuffle stages just to count partitions, and the real
    job would then run them again.)  None when the plan has no size estimate (e.g. a
    DataFrame built from an RDD)."""
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= UNKNOWN_SIZE:
        return None
    by_size = -(-size // max(1, int(conf.filesMaxPartitionBytes())))
    return max(1, int(conf.numShufflePartitions()), by_size)


def tsqr_solve(rows: DataFrame, n: int, value_cols: list[str] | None = None, layout: str | None = None,
               max_tasks: int | None = None) -> DataFrame:
    """Least squares per trial over ``rows`` (columns ``trial`` and either ``value_cols`` =
    [A b] names, or the matrix layout columns ``a``/``a0..`` and ``b``).

    ``max_tasks`` is a proven bound on the tasks that read ``rows``, if there is one; at most
    FANOUT of them need no folding level."""
    width = n + 1
    cols = ["trial", *(value_cols or (["a", "b"] if layout == "array" else [f"a{i}" for i in range(n)] + ["b"]))]
    src = rows.select(*cols).withColumn("__pid", F.spark_partition_id())
    ship_package(rows.sparkSession)
    level = src.mapInArrow(_local_r(width, n, layout, value_cols), _R_SCHEMA)
    if not max_tasks or max_tasks > FANOUT:
        level = (level.withColumn("grp", F.pmod("grp", F.lit(FANOUT)).cast("bigint")).repartition("trial", "grp")
                 .sortWithinPartitions("trial", "grp").mapInArrow(_fold(width), _R_SCHEMA))
    return level.groupBy("trial").applyInPandas(_final(width, n), SOLUTION_SCHEMA)


def solve_sketch(sf) -> DataFrame:
    """X (and N) of min ||SA x - Sb|| for every trial of a sketch."""
    wide = sf.layout == "wide"
    names = sf.value_names if wide else [f"v{i}" for i in range(sf.n + 1)]
    # a sketch comes out of a shuffle by (trial, bucket): its tasks are the shuffle's
    tasks = int(sf.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tsqr_solve(sf.df if wide else sf.to_wide(), sf.n, value_cols=names, max_tasks=tasks)


def exact_solve(mf: MatrixFrame) -> DataFrame:
    """The exact least-squares solution of the whole matrix by TSQR; only R
    factors move, never rows."""
    rows = mf.df.select(F.lit(0).cast("int").alias("trial"), *mf.data_columns[1:])
    return tsqr_solve(rows, mf.n, layout=mf.layout)


def factors_with_normal_sums(mf: MatrixFrame, kind: str, c: int, k: int, seed: int):
    """Projection factors N per trial AND (bᵀb, Aᵀb) from one pass over the rows: the sums
    ride along the sketch aggregate as an extra group; the small sketch (k·c + 1 rows) is
    cached so both reads reuse it.  Returns (factors, (s0, g0))."""
    from dataclasses import replace

    from tallsketch.operators.sketch import NORMAL_TRIAL, sketch

    sk = sketch(mf, kind, c, k, seed, with_normal_sums=True)
    cached = sk.df.persist()
    try:
        sketch_only = replace(sk, df=cached.where(F.col("trial") != NORMAL_TRIAL))
        factors = factors_to_numpy(solve_sketch(sketch_only), mf.n)
        normal = replace(sk, df=cached.where(F.col("trial") == NORMAL_TRIAL)).to_wide().collect()[0]
        s0 = float(normal[f"v{mf.n}"])
        g0 = np.array([float(normal[f"v{i}"]) for i in range(mf.n)])
    finally:
        cached.unpersist()
    return factors, (s0, g0)


def factors_to_numpy(sol: DataFrame, n: int, trials: int | None = None) -> dict[int, np.ndarray]:
    """Collect the k small n x n factors (k·n² doubles) to the driver.  With ``trials`` given
    (a sample that must carry the whole column space), a missing or rank-deficient trial raises."""
    rows = sol.select("trial", "N", "rank").collect()
    if trials is not None:
        require_full_rank([(r["trial"], r["rank"]) for r in rows], n, trials)
    return {int(r["trial"]): np.asarray(r["N"], dtype=np.float64).reshape(n, n) for r in rows}


def require_full_rank(ranks: list[tuple[int, int]], n: int, trials: int) -> None:
    """A sample without rows, or of less than full rank, gives no factor and no solution."""
    low = sorted(int(t) for t, r in ranks if r < n)
    if len(ranks) < trials or low:
        raise ValueError(f"the sample is too small: {trials - len(ranks)} of {trials} trials are empty and trials {low} "
                         f"have less than rank {n}; raise the sampling size")
