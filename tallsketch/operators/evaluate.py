"""Evaluation of solutions (E1-E5): objective, relative errors, stack-aware cost, medians.

All objectives of all candidates come from ONE pass over the rows (V3), never one job per
candidate; the optimum, when not supplied, comes from TSQR (E5), never from collecting
the rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallsketch.functions.blocks import arrow_block, partial_long_schema
from tallsketch.operators.products import MAX_EXPR_TERMS, _dot, residual_blocks, residual_norms
from tallsketch.operators.shape import nnz
from tallsketch.operators.small_solve import exact_solve
from tallsketch.session import ship_package
from tallsketch.sources.matrix import MatrixFrame


def optimum(mf: MatrixFrame, repnum: int = 1, stack_kind: str = "all") -> tuple[np.ndarray, float]:
    """E5: x*, f* by TSQR of [A b] (only R factors move).  For a dense stack, the optimum of
    the weighted rows that ``stack_cost`` measures: heavy rows count once, light ones 1/r."""
    if repnum > 1 and stack_kind == "dense":
        w = F.when(nnz(mf) > 2, F.lit(1.0)).otherwise(F.lit((1.0 / repnum) ** 0.5))
        cols = ([(F.col(c) * w).alias(c) for c in mf.feature_names] if mf.layout == "wide"
                else [F.transform("a", lambda v: v * w).alias("a")])
        mf = mf.with_df(mf.df.select("key", *cols, (F.col("b") * w).alias("b")))
    r = exact_solve(mf).first()
    return np.asarray(r["x"], dtype=float), float(r["resid"])


def stack_cost(mf_original: MatrixFrame, candidates: dict, repnum: int, kind: str = "dense") -> DataFrame:
    """Objective of the stacked problem scaled back by sqrt(r), from the ORIGINAL rows
    in one pass: heavy rows (nnz > 2, repeated) weigh r, light rows weigh 1.

    ``kind='all'`` evaluates the original rows (every row repeated, same minimizer)."""
    if kind == "all":
        return residual_norms(mf_original, candidates).withColumnRenamed("norm", "cost")
    ids = list(candidates)
    number = [int(c[0]) if isinstance(c, tuple) else int(c) for c in ids]
    if mf_original.layout == "array" or len(ids) * mf_original.n > MAX_EXPR_TERMS:
        # many candidates: one block product per Arrow batch, not an expression per candidate
        long = residual_blocks(mf_original, np.array([np.asarray(candidates[c], dtype=float) for c in ids]), float(repnum))
    else:
        w = F.when(nnz(mf_original) > 2, F.lit(float(repnum))).otherwise(F.lit(1.0))
        sums = [F.sum(w * F.pow(_dot(mf_original, candidates[c]) - F.col("b"), 2)).alias(f"r{j}") for j, c in enumerate(ids)]
        pairs = ", ".join(f"{j}, r{j}" for j in range(len(ids)))
        long = mf_original.df.agg(*sums).select(F.expr(f"stack({len(ids)}, {pairs}) AS (j, ss)"))
    names = mf_original.df.sparkSession.createDataFrame(list(enumerate(number)), "j int, cand int")
    return long.join(F.broadcast(names), "j").select("cand", F.sqrt(F.col("ss") / F.lit(float(repnum))).alias("cost"))


def preconditioner_quality(mf: MatrixFrame, factors: dict[int, np.ndarray]) -> DataFrame:
    """How well each trial's N preconditions A: (trial, sv_min, sv_max, cond), the extreme
    singular values of A N and their ratio, on which LSQR's number of iterations depends.

    One pass over the rows sums the Gram matrices of A N for all trials (k n² numbers to the
    driver, whatever m is).  N makes them well conditioned, so squaring costs no accuracy that
    a good N would show; a rank-deficient A N has sv_min 0 and cond null."""
    trials, n, layout = sorted(factors), mf.n, mf.layout
    if any(np.shape(factors[t]) != (n, n) for t in trials):
        raise ValueError(f"factors must be {n} x {n}")
    Ns = np.array([np.asarray(factors[t], dtype=float) for t in trials])

    def partial(batches):
        acc = np.zeros((len(Ns), n, n))
        for rb in batches:
            _, X = arrow_block(rb, n, layout)
            for j, N in enumerate(Ns):
                Y = X[:, :n] @ N
                acc[j] += Y.T @ Y
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(Ns), dtype=np.int32), n * n)),
             pa.array(np.tile(np.arange(n * n, dtype=np.int32), len(Ns))), pa.array(acc.reshape(-1))],
            names=["trial", "pos", "val"])

    spark = mf.df.sparkSession
    ship_package(spark)
    parts = mf.df.select(*mf.data_columns).mapInArrow(partial, partial_long_schema(["trial"]))
    gram = np.zeros((len(Ns), n * n))
    for r in parts.groupBy("trial", "pos").agg(F.sum("val").alias("val")).collect():
        gram[r["trial"], r["pos"]] = r["val"]
    rows = []
    for t, G in zip(trials, gram.reshape(-1, n, n)):
        values = np.linalg.eigvalsh((G + G.T) / 2)
        lo, hi = math.sqrt(max(values[0], 0.0)), math.sqrt(max(values[-1], 0.0))
        rows.append((int(t), lo, hi, hi / lo if lo > 0 else None))
    return spark.createDataFrame(rows, "trial int, sv_min double, sv_max double, cond double")


def relative_errors(mf_original: MatrixFrame, xs: dict, x_opt, f_opt: float, repnum: int = 1,
                    stack_kind: str = "all") -> DataFrame:
    """E1/E2 for every candidate: (cand, iter, x_relerr, f_relerr)."""
    x_opt = np.asarray(x_opt, dtype=float)
    ids = list(xs)
    spark = mf_original.df.sparkSession
    if repnum > 1 and stack_kind == "dense":
        costs = stack_cost(mf_original, {j: xs[c] for j, c in enumerate(ids)}, repnum, "dense")
        names = spark.createDataFrame([(j, *_pair(c)) for j, c in enumerate(ids)], "id int, cand int, iter int")
        costs = costs.withColumnRenamed("cand", "id").join(F.broadcast(names), "id").select("cand", "iter", F.col("cost").alias("norm"))
    else:
        costs = residual_norms(mf_original, xs)
    # an optimum of zero has no relative error: the absolute one is given
    size = float(np.linalg.norm(x_opt)) or 1.0
    xerr = [(*(_pair(c)), float(np.linalg.norm(np.asarray(v) - x_opt) / size)) for c, v in xs.items()]
    xdf = spark.createDataFrame(xerr, "cand int, iter int, x_relerr double")
    return (costs.join(F.broadcast(xdf), ["cand", "iter"])
            .select("cand", "iter", "x_relerr",
                    (F.abs(F.lit(float(f_opt)) - F.col("norm")) / F.lit(float(f_opt) or 1.0)).alias("f_relerr")))


def _pair(c) -> tuple[int, int]:
    return (int(c[0]), int(c[1])) if isinstance(c, tuple) else (int(c), 0)


def median_low(errors: DataFrame) -> DataFrame:
    """E4 (low precision): exact medians over trials (even k: mean of the middle two)."""
    return errors.agg(F.median("x_relerr").alias("x_relerr_median"), F.median("f_relerr").alias("f_relerr_median"))


def median_trial(errors: DataFrame) -> DataFrame:
    """E4 (high precision): the history of the trial whose FINAL f error is the lower
    median (rank floor((k-1)/2), ties by trial).  Windows run over the k final rows only."""
    last = errors.groupBy("cand").agg(F.max("iter").alias("iter"))
    finals = errors.join(last, ["cand", "iter"])
    k = finals.count()
    pick = (finals.withColumn("rk", F.row_number().over(Window.orderBy("f_relerr", "cand")) - 1)
            .where(F.col("rk") == (k - 1) // 2).select("cand"))
    return errors.join(F.broadcast(pick), "cand").select("iter", "x_relerr", "f_relerr")


def evaluate(result, mf_original: MatrixFrame, params, x_opt=None, f_opt=None) -> DataFrame:
    """Errors of a SolveResult against (x*, f*); computes the optimum when not given.

    Runs now (two passes: TSQR optimum, one residual pass for all candidates) and returns
    the k·q error rows as a small local frame, so the caller may release the matrix."""
    if x_opt is None or f_opt is None:
        x_opt, f_opt = optimum(mf_original, getattr(params, "repeat", 1), getattr(params, "stack", "all"))
    xs = {(int(r["trial"]), int(r["iter"])): list(r["x"]) for r in result.solutions.collect()}
    repnum = getattr(params, "repeat", 1)
    errs = relative_errors(mf_original, xs, x_opt, f_opt, repnum, getattr(params, "stack", "all"))
    spark = mf_original.df.sparkSession
    return spark.createDataFrame(errs.collect(), "cand int, iter int, x_relerr double, f_relerr double")
