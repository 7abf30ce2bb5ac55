"""Sketch dispatcher and solvers (C1, H1-H5) and the job entry.

``solve(mf, params)`` composes the operators:

* low precision, projection (H1):  sketch -> TSQR solve per trial
* low precision, sampling (H2):    sketch -> N -> leverage sample -> TSQR solve
* high precision (H3/H4):          N from either sketch -> LSQR for all trials at once
* high precision, no sketch (H5):  LSQR with N = I, one trial

Results are DataFrames: ``solutions`` (trial, iter, x) and ``metrics`` (stage timings),
plus the LSQR history for high precision.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tallsketch.operators import leverage as L
from tallsketch.operators.lsqr import LsqrResult, lsqr
from tallsketch.operators.sketch import sketch, validate
from tallsketch.operators.small_solve import factors_to_numpy, factors_with_normal_sums, require_full_rank, solve_sketch
from tallsketch.sources.matrix import MatrixFrame

SOLUTIONS_SCHEMA = "trial int, iter int, x array<double>"


@dataclass
class JobParams:
    precision: str = "low"             # 'low' | 'high'
    sketch: str | None = None          # 'projection' | 'sampling' | None
    kind: str = "gaussian"             # cw | gaussian | rademacher | srdht
    c: int | None = None               # projection size
    s: float | None = None             # sampling size
    iters: int | None = None           # LSQR iterations
    trials: int = 1                    # k
    seed: int = 42
    persist: bool = True
    storage: str = "MEMORY_AND_DISK"   # StorageLevel name for multi-pass plans (e.g. DISK_ONLY)
    partitions: int | None = None      # hash-repartition the rows by key first (None: keep)
    stop_early: bool = False
    expect_dims: tuple[int, int] | None = None
    repeat: int = 1                    # stacking
    stack: str = "all"                 # 'all' | 'dense'
    evaluate: bool = False
    x_opt: list[float] | None = None
    f_opt: float | None = None
    output_uri: str | None = None
    factor_cache: str | None = None
    reuse: bool = True                 # look factors up in the cache (False: save only)
    save: bool = True                  # write factors that were not found (False: load only)

    def validate(self, m: int | None = None, n: int | None = None) -> None:
        """Parameter checks, before any Spark job runs."""
        if self.precision not in ("low", "high"):
            raise ValueError(f"invalid solver type {self.precision!r}")
        if self.sketch not in (None, "projection", "sampling"):
            raise ValueError(f"invalid sketch type {self.sketch!r}")
        if m is not None and n is not None and m < n:
            raise ValueError(f"number of rows ({m}) should not be smaller than number of columns ({n})")
        if self.sketch == "sampling" and self.s is None:
            raise ValueError("please give a sampling size s")
        if self.precision == "high" and self.iters is None:
            raise ValueError("please give the number of LSQR iterations")
        if self.precision == "low" and self.sketch is None:
            raise ValueError("the low-precision solver needs a sketch method")
        if self.sketch and self.c is None:
            raise ValueError("please give a projection size c")
        if self.sketch:
            validate(self.kind, self.c, self.trials)
        if self.factor_cache and not (self.reuse or self.save):
            raise ValueError("a factor cache that is neither read nor written")
        _storage_level(self.storage)
        if self.repeat < 1 or self.stack not in ("all", "dense"):
            raise ValueError("repeat must be >= 1 and stack 'all' or 'dense'")


@dataclass
class SolveResult:
    solutions: DataFrame
    metrics: DataFrame
    history: LsqrResult | None = None
    factors: dict = field(default_factory=dict)
    errors: DataFrame | None = None  # (cand, iter, x_relerr, f_relerr) when evaluated


def compute_factors(mf: MatrixFrame, p: JobParams, timings: dict) -> dict[int, np.ndarray]:
    """C1 with objective N: projection N, or sampling N (projection N -> sample -> N)."""
    _check_sizes(mf, p)
    if p.factor_cache:
        from tallsketch.sources.sinks import cached_factors

        return cached_factors(mf, p, timings, _compute_factors_uncached)
    return _compute_factors_uncached(mf, p, timings)


def _compute_factors_uncached(mf: MatrixFrame, p: JobParams, timings: dict) -> dict[int, np.ndarray]:
    if p.sketch == "sampling":
        # the projection factor it starts from is cached on its own (reusable by other s)
        N = compute_factors(mf, replace(p, sketch="projection"), timings)
        t = time.time()
        N = factors_to_numpy(L.sampling_solve(mf, N, p.s, p.seed), mf.n, len(N))
        timings["sampling"] = time.time() - t
        return N
    t = time.time()
    N = factors_to_numpy(solve_sketch(sketch(mf, p.kind, p.c, p.trials, p.seed)), mf.n)
    timings["projection"] = time.time() - t
    return N


def _storage_level(name: str):
    from pyspark import StorageLevel

    level = getattr(StorageLevel, str(name).upper(), None)
    if not isinstance(level, StorageLevel):
        raise ValueError(f"unknown storage level {name!r}")
    return level


def _check_sizes(mf: MatrixFrame, p: JobParams) -> None:
    """A sketch with fewer rows than columns cannot give a factor or a solve (Q9)."""
    if p.sketch and int(p.c) < mf.n:
        raise ValueError(f"projection size c={p.c} is smaller than the number of columns n={mf.n}")
    if p.sketch == "sampling" and p.s is not None and float(p.s) < mf.n:
        raise ValueError(f"sampling size s={p.s} is smaller than the number of columns n={mf.n}")


def solve(mf: MatrixFrame, p: JobParams) -> SolveResult:
    p.validate()
    _check_sizes(mf, p)
    spark = mf.df.sparkSession
    timings: dict[str, float] = {}
    if p.partitions:
        mf = mf.with_df(mf.df.repartition(int(p.partitions), "key"))
    # Only plans that scan the rows more than once keep them (LSQR: q+1 passes; sampling:
    # sketch, leverage sum, sample).  A one-pass projection sketch streams the input.
    multi_pass = p.precision == "high" or p.sketch == "sampling"
    keep = p.persist and multi_pass
    work = mf.persist(_storage_level(p.storage)) if keep else mf
    try:
        history = None
        factors: dict[int, np.ndarray] = {}
        if p.precision == "low":
            t = time.time()
            if p.sketch == "projection":
                sol = solve_sketch(sketch(work, p.kind, p.c, p.trials, p.seed))
            else:
                N = compute_factors(work, replace(p, sketch="projection"), timings)
                sol = L.sampling_solve(work, N, p.s, p.seed)
            solved = sol.select("trial", "x", "rank", "N").collect()
            if p.sketch == "sampling":
                require_full_rank([(r["trial"], r["rank"]) for r in solved], mf.n, len(N))
            rows = [(int(r["trial"]), 0, [float(v) for v in r["x"]]) for r in solved]
            timings["solve"] = time.time() - t
            if p.factor_cache and p.save:
                from tallsketch.sources.sinks import keep_factors

                factors = {int(r["trial"]): np.asarray(r["N"], dtype=np.float64).reshape(mf.n, mf.n) for r in solved}
                keep_factors(work, p, factors, timings["solve"])
            solutions = spark.createDataFrame(rows, SOLUTIONS_SCHEMA)
        else:
            init = None
            if p.sketch is None:
                factors = {0: np.eye(mf.n)}
            elif not p.factor_cache:
                # Aᵀb and bᵀb ride along the projection sketch aggregate: LSQR skips its first pass
                t = time.time()
                factors, init = factors_with_normal_sums(work, p.kind, int(p.c), int(p.trials), p.seed)
                timings["projection"] = time.time() - t
                if p.sketch == "sampling":  # the sampling factor starts from the projection one
                    t = time.time()
                    factors = factors_to_numpy(L.sampling_solve(work, factors, p.s, p.seed), mf.n, len(factors))
                    timings["sampling"] = time.time() - t
            else:
                factors = compute_factors(work, p, timings)
            # An iterate's time counts from the first sketch, also of factors from the cache
            before = sum(timings.values())
            t = time.time()
            history = lsqr(work, factors, p.iters, stop_early=p.stop_early, init=init, before_s=before)
            timings["lsqr"] = time.time() - t
            solutions = spark.createDataFrame(
                [(h["trial"], h["iter"], h["x"]) for h in history.history], SOLUTIONS_SCHEMA)
        metrics = spark.createDataFrame([(k, float(v)) for k, v in timings.items()], "stage string, elapsed_s double")
        result = SolveResult(solutions, metrics, history, factors)
        if p.output_uri:
            from tallsketch.sources.sinks import write_result

            write_result(result, p.output_uri)
        return result
    finally:
        if keep:
            work.unpersist()


def run_job(spark: SparkSession, input_uri_or_df, p: JobParams, n: int | None = None) -> SolveResult:
    """Parameters -> load -> stack -> fit -> write -> (evaluate)."""
    from tallsketch.operators import shape
    from tallsketch.sources.matrix import read_text_matrix

    p.validate()
    mf = input_uri_or_df if isinstance(input_uri_or_df, MatrixFrame) else read_text_matrix(spark, input_uri_or_df, n=n)
    if p.expect_dims is not None:
        m, nn = shape.dims(mf)
        if (m, nn) != tuple(p.expect_dims):
            raise ValueError(f"matrix is {m} x {nn}, expected {p.expect_dims}")
        p.validate(m, nn)
    original = mf
    if p.repeat > 1:
        mf = shape.stack(mf, p.repeat, p.stack)
    result = solve(mf, p)
    if p.evaluate:
        from tallsketch.operators import evaluate as E

        result.errors = E.evaluate(result, original, p, x_opt=p.x_opt, f_opt=p.f_opt)
        if p.output_uri:
            from tallsketch.sources.sinks import write_errors

            write_errors(result.errors, p.output_uri)
    return result
