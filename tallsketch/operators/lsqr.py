"""Preconditioned LSQR with one stateless Spark aggregate per iteration (H5-H8).

The Golub-Kahan vector u (length m) is never materialized: every u is ``A p + q b`` for an
n-vector p and a scalar q, because u1 = b/β and u_{j+1} = (A N v_j - α u_j)/β.  One pass
over the rows therefore gives, for *all* k trials at once,

    s_t = Σ_rows (a·p_t + q_t b)²        g_t = Σ_rows (a·p_t + q_t b) a

(k·(n+1) numbers to the driver) and the rest of the recurrence works on n-vectors and
scalars on the driver.  No distributed state, no lineage growth; a lost executor only
re-runs tasks of the current pass.  The driver keeps the small bidiagonal matrix of each trial,
solves its least-squares problem and reads the monitors (norm r, norm Aᵀr, norm A, cond A,
norm x, stagnation) off it.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallsketch.functions.blocks import arrow_block, partial_long_schema
from tallsketch.sources.matrix import MatrixFrame
from tallsketch.session import ship_package

# Fixed values of the LSQR recurrences and monitors (kept as in the original method):
EPS = 32 * np.finfo(float).eps   # convergence / conditioning threshold, slightly above machine eps
MAX_STAGNATION = 3               # iterations without progress before flagging stagnation
DEFAULT_TOL = 1e-10              # relative tolerance on norm(A^T r) used by the solvers

MAX_EXPR_TERMS = 1024  # k·(n+1)·n product terms above which a pass uses Arrow blocks, not expressions


def lsqr_pass(mf: MatrixFrame, Pm: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass: (s, G) with s_t = ||A p_t + q_t b||², G_t = Aᵀ(A p_t + q_t b)."""
    k, n = Pm.shape
    if mf.layout == "wide" and k * (n + 1) * n <= MAX_EXPR_TERMS:
        feats = mf.features()
        us = []
        for t in range(k):
            u = F.lit(float(q[t])) * F.col("b")
            for i in range(n):
                u = u + F.lit(float(Pm[t, i])) * feats[i]
            us.append(u.alias(f"__u{t}"))
        proj = mf.df.select(*[f.alias(f"a{i}") for i, f in enumerate(feats)], *us)
        aggs = []
        for t in range(k):
            aggs.append(F.sum(F.col(f"__u{t}") * F.col(f"__u{t}")).alias(f"s{t}"))
            aggs += [F.sum(F.col(f"__u{t}") * F.col(f"a{i}")).alias(f"g{t}_{i}") for i in range(n)]
        row = proj.agg(*aggs).collect()[0]  # one row; collect avoids a limit stage
        s = np.array([row[f"s{t}"] if row[f"s{t}"] is not None else 0.0 for t in range(k)], dtype=float)
        G = np.array([[row[f"g{t}_{i}"] if row[f"g{t}_{i}"] is not None else 0.0 for i in range(n)] for t in range(k)])
        return s, G

    Pc, qc = Pm.copy(), q.copy()
    layout = mf.layout

    def partial(batches):
        acc = np.zeros((k, n + 1))
        seen = False
        for rb in batches:
            _, X = arrow_block(rb, n, layout)
            if not len(X):
                continue
            seen = True
            U = X[:, :n] @ Pc.T + X[:, n:n + 1] * qc[None, :]
            acc[:, :n] += U.T @ X[:, :n]
            acc[:, n] += np.einsum("ij,ij->j", U, U)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(k, dtype=np.int32), n + 1)),
                 pa.array(np.tile(np.arange(n + 1, dtype=np.int32), k)), pa.array(acc.reshape(-1))],
                names=["trial", "pos", "val"])

    ship_package(mf.df.sparkSession)
    parts = mf.df.select(*mf.data_columns).mapInArrow(partial, partial_long_schema(["trial"]))
    out = np.zeros((k, n + 1))
    for r in parts.groupBy("trial", "pos").agg(F.sum("val").alias("val")).collect():
        out[r["trial"], r["pos"]] = r["val"]
    return out[:, n], out[:, :n]


@dataclass
class LsqrResult:
    history: list[dict]  # one dict per (trial, iter)
    n: int
    k: int

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.history, schema=HISTORY_SCHEMA)

    def final(self) -> dict[int, np.ndarray]:
        last: dict[int, np.ndarray] = {}
        for h in self.history:
            last[h["trial"]] = np.asarray(h["x"])
        return last


HISTORY_SCHEMA = ("trial int, iter int, x array<double>, y array<double>, nrm_r double, nrm_ar double, "
                  "nrm_a double, cnd_a double, nrm_x double, stag int, flag int, frozen boolean, elapsed_s double")


def lsqr(mf: MatrixFrame, factors: dict[int, np.ndarray] | None, iters: int, tol: float = DEFAULT_TOL,
         stop_early: bool = False, init: tuple[float, np.ndarray] | None = None, before_s: float = 0.0) -> LsqrResult:
    """Run ``iters`` LSQR iterations on min ||A N y - b|| for every trial's N (identity when
    ``factors`` is None: plain LSQR, one trial).  x = N y is recorded at every iteration.
    ``init`` = (bᵀb, Aᵀb) when already known (e.g. from the sketch pass) saves the first pass.
    ``before_s``, the seconds that the factors took, is part of every iteration's time."""
    if iters is None or int(iters) < 1:
        raise ValueError("LSQR needs a positive number of iterations")
    iters = int(iters)
    n = mf.n
    if factors is None:
        factors = {0: np.eye(n)}
    trials = sorted(factors)
    k = len(trials)
    Ns = [np.asarray(factors[t], dtype=float) for t in trials]
    tol = min(max(tol, EPS), 1 - EPS)
    t0 = time.time()

    if init is None:
        s0, G0 = lsqr_pass(mf, np.zeros((1, n)), np.ones(1))
    else:
        s0, G0 = np.array([float(init[0])]), np.asarray(init[1], dtype=float).reshape(1, n)
    runs = [Bidiagonal(N, math.sqrt(max(s0[0], 0.0)), G0[0]) for N in Ns]
    hist: list[dict] = []
    for it in range(iters):
        asked = [r.next_combination() for r in runs]
        if any(not r.done for r in runs):
            s, G = lsqr_pass(mf, np.array([a[0] for a in asked]), np.array([a[1] for a in asked]))
        elapsed = before_s + time.time() - t0
        for j, run in enumerate(runs):
            if not run.done:
                run.extend(float(s[j]), G[j])
                run.check(tol, stop_early)
            hist.append(dict(trial=int(trials[j]), iter=it, x=(Ns[j] @ run.y).tolist(), y=run.y.tolist(),
                             **run.monitors(), frozen=run.done, elapsed_s=float(elapsed)))
    return LsqrResult(hist, n, k)


class Bidiagonal:
    """Golub-Kahan bidiagonalization of A N from b for one trial, and the least-squares
    problem in its Krylov space: after j steps, A N V = U B with B lower bidiagonal
    (diagonal ``alphas``, below it ``betas[1:]``), and y = V z where z minimizes
    ||betas[0] e1 - B z||.  Everything reported is read off B and z.

    ``done``: the space cannot grow (an entry of B is zero), or the caller
    stops early; later iterations then repeat the last values."""

    def __init__(self, N: np.ndarray, norm_b: float, atb: np.ndarray):
        self.N = N
        self.betas, self.alphas = [norm_b], []
        self.basis: list[np.ndarray] = []
        self.left = (np.zeros(len(N)), 1.0 / norm_b if norm_b else 0.0)  # u = A p + q b
        self.y, self.z = np.zeros(N.shape[1]), np.zeros(0)
        self.residual, self.still, self.flag = norm_b, 0, -1
        self.done = False
        self._grow(N.T @ (atb / norm_b) if norm_b else np.zeros(N.shape[1]))
        self.normal0 = self.next_alpha * norm_b
        self.done = self.normal0 == 0

    def _grow(self, v: np.ndarray) -> None:
        """Keep v's length as the next diagonal entry and its direction as the next vector."""
        self.next_alpha = float(np.linalg.norm(v))
        self.next_v = v / self.next_alpha if self.next_alpha and math.isfinite(self.next_alpha) else np.zeros_like(v)

    def next_combination(self) -> tuple[np.ndarray, float]:
        """(p, q) of the next left vector before scaling: A N v - alpha u."""
        p, q = self.left
        return self.N @ self.next_v - self.next_alpha * p, -self.next_alpha * q

    def matrix(self) -> np.ndarray:
        j = len(self.alphas)
        B = np.zeros((j + 1, j))
        B[np.arange(j), np.arange(j)] = self.alphas
        B[np.arange(1, j + 1), np.arange(j)] = self.betas[1:]
        return B

    def extend(self, square: float, product: np.ndarray) -> None:
        """One step, given ||A p + q b||^2 and A^T (A p + q b) of ``next_combination``."""
        p, q = self.next_combination()
        beta = math.sqrt(max(square, 0.0))
        self.alphas.append(self.next_alpha)
        self.basis.append(self.next_v)
        self.betas.append(beta)
        B = self.matrix()
        if beta:
            self.left = (p / beta, q / beta)
            self._grow(self.N.T @ (product / beta) - beta * self.next_v)
        else:
            self.next_alpha = 0.0
        if not self.next_alpha or not math.isfinite(self.next_alpha):
            self.next_alpha, self.done = 0.0, True
        Q, R = np.linalg.qr(B)
        goal = np.zeros(len(B))
        goal[0] = self.betas[0]
        self.z = np.linalg.solve(R, Q.T @ goal)
        self.residual = float(np.linalg.norm(goal - B @ self.z))
        y = np.column_stack(self.basis) @ self.z
        self.still = self.still + 1 if np.linalg.norm(y - self.y) < EPS * np.linalg.norm(y) else 0
        self.y = y

    def monitors(self) -> dict:
        """Norms of the residual, of (A N)^T r, of A N (Frobenius), of y, and the condition
        estimate ||B|| ||B^+||, from the bidiagonal problem alone."""
        if not self.alphas:
            return dict(nrm_r=self.residual, nrm_ar=self.normal0, nrm_a=0.0, cnd_a=0.0, nrm_x=0.0, stag=0, flag=self.flag)
        B = self.matrix()
        size = float(np.linalg.norm(B))
        return dict(nrm_r=self.residual, nrm_ar=float(self.next_alpha * self.betas[-1] * abs(self.z[-1])), nrm_a=size,
                    cnd_a=size * float(np.linalg.norm(np.linalg.pinv(B))), nrm_x=float(np.linalg.norm(self.z)),
                    stag=self.still, flag=self.flag)

    def check(self, tol: float, stop_early: bool) -> None:
        """Flag 0: converged; 1: too ill-conditioned or no progress; -1: neither."""
        m = self.monitors()
        if m["cnd_a"] > 1 / EPS or self.still >= MAX_STAGNATION:
            self.flag = 1
        elif self.done or m["nrm_ar"] < max(tol * self.normal0, EPS * m["nrm_a"] * m["nrm_r"]):
            self.flag = 0
        self.done = self.done or (stop_early and self.flag >= 0)
