"""Arrow-batch helpers shared by the NumPy-backed operators.

Inside ``mapInArrow`` a batch of rows becomes ``keys`` (int64) and ``X = [A b]``
(float64, r x (n+1)) without going through pandas object columns.  Partial results leave
the task in *long* form (group keys, pos, val) and are summed by Spark, so no partial is
ever assembled in one place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arrow_block(rb: pa.RecordBatch, n: int, layout: str, value_cols: list[str] | None = None,
                key_col: str | None = "key") -> tuple[np.ndarray, np.ndarray]:
    """(keys, X) of a record batch holding key, features and b."""
    r = rb.num_rows
    keys = rb.column(key_col).to_numpy(zero_copy_only=False).astype(np.int64) if key_col else np.zeros(r, np.int64)
    if value_cols is not None:
        cols = [rb.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in value_cols]
        return keys, (np.column_stack(cols) if cols else np.zeros((r, 0)))
    if layout == "wide":
        cols = [rb.column(f"a{i}") for i in range(n)] + [rb.column("b")]
        for c in cols:
            if c.null_count:
                raise ValueError("matrix rows must not hold nulls (use mode='drop' when building the matrix)")
        X = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in cols]) if r else np.zeros((0, n + 1))
        return keys, X
    arr = rb.column("a")
    b = rb.column("b")
    if arr.null_count or b.null_count:
        raise ValueError("matrix rows must not hold nulls")
    flat = arr.flatten()
    if flat.null_count:
        raise ValueError("matrix rows must not hold null features")
    A = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    if A.size != r * n:
        raise ValueError(f"ragged rows: expected {n} features per row")
    X = np.empty((r, n + 1))
    X[:, :n] = A.reshape(r, n)
    X[:, n] = b.to_numpy(zero_copy_only=False).astype(np.float64)
    return keys, X


def partial_long_schema(group_cols: list[str]) -> str:
    return ", ".join([f"{g} int" for g in group_cols] + ["pos int", "val double"])


def sum_long_partials(long: DataFrame, group_cols: list[str], width: int, wide: bool,
                      prefix: str = "v", array_name: str = "v") -> DataFrame:
    """Sum partials (group..., pos, val) into one row per group.

    wide: a single aggregate with one conditional sum per position;
    array: sum per (group, pos), then gather the width values of each group in order."""
    if wide:
        return long.groupBy(*group_cols).agg(
            *[F.sum(F.when(F.col("pos") == i, F.col("val"))).alias(f"{prefix}{i}") for i in range(width)])
    per_pos = long.groupBy(*group_cols, "pos").agg(F.sum("val").alias("val"))
    gathered = per_pos.groupBy(*group_cols).agg(F.array_sort(F.collect_list(F.struct("pos", "val"))).alias("__pv"))
    return gathered.select(*group_cols, F.transform("__pv", lambda s: s.getField("val")).alias(array_name))


def qr_r(X: np.ndarray, width: int) -> np.ndarray:
    """Upper-triangular R (width x width) of X, zero-padded when X has fewer rows."""
    if X.shape[0] == 0:
        return np.zeros((width, width))
    R = np.linalg.qr(X, mode="r")
    if R.shape[0] < width:
        R = np.vstack([R, np.zeros((width - R.shape[0], width))])
    return R


def solve_from_r(R: np.ndarray, n: int) -> dict:
    """Least squares from the R factor of [SA Sb]: thin SVD of R11 gives the singular values
    and V of SA, hence N = V / s (so SA·N has orthonormal columns) and x = N Uᵀ r12.

    Singular values under ``n·eps·s_max`` are treated as zero (pseudo-inverse, reported rank)
    instead of dividing by them.  R11 is n x n: the cutoff does not depend on how many rows
    were folded into it."""
    R11 = R[:n, :n]
    r12 = R[:n, n]
    r22 = R[n, n] if R.shape[0] > n else 0.0
    U, s, Vt = np.linalg.svd(R11)
    smax = s[0] if s.size else 0.0
    tol = n * np.finfo(float).eps * smax
    keep = s > tol
    inv = np.where(keep, 1.0 / np.where(keep, s, 1.0), 0.0)
    N = Vt.T * inv[None, :]
    z = U.T @ r12
    x = N @ z
    resid = float(np.sqrt(r22 ** 2 + np.sum(z[~keep] ** 2)))
    return {"x": x, "N": N, "sv": s, "rank": int(keep.sum()), "resid": resid}
