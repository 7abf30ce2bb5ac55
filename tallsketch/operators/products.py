"""Matrix-vector products and residual norms (V1-V3); results stay distributed or are
O(n)/O(candidates) aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallsketch.functions.blocks import arrow_block, partial_long_schema
from tallsketch.sources.matrix import MatrixFrame
from tallsketch.session import ship_package

MAX_EXPR_TERMS = 256  # candidates x features above which residuals use Arrow blocks


def _dot(mf: MatrixFrame, v) -> Column:
    v = [float(x) for x in v]
    if len(v) != mf.n:
        raise ValueError(f"vector has length {len(v)}, matrix has {mf.n} columns")
    if mf.layout == "wide":
        out = None
        for i, f in enumerate(mf.features()):
            term = F.lit(v[i]) * f
            out = term if out is None else out + term
        return out
    lits = F.array(*[F.lit(x) for x in v])
    return F.aggregate(F.zip_with("a", lits, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def matvec(mf: MatrixFrame, v) -> DataFrame:
    """V1: A·v as a keyed column (key, av); never collected.  Wide rows: one expression; array
    rows: one block product per Arrow batch, beside the batch's keys."""
    if mf.layout == "wide":
        return mf.df.select("key", _dot(mf, v).alias("av"))
    n, vec = mf.n, np.array([float(x) for x in v])
    if len(vec) != n:
        raise ValueError(f"vector has length {len(vec)}, matrix has {n} columns")

    def product(batches):
        for rb in batches:
            keys, X = arrow_block(rb, n, "array")
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(X[:, :n] @ vec)], names=["key", "av"])

    ship_package(mf.df.sparkSession)
    return mf.df.select(*mf.data_columns).mapInArrow(product, "key long, av double")


def vecmat(mf: MatrixFrame, u: Column | DataFrame) -> DataFrame:
    """V2: uᵀA as (pos, val).  ``u`` is either a Column over the matrix rows (e.g. a keyed
    hash) or a keyed table (key, u), joined on key."""
    if isinstance(u, DataFrame):
        rows = mf.df.join(u.select("key", F.col(u.columns[-1]).alias("__u")), "key")
    else:
        rows = mf.df.select("*", u.alias("__u"))
    n = mf.n
    if mf.layout == "wide" or n <= 32:
        sums = rows.agg(*[F.sum(F.col("__u") * mf.feature(i)).alias(f"s{i}") for i in range(n)])
        pairs = ", ".join(f"{i}, s{i}" for i in range(n))
        return sums.select(F.expr(f"stack({n}, {pairs}) AS (pos, val)")).select(
            F.col("pos").cast("int").alias("pos"), "val")

    def partial(batches):
        acc = np.zeros(n)
        for rb in batches:
            _, X = arrow_block(rb, n, "array")
            uu = rb.column("__u").to_numpy(zero_copy_only=False).astype(float)
            acc += uu @ X[:, :n]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.arange(n, dtype=np.int32)),
                                          pa.array(acc)], names=["trial", "pos", "val"])

    ship_package(mf.df.sparkSession)
    parts = rows.select("key", "a", "b", "__u").mapInArrow(partial, partial_long_schema(["trial"]))
    return parts.groupBy("pos").agg(F.sum("val").alias("val"))


def residual_norms(mf: MatrixFrame, candidates: dict) -> DataFrame:
    """V3: ||A x_c - b|| for every candidate in ONE pass (cand, norm).

    ``candidates`` maps an id (int, or tuple (trial, iter)) to an n-vector."""
    ids = list(candidates)
    spark = mf.df.sparkSession
    if mf.layout == "array" or len(ids) * mf.n > MAX_EXPR_TERMS:
        # many candidates: one block product per Arrow batch instead of len(ids) sum expressions
        long = residual_blocks(mf, np.array([np.asarray(candidates[c], dtype=float) for c in ids]))
    else:
        sums = [F.sum(F.pow(_dot(mf, candidates[c]) - F.col("b"), 2)).alias(f"r{j}") for j, c in enumerate(ids)]
        row = mf.df.agg(*sums)
        pairs = ", ".join(f"{j}, r{j}" for j in range(len(ids)))
        long = row.select(F.expr(f"stack({len(ids)}, {pairs}) AS (j, ss)"))
    idmap = spark.createDataFrame([(j, *(_as_tuple(c))) for j, c in enumerate(ids)],
                                  "j int, cand int, iter int")
    return (long.join(F.broadcast(idmap), long.j == idmap.j)
            .select("cand", "iter", F.sqrt("ss").alias("norm")))


def _as_tuple(c) -> tuple[int, int]:
    if isinstance(c, tuple):
        return int(c[0]), int(c[1])
    return int(c), 0


def residual_blocks(mf: MatrixFrame, C: np.ndarray, dense_weight: float = 1.0) -> DataFrame:
    """Σ w (a·x_j - b)² for every candidate row of C at once: per Arrow batch one block
    product X·Cᵀ, per task one partial per candidate, then a sum (j, ss).  Rows with more than
    two non-zeros in [A b] weigh ``dense_weight``, the others 1 (stack type 2)."""
    n = mf.n
    if C.shape[1] != n:
        raise ValueError(f"candidates have length {C.shape[1]}, matrix has {n} columns")
    Cc = C.copy()
    layout = mf.layout

    def partial(batches):
        acc = np.zeros(len(Cc))
        for rb in batches:
            _, X = arrow_block(rb, n, layout)
            if len(X):
                R = X[:, :n] @ Cc.T - X[:, n:n + 1]
                if dense_weight != 1.0:
                    R *= np.sqrt(np.where((X != 0).sum(axis=1) > 2, dense_weight, 1.0))[:, None]
                acc += np.einsum("ij,ij->j", R, R)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(Cc), np.int32)), pa.array(np.arange(len(Cc), dtype=np.int32)),
                                          pa.array(acc)], names=["trial", "pos", "val"])

    ship_package(mf.df.sparkSession)
    parts = mf.df.select(*mf.data_columns).mapInArrow(partial, partial_long_schema(["trial"]))
    return parts.groupBy("pos").agg(F.sum("val").alias("ss")).select(F.col("pos").alias("j"), "ss")
