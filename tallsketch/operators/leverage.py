"""Approximate leverage scores and importance sampling.

Given a factor N per trial (from a projection sketch, SA·N orthonormal):

* L1  lev_i = ||a_i N||²  (wide: Catalyst expression with N inlined; array: NumPy batches)
* L2  lev_sum per trial: ``groupBy(trial).agg(sum(lev))``, k rows
* L3  p_i = min(1, s·lev_i/lev_sum)  -- k-row lev_sum table joined by broadcast (size = k)
* L4  Bernoulli sampling with a keyed coin u(key, trial) < p_i, rows scaled by 1/sqrt(p_i)
* L6  solve the sampled rows per trial by TSQR (x or N)

The sample has expected size <= s per trial and is never gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallsketch.functions import hashing as H
from tallsketch.functions.blocks import arrow_block
from tallsketch.sources.matrix import MatrixFrame

MAX_EXPR_TERMS = 512  # trials x n² terms of the quadratic form above which Arrow blocks are used
from tallsketch.session import ship_package


def _coin_sql(trial: int, seed: int, dialect: str = "spark", key_sql: str = "key") -> str:
    return H.sql_key_coin(key_sql, H.sample_poly(seed, "lev-sample", trial), dialect)


def leverage_scores(mf: MatrixFrame, factors: dict[int, np.ndarray]) -> DataFrame:
    """L1: (trial, key, <matrix columns>, lev) for every trial's N."""
    trials = sorted(factors)
    n = mf.n
    if mf.layout == "wide" and len(trials) * n * n <= MAX_EXPR_TERMS:
        feats = mf.features()
        structs = []
        for t in trials:
            N = np.asarray(factors[t], dtype=float)
            lev = None
            for j in range(N.shape[1]):
                z = None
                for i in range(n):
                    term = F.lit(float(N[i, j])) * feats[i]
                    z = term if z is None else z + term
                lev = z * z if lev is None else lev + z * z
            structs.append(F.struct(F.lit(t).cast("int").alias("trial"), lev.alias("lev")))
        base = mf.df.select(*mf.data_columns)
        if len(structs) == 1:
            return base.select(structs[0].getField("trial").alias("trial"), *mf.data_columns,
                               structs[0].getField("lev").alias("lev"))
        return base.select(F.inline(F.array(*structs)), *mf.data_columns).select("trial", *mf.data_columns, "lev")

    Ns = {t: np.asarray(factors[t], dtype=float) for t in trials}
    layout, cols = mf.layout, mf.data_columns

    def scores(batches):
        for rb in batches:
            keys, X = arrow_block(rb, n, layout)
            if not len(keys):
                continue
            for t in trials:
                lev = np.sum((X[:, :n] @ Ns[t]) ** 2, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), t, dtype=np.int32)), *[rb.column(c) for c in cols], pa.array(lev)],
                    names=["trial", *cols, "lev"])

    ship_package(mf.df.sparkSession)
    value_types = [f"a{i} double" for i in range(n)] if layout == "wide" else ["a array<double>"]
    schema = ", ".join(["trial int", "key bigint", *value_types, "b double", "lev double"])
    return mf.df.select(*cols).mapInArrow(scores, schema)


def leverage_sums(scores: DataFrame) -> DataFrame:
    """L2: one row per trial."""
    return scores.groupBy("trial").agg(F.sum("lev").alias("lev_sum"))


def inclusion_probs(scores: DataFrame, s: float) -> DataFrame:
    """L3: p = min(1, s·lev/lev_sum); lev_sum joins by broadcast (k rows, bounded by k)."""
    sums = leverage_sums(scores)
    return (scores.join(F.broadcast(sums), "trial")
            .withColumn("p", F.least(F.lit(1.0), F.lit(float(s)) * F.col("lev") / F.col("lev_sum")))
            .drop("lev_sum"))


def leverage_sample(mf: MatrixFrame, factors: dict[int, np.ndarray], s: float, seed: int) -> DataFrame:
    """L4: sampled, rescaled rows (trial, key, <matrix columns scaled by 1/sqrt(p)>, p)."""
    if s is None or s <= 0:
        raise ValueError("sampling needs a positive sampling size s")
    probs = inclusion_probs(leverage_scores(mf, factors), s)
    trials = sorted(factors)
    coin = None
    for t in trials:
        probs = H.spark_with_coin(probs, "key", H.sample_poly(seed, "lev-sample", t), f"__c{t}")
        c = F.col(f"__c{t}")
        coin = F.when(F.col("trial") == t, c) if coin is None else coin.when(F.col("trial") == t, c)
    kept = probs.where(coin < F.col("p"))
    w = F.lit(1.0) / F.sqrt(F.col("p"))
    if mf.layout == "wide":
        cols = [(F.col(c) * w).alias(c) for c in mf.feature_names] + [(F.col("b") * w).alias("b")]
    else:
        cols = [F.transform("a", lambda v: v * w).alias("a"), (F.col("b") * w).alias("b")]
    return kept.select("trial", "key", *cols, "p")


def sampling_solve(mf: MatrixFrame, factors: dict[int, np.ndarray], s: float, seed: int) -> DataFrame:
    """X and N of the sampled problem per trial (SOLUTION_SCHEMA)."""
    from tallsketch.operators.small_solve import tsqr_solve

    return tsqr_solve(leverage_sample(mf, factors, s, seed), mf.n, layout=mf.layout)
