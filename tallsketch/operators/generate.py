"""Test matrices with non-uniform leverage and bad conditioning (G1), keyed by a table.

For every key of an input table (so the size grows with the data):
rows ``[50·z, 1e-8·z]`` (n/2 columns each), except the n/2 largest keys, which hold
``[0, I]`` (leverage ~ 1: uniform sampling misses them).  ``b = A x + e`` with a keyed
normal x (n values) and noise e scaled so that ``||e|| = 0.25 ||Ax||`` -- one aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallsketch.functions import hashing as H
from tallsketch.sources.matrix import WIDE_MAX, MatrixFrame

# Fixed values of the test-matrix family:
HEAVY_SCALE = 50.0    # scale of the normal entries of the first n/2 columns
LIGHT_SCALE = 1e-8    # scale of the normal entries of the last n/2 columns
NOISE_RATIO = 0.25    # ||e|| = NOISE_RATIO * ||A x||


def normal_sql(key_sql: str, col: int | str, seed: int, purpose: str, dialect: str) -> str:
    """Keyed N(0,1) for entry (key, col) of a generated matrix."""
    trial = {"gen-a": 0, "gen-x": 1, "gen-e": 2}[purpose]
    return H.sql_gaussian(key_sql, str(col), seed, trial + 1000, dialect)


def true_x(n: int, seed: int) -> list[float]:
    import numpy as np

    keys = np.arange(n, dtype=np.int64)
    return list(H.np_gaussian_block(keys, 1, seed, 1001)[0])


def gen_matrix(keys: DataFrame, key_col: str, n: int, seed: int = 42) -> MatrixFrame:
    if n < 2 or n % 2:
        raise ValueError("G1 needs an even n >= 2")
    h = n // 2
    base = keys.select(F.col(key_col).cast("bigint").alias("key"))
    special = [r["key"] for r in base.orderBy(F.col("key").desc()).limit(h).collect()]  # n/2 keys
    special = sorted(special)
    if len(special) < h:
        raise ValueError("G1 needs at least n/2 keys")
    if n > WIDE_MAX:
        return _gen_array(base, special, n, seed)
    staged = H.spark_with_row_hash(base, "key", seed, 1000, "__ha")
    staged = H.spark_with_row_hash(staged, "key", seed, 1002, "__he")
    for j in range(n):
        staged = H.spark_with_dense_entry(staged, "__ha", str(j), "gaussian", seed, 1000, f"__z{j}")
    staged = H.spark_with_dense_entry(staged, "__he", str(n), "gaussian", seed, 1002, "__e")
    cols = []
    for j in range(n):
        z = F.col(f"__z{j}")
        normal_val = F.lit(HEAVY_SCALE if j < h else LIGHT_SCALE) * z
        if j < h:
            ident = F.lit(0.0)
        else:  # the r-th special key holds the unit vector e_{h+r}
            ident = F.when(F.col("key") == F.lit(special[j - h]), F.lit(1.0)).otherwise(F.lit(0.0))
        cols.append(F.when(F.col("key").isin(special), ident).otherwise(normal_val).alias(f"a{j}"))
    x = true_x(n, seed)
    rows = staged.select("key", *cols, "__e")
    ax = None
    for j in range(n):
        t = F.lit(float(x[j])) * F.col(f"a{j}")
        ax = t if ax is None else ax + t
    rows = rows.select("*", ax.alias("__ax"))
    norms = rows.agg(F.sum(F.col("__ax") * F.col("__ax")).alias("axx"), F.sum(F.col("__e") * F.col("__e")).alias("ee")).first()
    scale = NOISE_RATIO * (norms["axx"] ** 0.5) / (norms["ee"] ** 0.5) if norms["ee"] else 0.0
    out = rows.select("key", *[f"a{j}" for j in range(n)], (F.col("__ax") + F.lit(scale) * F.col("__e")).alias("b"))
    mf = MatrixFrame(out, n, "wide", f"nonunif_bad_{n}", meta={"x_true": x, "noise_scale": scale})
    return mf.to_array() if n > WIDE_MAX else mf


def _gen_array(base: DataFrame, special: list[int], n: int, seed: int) -> MatrixFrame:
    """Same numbers for wide n (> WIDE_MAX) drawn with NumPy in Arrow batches: n staged
    normal columns would exceed the JVM method size of one whole-stage-codegen stage."""
    import numpy as np
    import pyarrow as pa

    from tallsketch.session import ship_package

    h = n // 2
    x = np.asarray(true_x(n, seed))
    special_arr = np.asarray(sorted(special), dtype=np.int64)

    def rows(batches):
        for rb in batches:
            keys = rb.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(keys):
                continue
            Z = H.np_gaussian_block(keys, n, seed, 1000).T
            A = np.hstack([HEAVY_SCALE * Z[:, :h], LIGHT_SCALE * Z[:, h:]])
            hit = np.flatnonzero(np.isin(keys, special_arr))
            if len(hit):
                A[hit] = 0.0
                A[hit, h + np.searchsorted(special_arr, keys[hit])] = 1.0
            e = H.np_gaussian_block(keys, n + 1, seed, 1002)[n]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(list(A), type=pa.list_(pa.float64())), pa.array(A @ x), pa.array(e)],
                names=["key", "a", "__ax", "__e"])

    ship_package(base.sparkSession)
    gen = base.mapInArrow(rows, "key bigint, a array<double>, __ax double, __e double")
    norms = gen.agg(F.sum(F.col("__ax") * F.col("__ax")).alias("axx"), F.sum(F.col("__e") * F.col("__e")).alias("ee")).first()
    scale = NOISE_RATIO * (norms["axx"] ** 0.5) / (norms["ee"] ** 0.5) if norms["ee"] else 0.0
    out = gen.select("key", "a", (F.col("__ax") + F.lit(scale) * F.col("__e")).alias("b"))
    return MatrixFrame(out, n, "array", f"nonunif_bad_{n}", meta={"x_true": list(x), "noise_scale": scale})
