import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001, to_numpy
from tallsketch.functions import hashing as H
from tallsketch.operators.sketch import KINDS, merge, sketch, sketch_block
from tallsketch.sources import matrix as S


def dense_reference(kind, keys, X, c, seed, trial, m=None):
    """Brute force: build S explicitly from the hash definitions and multiply."""
    if kind == "cw":
        hb, hs = H.cw_polys(seed, trial)
        Sm = np.zeros((c, len(keys)))
        Sm[H.np_hash_key(keys, hb) % c, np.arange(len(keys))] = H.np_sign(H.np_hash_key(keys, hs))
    elif kind == "gaussian":
        Sm = H.np_gaussian_block(keys, c, seed, trial) / math.sqrt(c)
    elif kind == "rademacher":
        Sm = H.np_rademacher_block(keys, c, seed, trial) / math.sqrt(c)
    else:
        f = np.array(H.np_srdht_frequencies(m, c, seed, trial))
        sg = H.np_sign(H.np_hash_key(keys, H.srdht_sign_poly(seed, trial)))
        Sm = math.sqrt(2.0 / c) * np.cos(2 * math.pi * np.outer(f, keys) / m - math.pi / 4) * sg
    return Sm @ X


def sketch_numpy(sk):
    rows = sk.to_wide().orderBy("trial", "bucket").collect()
    out = np.zeros((sk.k, sk.c, sk.n + 1))
    for r in rows:
        out[r["trial"], r["bucket"]] = [r[f"v{i}"] for i in range(sk.n + 1)]
    return out


@pytest.mark.parametrize("kind", KINDS)
def test_sketch_matches_brute_force(spark, kind):
    mf = S.orders_matrix(spark, SF001)
    keys, A, b = to_numpy(mf)
    X = np.column_stack([A, b])
    c = 40 if kind != "cw" else 100
    sk = sketch(mf, kind, c, 2, 42)
    got = sketch_numpy(sk)
    for t in range(2):
        ref = dense_reference(kind, keys, X, c, 42, t, m=len(keys))
        assert np.allclose(got[t], ref, rtol=1e-9, atol=1e-6 * np.abs(ref).max())


def test_array_layout_sketch_matches_brute_force(spark):
    mf = S.embeddings_matrix(spark, SF001)
    keys, A, b = to_numpy(mf)
    X = np.column_stack([A, b])
    for kind in ("cw", "gaussian"):
        sk = sketch(mf, kind, 150, 1, 3)
        ref = dense_reference(kind, keys, X, 150, 3, 0)
        assert np.allclose(sketch_numpy(sk)[0], ref, atol=1e-8)


def test_catalyst_and_arrow_countsketch_agree(spark):
    mf = S.orders_matrix(spark, SF001)
    a = sketch_numpy(sketch(mf, "cw", 64, 3, 9))
    b = sketch_numpy(sketch(mf, "cw", 64, 3, 9, method="arrow"))
    assert np.allclose(a, b, atol=1e-6)


def test_merge_is_sketch_of_union(spark):
    mf = S.orders_matrix(spark, SF001)
    whole = sketch_numpy(sketch(mf, "gaussian", 30, 1, 5))
    parts = [mf.with_df(mf.df.where(F.col("key") % 3 == r)) for r in range(3)]
    merged = sketch_numpy(merge(*[sketch(p, "gaussian", 30, 1, 5) for p in parts]))
    assert np.allclose(whole, merged, rtol=1e-9, atol=1e-6)


def test_partitioning_and_empty_partitions_do_not_change_sketch(spark):
    mf = S.orders_matrix(spark, SF001)
    base = sketch_numpy(sketch(mf, "rademacher", 20, 1, 1))
    for parts in (1, 7):
        alt = sketch_numpy(sketch(mf.with_df(mf.df.repartition(parts)), "rademacher", 20, 1, 1))
        assert np.allclose(base, alt, rtol=1e-10, atol=1e-6)
    tiny = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0), (3, 5.0, 7.0)], "k long, x double, y double")
    t1 = S.from_columns(tiny.coalesce(1), "k", ["x"], "y")
    t8 = S.from_columns(tiny.repartition(8), "k", ["x"], "y")
    for kind in ("cw", "gaussian"):
        assert np.allclose(sketch_numpy(sketch(t1, kind, 4, 1, 1)), sketch_numpy(sketch(t8, kind, 4, 1, 1, method="arrow")))


def test_sketch_argument_checks(spark):
    mf = S.orders_matrix(spark, SF001)
    with pytest.raises(ValueError):
        sketch(mf, "fourier", 10)
    with pytest.raises(ValueError):
        sketch(mf, "cw", None)
    with pytest.raises(ValueError):
        sketch(mf, "cw", 10.5)
    assert sketch(mf, "cw", 1e2).c == 100  # integral floats are accepted


def test_countsketch_expected_gram_is_identity():
    rng = np.random.default_rng(0)
    keys = np.arange(400, dtype=np.int64)
    X = rng.standard_normal((400, 3))
    grams = [sketch_block("cw", keys, X, 50, seed, 0).T @ sketch_block("cw", keys, X, 50, seed, 0) for seed in range(200)]
    assert np.allclose(np.mean(grams, axis=0), X.T @ X, rtol=0.1, atol=15)


def test_declarative_dense_sketch_equals_arrow(spark):
    mf = S.orders_matrix(spark, SF001)
    for kind in ("gaussian", "rademacher"):
        a = sketch_numpy(sketch(mf, kind, 25, 2, 11, method="arrow"))
        b = sketch_numpy(sketch(mf, kind, 25, 2, 11, method="sql"))
        assert np.allclose(a, b, rtol=1e-9, atol=1e-6)


def test_srdht_reindexes_noncontiguous_keys(spark):
    df = spark.range(300).select((F.col("id") * 7 + 1000).alias("k"), (F.col("id") % 11).cast("double").alias("x"),
                                 (F.col("id") % 5).cast("double").alias("y"))
    mf = S.from_columns(df, "k", [F.lit(1.0), "x"], "y")
    got = sketch_numpy(sketch(mf, "srdht", 20, 1, 8))
    pdf = df.toPandas().sort_values("k")
    X = np.column_stack([np.ones(300), pdf["x"], pdf["y"]])
    ref = dense_reference("srdht", np.arange(300, dtype=np.int64), X, 20, 8, 0, m=300)
    assert np.allclose(got[0], ref, atol=1e-9)


@pytest.mark.parametrize("m", [7, 1000, 3001, 5_000_011, 2**40 + 15])
def test_hartley_tables_equal_cosines(m):
    """Dense runs, sparse rows and mixtures of both, whatever the order and the number of digits."""
    from fractions import Fraction

    from tallsketch.operators.hartley import Hartley

    rng = np.random.default_rng(m % 1000)
    freqs = sorted({int(f) for f in rng.integers(0, m, 9)})
    dense = np.arange(min(m, 2500)) + (m - min(m, 2500)) // 2
    picks = {"dense": dense, "sparse": np.unique(rng.integers(0, m, 60)),
             "mixed": np.unique(np.concatenate([dense, rng.integers(0, m, 60), [0, m - 1]]))}
    sign = H.srdht_sign_poly(5, 1)
    for index in picks.values():
        index = rng.permutation(index).astype(np.int64)
        X = rng.standard_normal((len(index), 3))
        turns = np.array([[float(Fraction(int(j) * k % m, m)) for j in index] for k in freqs])
        want = math.sqrt(2 / len(freqs)) * np.cos(2 * math.pi * turns - math.pi / 4) * H.np_sign(H.np_hash_key(index, sign)) @ X
        acc = np.zeros((len(freqs), 3))
        for part in np.array_split(np.arange(len(index)), 3):
            if len(part):
                Hartley(m, freqs, 5, 1).add(acc, index[part], X[part])
        assert np.allclose(acc, want, atol=1e-10 * len(index) ** 0.5)


def test_srdht_rows_stay_where_they_are(spark, monkeypatch):
    """Keys in runs go as runs to the tasks; keys without runs are joined with their narrow ranks."""
    from tallsketch.operators import shape

    df = spark.range(400).select((F.col("id") * 3 - F.col("id") % 3 * 2 - 50).alias("k"), F.rand(3).alias("x"), F.rand(4).alias("y"))
    mf = S.from_columns(spark.createDataFrame(df.toPandas()), "k", [F.lit(1.0), "x"], "y")
    pdf = mf.df.toPandas().sort_values("key")
    X = pdf[["a0", "a1", "b"]].to_numpy()
    ref = dense_reference("srdht", np.arange(400, dtype=np.int64), X, 30, 8, 0, m=400)
    same, m, ranks = shape.ranked_keys(mf)
    assert same is mf and m == 400 and 100 < len(ranks.starts) < 400
    assert np.allclose(sketch_numpy(sketch(mf, "srdht", 30, 1, 8))[0], ref, atol=1e-9)
    moved, m, none = shape.ranked_keys(mf, max_runs=5)
    assert none is None and m == 400 and sorted(r["key"] for r in moved.df.collect()) == list(range(400))
    assert "ShuffledHashJoin" in moved.df._jdf.queryExecution().toString()
    monkeypatch.setattr(shape, "ranked_keys", lambda mf: (moved, m, None))
    assert np.allclose(sketch_numpy(sketch(mf, "srdht", 30, 1, 8))[0], ref, atol=1e-9)
    shifted, m = shape.contiguous_keys(mf.with_df(mf.df.withColumn("key", F.expr("row_number() over (order by key) + 9").cast("bigint"))))
    assert m == 400 and sorted(r["key"] for r in shifted.df.collect()) == list(range(400))


def test_normal_sums_group_and_sql_path_refusal(spark):
    from tallsketch.operators.sketch import NORMAL_TRIAL

    mf = S.orders_matrix(spark, SF001)
    _, A, b = to_numpy(mf)
    sk = sketch(mf, "rademacher", 20, 1, 3, with_normal_sums=True)
    extra = sk.to_wide().where(F.col("trial") == NORMAL_TRIAL).collect()
    assert len(extra) == 1 and np.isclose(extra[0]["v3"], b @ b, rtol=1e-12)
    assert np.allclose([extra[0][f"v{i}"] for i in range(3)], A.T @ b, rtol=1e-12)
    with pytest.raises(ValueError):
        sketch(mf, "gaussian", 20, 1, 3, method="sql", with_normal_sums=True)
