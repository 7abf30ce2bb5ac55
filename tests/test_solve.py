import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001, to_numpy
from tallsketch.operators.generate import gen_matrix
from tallsketch.operators.lsqr import lsqr
from tallsketch.operators.sketch import sketch
from tallsketch.operators.small_solve import exact_solve, factors_to_numpy, solve_sketch
from tallsketch.plans.solve import JobParams, solve
from tallsketch.sources import matrix as S


@pytest.fixture(scope="module")
def gen(spark):
    keys = spark.range(20000).withColumnRenamed("id", "k")
    mf = gen_matrix(keys, "k", 10, seed=7).persist()
    _, A, b = to_numpy(mf)
    x = np.linalg.lstsq(A, b, rcond=None)[0]
    yield mf, A, b, x, np.linalg.norm(A @ x - b)
    mf.unpersist()


def test_exact_solve_wide_and_array(spark):
    for mf in (S.orders_matrix(spark, SF001), S.embeddings_matrix(spark, SF001)):
        _, A, b = to_numpy(mf)
        x = np.linalg.lstsq(A, b, rcond=None)[0]
        r = exact_solve(mf).first()
        assert np.allclose(r["x"], x, rtol=1e-7, atol=1e-9 * np.abs(x).max())
        assert abs(r["resid"] - np.linalg.norm(A @ x - b)) < 1e-8 * np.linalg.norm(b)


def test_tsqr_tree_reduction_many_partitions(spark):
    mf = S.orders_matrix(spark, SF001)
    _, A, b = to_numpy(mf)
    import tallsketch.operators.small_solve as SS

    old = SS.FANOUT
    SS.FANOUT = 3
    try:
        r = exact_solve(mf.with_df(mf.df.repartition(20))).first()
    finally:
        SS.FANOUT = old
    assert np.allclose(r["x"], np.linalg.lstsq(A, b, rcond=None)[0], rtol=1e-7)


def test_factor_orthonormalizes_sketch(spark, gen):
    mf = gen[0]
    sk = sketch(mf, "gaussian", 100, 2, 3)
    N = factors_to_numpy(solve_sketch(sk), 10)
    rows = sk.to_wide().orderBy("trial", "bucket").collect()
    for t in range(2):
        SA = np.array([[r[f"v{i}"] for i in range(10)] for r in rows if r["trial"] == t])
        Q = SA @ N[t]
        assert np.linalg.norm(Q.T @ Q - np.eye(10)) < 1e-10


def test_low_precision_quality_and_high_precision_accuracy(spark, gen):
    mf, A, b, x_opt, f_opt = gen
    for kind in ("cw", "gaussian", "rademacher", "srdht"):
        c = 400 if kind == "cw" else 200
        low = solve(mf, JobParams(precision="low", sketch="projection", kind=kind, c=c, seed=1, persist=False))
        x = np.array(low.solutions.first()["x"])
        assert abs(np.linalg.norm(A @ x - b) - f_opt) / f_opt < 0.2
    high = solve(mf, JobParams(precision="high", sketch="projection", kind="gaussian", c=200, iters=30, seed=1, persist=False))
    x = np.array(high.history.final()[0])
    assert np.linalg.norm(x - x_opt) / np.linalg.norm(x_opt) < 1e-8


def test_preconditioned_system_is_well_conditioned(spark, gen):
    mf, A, b, _, _ = gen
    N = factors_to_numpy(solve_sketch(sketch(mf, "gaussian", 100, 1, 2)), 10)[0]
    assert np.linalg.cond(A @ N) < 3


def test_sampling_sketch_keeps_high_leverage_rows(spark, gen):
    mf, A, b, x_opt, f_opt = gen
    res = solve(mf, JobParams(precision="low", sketch="sampling", kind="cw", c=400, s=600, seed=2, persist=False))
    x = np.array(res.solutions.first()["x"])
    assert abs(np.linalg.norm(A @ x - b) - f_opt) / f_opt < 0.2
    # the identity rows of G1 carry the last five coefficients: they must be solved well
    assert np.allclose(x[5:], x_opt[5:], rtol=0.5, atol=1.0)


def test_rank_deficient_sketch_gives_min_norm_and_rank(spark):
    df = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("u"))
    mf = S.from_columns(df, "k", [F.lit(1.0), "u", F.col("u") * 2], F.col("u") + 1.0)
    r = solve_sketch(sketch(mf, "cw", 30, 1, 1)).first()
    assert r["rank"] == 2 and np.all(np.isfinite(r["x"]))


def test_lsqr_consistent_system_freezes_without_nan(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 13).cast("double").alias("u"))
    mf = S.from_columns(df, "k", [F.lit(1.0), "u"], F.col("u") * 3 + 2)
    res = lsqr(mf, None, 8)
    xs = np.array([h["x"] for h in res.history])
    assert np.all(np.isfinite(xs))
    assert np.allclose(xs[-1], [2, 3], atol=1e-9)


def test_lsqr_zero_rhs_returns_zero_history(spark):
    df = spark.range(50).select(F.col("id").alias("k"), F.col("id").cast("double").alias("u"))
    mf = S.from_columns(df, "k", [F.lit(1.0), "u"], F.lit(0.0))
    res = lsqr(mf, None, 4)
    assert len(res.history) == 4 and all(np.allclose(h["x"], 0) for h in res.history)


def test_array_layout_lsqr_matches_numpy(spark):
    mf = S.embeddings_matrix(spark, SF001)
    _, A, b = to_numpy(mf)
    x_opt = np.linalg.lstsq(A, b, rcond=None)[0]
    N = factors_to_numpy(solve_sketch(sketch(mf, "gaussian", 300, 1, 1)), 64)
    res = lsqr(mf, N, 25)
    x = res.final()[0]
    assert np.linalg.norm(x - x_opt) / np.linalg.norm(x_opt) < 1e-6


def test_lsqr_stop_early_freezes_after_convergence(spark, monkeypatch):
    from tallsketch.operators import lsqr as module

    passes, one_pass = [], module.lsqr_pass
    monkeypatch.setattr(module, "lsqr_pass", lambda *a, **k: passes.append(1) or one_pass(*a, **k))
    mf = S.orders_matrix(spark, SF001).persist()
    try:
        N = factors_to_numpy(solve_sketch(sketch(mf, "cw", 100, 1, 3)), 3)
        full = lsqr(mf, N, 15)
        of_full = len(passes)
        early = lsqr(mf, N, 15, stop_early=True)
        assert np.allclose(full.final()[0], early.final()[0], rtol=1e-9)
        assert any(h["frozen"] for h in early.history) and len(passes) - of_full < of_full
        assert len(early.history) == 15  # the history still has q rows (last iterate repeated)
    finally:
        mf.unpersist()


def test_normal_sums_ride_along_the_count_sketch(spark):
    from tallsketch.operators.small_solve import factors_with_normal_sums

    mf = S.orders_matrix(spark, SF001)
    _, A, b = to_numpy(mf)
    for kind in ("gaussian", "srdht"):
        f2, (s2, g2) = factors_with_normal_sums(mf, kind, 40, 1, 5)
        assert np.isclose(s2, b @ b, rtol=1e-12) and np.allclose(g2, A.T @ b, rtol=1e-12)
        ref = factors_to_numpy(solve_sketch(sketch(mf, kind, 40, 1, 5)), 3)[0]
        assert np.allclose(f2[0] @ f2[0].T, ref @ ref.T, rtol=1e-9)
    emb = S.embeddings_matrix(spark, SF001)
    _, Ae, be = to_numpy(emb)
    _, (se, ge) = factors_with_normal_sums(emb, "cw", 200, 1, 5)
    assert np.isclose(se, be @ be, rtol=1e-12) and np.allclose(ge, Ae.T @ be, rtol=1e-10, atol=1e-9)
    factors, (s0, g0) = factors_with_normal_sums(mf, "cw", 100, 2, 5)
    assert np.isclose(s0, b @ b, rtol=1e-12) and np.allclose(g0, A.T @ b, rtol=1e-12)
    plain = factors_to_numpy(solve_sketch(sketch(mf, "cw", 100, 2, 5)), 3)
    for t in (0, 1):
        assert np.allclose(factors[t] @ factors[t].T, plain[t] @ plain[t].T, rtol=1e-9)
    with_init = lsqr(mf, factors, 5, init=(s0, g0)).final()
    without = lsqr(mf, factors, 5).final()
    for t in (0, 1):
        assert np.allclose(with_init[t], without[t], rtol=1e-9)


def test_rank_cutoff_does_not_grow_with_rows():
    from tallsketch.functions.blocks import solve_from_r

    R = np.diag([5e7, 5e7, 1.0, 1.0, 0.0])
    R[:4, 4] = R.diagonal()[:4] * np.array([1.0, 2.0, 3.0, 4.0])
    sol = solve_from_r(R, 4)  # the R factor of a matrix with 1e12 rows
    assert sol["rank"] == 4 and np.allclose(sol["x"], [1, 2, 3, 4])


def test_null_rows_raise_or_drop_on_every_path(spark):
    from tallsketch.sources.matrix import from_columns

    rows = [(k, 1.0, float(k % 7), float(k)) for k in range(40)] + [(40, 1.0, None, 3.0)]
    df = spark.createDataFrame(rows, "id long, u double, v double, y double")
    for mode, n in (("drop", 40), ("error", None)):
        mf = from_columns(df, "id", ["u", "v"], "y", mode=mode)
        for run in (lambda: sketch(mf, "cw", 10, 1, 3).df.collect(), lambda: lsqr(mf, None, 2),
                    lambda: lsqr(mf, {t: np.eye(2) for t in range(200)}, 1), lambda: exact_solve(mf).collect()):
            if n is None:
                with pytest.raises(Exception, match="null"):
                    run()
            else:
                run()


def test_too_small_samples_are_refused(spark):
    mf = S.orders_matrix(spark, SF001).persist()
    try:
        for s, precision in ((2, "high"), (1e-9, "low"), (3, "low")):
            with pytest.raises(ValueError, match="sampl"):
                solve(mf, JobParams(precision=precision, sketch="sampling", kind="cw", c=100, s=s, iters=3, trials=3, seed=1))
    finally:
        mf.unpersist()
