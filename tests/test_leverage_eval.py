import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001, to_numpy
from tallsketch.functions import hashing as H
from tallsketch.operators import evaluate as E
from tallsketch.operators import leverage as L
from tallsketch.operators import products as V
from tallsketch.operators.sketch import sketch
from tallsketch.operators.small_solve import factors_to_numpy, solve_sketch
from tallsketch.sources import matrix as S


def test_leverage_probabilities_and_sample_match_numpy(spark):
    mf = S.orders_matrix(spark, SF001)
    keys, A, b = to_numpy(mf)
    N = factors_to_numpy(solve_sketch(sketch(mf, "cw", 100, 2, 4)), 3)
    probs = {(r["trial"], r["key"]): (r["lev"], r["p"]) for r in L.inclusion_probs(L.leverage_scores(mf, N), 200).collect()}
    sample = {(r["trial"], r["key"]): r for r in L.leverage_sample(mf, N, 200, 4).collect()}
    for t in range(2):
        lev = np.sum((A @ N[t]) ** 2, axis=1)
        p = np.minimum(1.0, 200 * lev / lev.sum())
        u = H.np_key_coin(keys, H.sample_poly(4, "lev-sample", t))
        kept = keys[u < p]
        for i, k in enumerate(keys):
            assert abs(probs[(t, int(k))][0] - lev[i]) < 1e-12 + 1e-9 * lev[i]
        assert sorted(k for (tt, k) in sample if tt == t) == sorted(int(k) for k in kept)
        for i in np.flatnonzero(u < p)[:20]:
            r = sample[(t, int(keys[i]))]
            assert abs(r["b"] - b[i] / np.sqrt(p[i])) < 1e-6 * abs(b[i] / np.sqrt(p[i])) + 1e-9


def test_array_layout_leverage(spark):
    mf = S.embeddings_matrix(spark, SF001)
    _, A, _ = to_numpy(mf)
    N = factors_to_numpy(solve_sketch(sketch(mf, "gaussian", 300, 1, 1)), 64)
    got = np.array([r["lev"] for r in L.leverage_scores(mf, N).orderBy("key").collect()])
    assert np.allclose(got, np.sum((A @ N[0]) ** 2, axis=1), rtol=1e-9)
    assert abs(got.sum() - 64) < 20  # leverages of a good factor sum to about n


def test_sampling_needs_s(spark):
    mf = S.orders_matrix(spark, SF001)
    with pytest.raises(ValueError):
        L.leverage_sample(mf, {0: np.eye(3)}, None, 1)


def test_products_match_numpy(spark):
    for mf in (S.orders_matrix(spark, SF001), S.embeddings_matrix(spark, SF001)):
        keys, A, b = to_numpy(mf)
        v = np.linspace(-1, 2, mf.n)
        av = {r["key"]: r["av"] for r in V.matvec(mf, v).collect()}
        assert np.allclose([av[int(k)] for k in keys], A @ v)
        u = F.col("key").cast("double") / 1000.0
        got = sorted((r["pos"], r["val"]) for r in V.vecmat(mf, u).collect())
        assert np.allclose([g[1] for g in got], (keys / 1000.0) @ A)
        ut = mf.df.select("key", (F.col("key") % 5).cast("double").alias("u"))
        got2 = sorted((r["pos"], r["val"]) for r in V.vecmat(mf, ut).collect())
        assert np.allclose([g[1] for g in got2], (keys % 5) @ A)
        cands = {0: np.zeros(mf.n), 1: v}
        norms = {r["cand"]: r["norm"] for r in V.residual_norms(mf, cands).collect()}
        assert np.isclose(norms[1], np.linalg.norm(A @ v - b)) and np.isclose(norms[0], np.linalg.norm(b))
    with pytest.raises(ValueError):
        V.matvec(mf, [1.0])


def test_stack_cost_matches_stacked_objective(spark):
    mf = S.events_dense_matrix(spark, SF001)
    _, A, b = to_numpy(mf)
    heavy = ((A != 0).sum(1) + (b != 0)) > 2
    x = np.array([0.7, 30.0])
    r = 3
    As = np.vstack([A] + [A[heavy]] * (r - 1))
    bs = np.concatenate([b] + [b[heavy]] * (r - 1))
    got = E.stack_cost(mf, {0: x}, r, "dense").first()["cost"]
    assert np.isclose(got, np.linalg.norm(As @ x - bs) / np.sqrt(r))


def test_median_trial_picks_lower_median(spark):
    rows = [(t, it, 0.0, err) for t, errs in enumerate([[3.0, 2.0, 0.4], [3.0, 2.0, 0.1], [3.0, 2.0, 0.3], [3.0, 2.0, 0.2]])
            for it, err in enumerate(errs)]
    errors = spark.createDataFrame(rows, "cand int, iter int, x_relerr double, f_relerr double")
    picked = [r["f_relerr"] for r in E.median_trial(errors).orderBy("iter").collect()]
    assert picked == [3.0, 2.0, 0.2]  # finals 0.1 0.2 0.3 0.4 -> rank floor(3/2) = 1
    med = E.median_low(errors.where("iter = 2")).first()
    assert np.isclose(med["f_relerr_median"], 0.25)


def test_relative_errors_against_optimum(spark):
    mf = S.orders_matrix(spark, SF001)
    _, A, b = to_numpy(mf)
    x_opt, f_opt = E.optimum(mf)
    assert np.allclose(x_opt, np.linalg.lstsq(A, b, rcond=None)[0], rtol=1e-7)
    xs = {(0, 0): x_opt * 1.01, (0, 1): x_opt}
    errs = {(r["cand"], r["iter"]): r for r in E.relative_errors(mf, xs, x_opt, f_opt).collect()}
    assert abs(errs[(0, 1)]["f_relerr"]) < 1e-9 and abs(errs[(0, 0)]["x_relerr"] - 0.01) < 1e-9


def test_many_candidates_use_block_residuals(spark):
    mf = S.orders_matrix(spark, SF001)
    keys, A, b = to_numpy(mf)
    rng = np.random.default_rng(1)
    cands = {(t, i): rng.standard_normal(3) * 1000 for t in range(3) for i in range(40)}  # 120 x 3 > 256 terms
    got = {(r["cand"], r["iter"]): r["norm"] for r in V.residual_norms(mf, cands).collect()}
    for key, x in cands.items():
        assert np.isclose(got[key], np.linalg.norm(A @ x - b), rtol=1e-10)


def test_wide_block_paths_match_expressions(spark):
    import tallsketch.operators.leverage as LL
    import tallsketch.operators.lsqr as LQ

    mf = S.orders_matrix(spark, SF001)
    N = factors_to_numpy(solve_sketch(sketch(mf, "cw", 100, 2, 4)), 3)
    P, q = np.array([[1.0, -2.0, 0.5], [0.3, 0.2, 0.1]]), np.array([0.7, -1.1])
    expr_lev = sorted((r["trial"], r["key"], r["lev"]) for r in LL.leverage_scores(mf, N).collect())
    expr_pass = LQ.lsqr_pass(mf, P, q)
    old = (LL.MAX_EXPR_TERMS, LQ.MAX_EXPR_TERMS)
    LL.MAX_EXPR_TERMS = LQ.MAX_EXPR_TERMS = 0
    try:
        block_lev = sorted((r["trial"], r["key"], r["lev"]) for r in LL.leverage_scores(mf, N).collect())
        block_pass = LQ.lsqr_pass(mf, P, q)
    finally:
        LL.MAX_EXPR_TERMS, LQ.MAX_EXPR_TERMS = old
    assert [a[:2] for a in expr_lev] == [b[:2] for b in block_lev]
    assert np.allclose([a[2] for a in expr_lev], [b[2] for b in block_lev], rtol=1e-10)
    assert np.allclose(expr_pass[0], block_pass[0], rtol=1e-10) and np.allclose(expr_pass[1], block_pass[1], rtol=1e-10)


def test_preconditioner_quality_against_numpy(spark):
    from tallsketch.operators.evaluate import preconditioner_quality
    from tallsketch.operators.sketch import sketch
    from tallsketch.operators.small_solve import factors_to_numpy, solve_sketch

    for mf, kind, c in ((S.orders_matrix(spark, SF001), "cw", 100), (S.embeddings_matrix(spark, SF001), "gaussian", 300)):
        _, A, _ = to_numpy(mf)
        factors = factors_to_numpy(solve_sketch(sketch(mf, kind, c, 2, 3)), mf.n)
        wrong = {0: factors[0], 1: np.eye(mf.n), 2: factors[1] @ np.diag([0.0] + [1.0] * (mf.n - 1))}
        got = {r["trial"]: r for r in preconditioner_quality(mf, {**wrong, 3: factors[1]}).collect()}
        for t, N in {**wrong, 3: factors[1]}.items():
            values = np.linalg.svd(A @ N, compute_uv=False)
            assert np.isclose(got[t]["sv_max"], values[0], rtol=1e-8)
            assert np.isclose(got[t]["sv_min"], values[-1], rtol=1e-6, atol=1e-5 * values[0])
        assert got[3]["cond"] < 3.5 and not (got[2]["cond"] or 1e9) < 1e6
        if kind == "cw":  # ill-conditioned without a factor
            assert got[1]["cond"] > 50 * got[3]["cond"]
    with pytest.raises(ValueError):
        preconditioner_quality(mf, {0: np.eye(2)})


def test_stack_cost_of_many_candidates_is_the_same_by_blocks(spark):
    from tallsketch.operators.evaluate import stack_cost

    mf = S.events_dense_matrix(spark, SF001)
    few = {(3, 1): [0.5, 100.0], (9, 2): [1.0, 50.0], (4, 0): [0.0, 0.0]}
    many = {k: [k / 10.0, 100.0 - k] for k in range(200)}
    by_row = {r["cand"]: r["cost"] for r in stack_cost(mf, few, 3).collect()}
    assert set(by_row) == {3, 9, 4}
    blocks = {r["cand"]: r["cost"] for r in stack_cost(mf, many, 3).collect()}
    for k in (0, 5, 77, 199):
        assert np.isclose(blocks[k], next(iter(stack_cost(mf, {k: many[k]}, 3).collect()))["cost"], rtol=1e-12)
    arr = {r["cand"]: r["cost"] for r in stack_cost(mf.to_array(), few, 3).collect()}
    assert all(np.isclose(arr[k], by_row[k], rtol=1e-12) for k in by_row)
