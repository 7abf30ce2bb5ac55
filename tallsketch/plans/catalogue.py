"""The query catalogue: one Spark query per operator, with its DuckDB oracle.

Every query reads the driver tables (or data Spark derives from them) at ``sf_dir`` over
their whole extent, with fixed parameters (seed 42; c = 200 for count-sketch, 50 for dense
kinds; s = 500; q = 12).  Values are rounded to digits chosen from the magnitudes of the
columns so that both engines land on the same decimal (see SURVEY §4.4).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallsketch.functions import hashing as H
from tallsketch.operators import evaluate as E
from tallsketch.operators import leverage as L
from tallsketch.operators import products as V
from tallsketch.operators import shape as M
from tallsketch.operators.generate import gen_matrix
from tallsketch.operators.lsqr import DEFAULT_TOL
from tallsketch.operators.sketch import KINDS, merge, sketch
from tallsketch.operators.small_solve import exact_solve, factors_to_numpy, solve_sketch
from tallsketch.plans import oracles as O
from tallsketch.plans.solve import JobParams, compute_factors, run_job, solve
from tallsketch.session import scratch_path
from tallsketch.sources import matrix as S
from tallsketch.sources import sinks

SEED = 42
C_CW = 200
C_DENSE = 50
S_SAMPLE = 500
Q_ITERS = 12
K_HISTORY = 2
K_EVAL = 5
STACK_R = 3

# Fixed parameter vectors (products and costs evaluated over the whole table)
MATVEC_V = [1.0, 2.0, 3.0]
RESID_CANDIDATES = {0: [250000.0, -2500.0, 60.0], 1: [0.0, 0.0, 0.0], 2: [1.0, 1.0, 1.0], 3: [100000.0, 1000.0, 100.0]}
MANY_CANDIDATES = {j: [j / 500.0 - 0.5, float(j % 40)] for j in range(1000)}
STACK_CANDIDATES = {0: [0.5, 100.0], 1: [1.0, 50.0], 2: [2.0, 0.0]}

# Rounding digits per column of the OM view (a0 = 1, a1 = item count, a2 = quantity, b = price)
OM_DIGITS = [6, 6, 6, 6]
SKETCH_DIGITS = [6, 5, 4, 2]  # b sums keep the 2 decimals of prices: no ties
SAMPLE_DIGITS = [4, 3, 1, -2]
X_DIGITS = 2
LSQR_DIGITS = 1  # early iterates are Krylov fits computed from sums (one digit less than x)
LEV_DIGITS = 8
P_DIGITS = 7
ERR_DIGITS = 8
MEDIAN_DIGITS = 6  # errors of LSQR iterates (Krylov fits in the oracle)
RESID_EST_DIGITS = 1  # LSQR residual estimates (~1.8e7 at sf0.01)
MONITOR_DIGITS = {"nrm_r": 1, "nrm_ar": 0, "nrm_a": 6, "cnd_a": 6, "nrm_x": 0}
K_COND = 2
COND_DIGITS = 6
GEN_DIGITS = [6, 6, 16, 16, 6]


def rnd(c, d: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, d) + F.lit(0.0)


def kind_c(kind: str) -> int:
    return C_CW if kind == "cw" else C_DENSE


# ----------------------------------------------------------------------------- Spark side helpers

def _om(spark, sf):
    return S.orders_matrix(spark, sf)


def _sketch_out(sf_: "object") -> DataFrame:
    df = sf_.to_wide()
    return df.select("trial", "bucket", *[rnd(f"v{i}", SKETCH_DIGITS[i]).alias(f"v{i}") for i in range(4)])


def _x_out(df: DataFrame, digits: int = X_DIGITS, extra: list[str] | None = None) -> DataFrame:
    return df.select(*(extra or ["trial"]), *[rnd(F.element_at("x", i + 1), digits).alias(f"x{i}") for i in range(3)])


def _final_iterates(sol: DataFrame) -> DataFrame:
    last = sol.groupBy("trial").agg(F.max("iter").alias("iter"))
    return sol.join(last, ["trial", "iter"]).select("trial", "x")


def _factors_cw(mf) -> dict[int, np.ndarray]:
    return factors_to_numpy(solve_sketch(sketch(mf, "cw", C_CW, 1, SEED)), 3)


def _nnt_scaled(spark: SparkSession, factors: dict[int, np.ndarray], colnorm2: dict[int, list[float]]) -> DataFrame:
    rows = []
    for t, N in factors.items():
        G = N @ N.T
        d = np.sqrt(np.asarray(colnorm2[t]))
        for i in range(3):
            for j in range(3):
                rows.append((int(t), i, j, float(G[i, j] * d[i] * d[j])))
    return spark.createDataFrame(rows, "trial int, i int, j int, nnt double").select(
        "trial", "i", "j", rnd("nnt", 6).alias("nnt"))


def _colnorms(sf_) -> dict[int, list[float]]:
    df = sf_.to_wide()
    out = {}
    for r in df.groupBy("trial").agg(*[F.sum(F.col(f"v{i}") * F.col(f"v{i}")).alias(f"g{i}") for i in range(3)]).collect():
        out[int(r["trial"])] = [r["g0"], r["g1"], r["g2"]]
    return out


# ----------------------------------------------------------------------------- queries

def q_read_text_matrix(spark, sf):
    path = scratch_path(spark, "om-text")
    S.write_text_matrix(_om(spark, sf), path)
    mf = S.read_text_matrix(spark, path, key="first")
    return mf.df.select("key", *[rnd(f"a{i}", OM_DIGITS[i]).alias(f"a{i}") for i in range(3)], rnd("b", 6).alias("b"))


def q_read_text_line_keys(spark, sf):
    """S1 with its default key: lines without a key, numbered over all files in path order."""
    path = scratch_path(spark, "om-lines")
    S.write_text_matrix(_om(spark, sf), path, with_key=False)
    mf = S.read_text_matrix(spark, path)
    return mf.df.select("key", *[rnd(f"a{i}", OM_DIGITS[i]).alias(f"a{i}") for i in range(3)], rnd("b", 6).alias("b"))


def q_read_optimum(spark, sf):
    """The optimum of the whole matrix, written as two texts and read back."""
    sol = exact_solve(_om(spark, sf))
    path = scratch_path(spark, "optimum")
    S.write_vector_text(sol.select(F.explode("x").alias("value")), f"{path}/x_opt")
    S.write_vector_text(sol.select(F.col("resid").alias("value")), f"{path}/f_opt")
    rows = [(*S.read_vector_text(spark, f"{path}/x_opt"), *S.read_vector_text(spark, f"{path}/f_opt"))]
    out = spark.createDataFrame(rows, "x0 double, x1 double, x2 double, f double")
    return out.select(*[rnd(f"x{i}", X_DIGITS).alias(f"x{i}") for i in range(3)], rnd("f", 2).alias("f"))


def q_matrix_from_columns(spark, sf):
    mf = _om(spark, sf)
    return mf.df.select("key", *[rnd(f"a{i}", OM_DIGITS[i]).alias(f"a{i}") for i in range(3)], rnd("b", 6).alias("b"))


def q_matrix_from_array(spark, sf):
    mf = S.embeddings_matrix(spark, sf, n=64)
    return mf.df.select("key", rnd(F.element_at("a", 1), 6).alias("a_first"), rnd(F.element_at("a", -1), 6).alias("a_last"),
                        F.size("a").cast("int").alias("n"), rnd("b", 6).alias("b"))


def q_matrix_dims(spark, sf):
    return M.dims_frame(S.embeddings_matrix(spark, sf, n=None))


def q_matrix_head(spark, sf):
    return sinks.head(_om(spark, sf), 10).select("key", rnd("b", 6).alias("b"))


def q_row_index(spark, sf):
    ev = S.table(spark, sf, "events").select("event_id", "value")
    return M.row_index(ev, ["value", "event_id"], "idx").select("event_id", "idx")


def q_stack_all(spark, sf):
    return M.stack(S.events_matrix(spark, sf), STACK_R, "all").df.select("key", "rep", rnd("b", 6).alias("b"))


def q_stack_dense(spark, sf):
    return M.stack(S.events_dense_matrix(spark, sf), STACK_R, "dense").df.select("key", "rep", rnd("b", 6).alias("b"))


def q_target_vector(spark, sf):
    return M.target(_om(spark, sf)).select("key", rnd("b", 6).alias("b"))


def q_matvec(spark, sf):
    return V.matvec(_om(spark, sf), MATVEC_V).select("key", rnd("av", 6).alias("av"))


def vecmat_u_sql(dialect: str) -> str:
    return H.sql_uniform(H.sql_hash_key("key", H.poly(SEED, "vecmat-u"), dialect))


def q_vecmat(spark, sf):
    return V.vecmat(_om(spark, sf), F.expr(vecmat_u_sql("spark"))).select("pos", rnd("val", 4).alias("val"))


def q_residual_norms(spark, sf):
    return V.residual_norms(_om(spark, sf), RESID_CANDIDATES).select("cand", rnd("norm", 4).alias("norm"))


def q_uniform_sample(spark, sf):
    return M.uniform_sample(S.events_matrix(spark, sf), 1000, SEED).df.select("key", rnd("b", 6).alias("b_scaled"))


def q_sketch(kind):
    def q(spark, sf):
        return _sketch_out(sketch(_om(spark, sf), kind, kind_c(kind), 1, SEED))
    return q


def q_sketch_srdht_gaps(spark, sf):
    """P4 on keys with gaps: the transform runs over the ranks of the keys, which stay as they are."""
    mf = _om(spark, sf)
    wide = mf.with_df(mf.df.withColumn("key", F.col("key") * 7 + F.col("key") % 5).select(*mf.data_columns))
    return _sketch_out(sketch(wide, "srdht", C_DENSE, 1, SEED))


def q_sketch_merge(spark, sf):
    mf = _om(spark, sf)
    even = mf.with_df(mf.df.where(F.col("key") % 2 == 0))
    odd = mf.with_df(mf.df.where(F.col("key") % 2 == 1))
    return _sketch_out(merge(sketch(even, "cw", C_CW, 1, SEED), sketch(odd, "cw", C_CW, 1, SEED)))


def q_sketch_trials(spark, sf):
    return _sketch_out(sketch(_om(spark, sf), "cw", C_CW, 3, SEED))


def q_sketch_solve(spark, sf):
    return _x_out(solve_sketch(sketch(_om(spark, sf), "cw", C_CW, 1, SEED)))


def q_sketch_factor(spark, sf):
    """R2 as (trial, i, j, nnt).  N itself is unique only up to signs/rotation, N·Nᵀ =
    ((SA)ᵀSA)^-1 is not; it is published scaled by the column norms of SA,
    nnt_ij = (N·Nᵀ)_ij·‖SA_i‖·‖SA_j‖ (the inverse of SA's column-normalized Gram matrix), so
    all entries have comparable magnitude for rounding."""
    sk = sketch(_om(spark, sf), "cw", C_CW, 1, SEED)
    return _nnt_scaled(spark, factors_to_numpy(solve_sketch(sk), 3), _colnorms(sk))


def q_leverage_scores(spark, sf):
    mf = _om(spark, sf)
    return L.leverage_scores(mf, _factors_cw(mf)).select("trial", "key", rnd("lev", LEV_DIGITS).alias("lev"))


def q_leverage_sum(spark, sf):
    mf = _om(spark, sf)
    return L.leverage_sums(L.leverage_scores(mf, _factors_cw(mf))).select("trial", rnd("lev_sum", LEV_DIGITS).alias("lev_sum"))


def q_inclusion_prob(spark, sf):
    mf = _om(spark, sf)
    return L.inclusion_probs(L.leverage_scores(mf, _factors_cw(mf)), S_SAMPLE).select("trial", "key", rnd("p", P_DIGITS).alias("p"))


def q_leverage_sample(spark, sf):
    mf = _om(spark, sf)
    return L.leverage_sample(mf, _factors_cw(mf), S_SAMPLE, SEED).select("trial", "key")


def q_sampling_sketch(spark, sf):
    mf = _om(spark, sf)
    smp = L.leverage_sample(mf, _factors_cw(mf), S_SAMPLE, SEED)
    ws = [rnd(f"a{i}", SAMPLE_DIGITS[i]).alias(f"w{i}") for i in range(3)] + [rnd("b", SAMPLE_DIGITS[3]).alias("w3")]
    return smp.select("trial", "key", *ws)


def _params(**kw) -> JobParams:
    return JobParams(seed=SEED, **kw)


def q_ls_low(kind):
    def q(spark, sf):
        res = solve(_om(spark, sf), _params(precision="low", sketch="projection", kind=kind, c=kind_c(kind)))
        return _x_out(res.solutions)
    return q


def q_ls_low_sampling(kind):
    def q(spark, sf):
        res = solve(_om(spark, sf), _params(precision="low", sketch="sampling", kind=kind, c=kind_c(kind), s=S_SAMPLE))
        return _x_out(res.solutions)
    return q


def q_ls_high(kind, sketch_type="projection"):
    def q(spark, sf):
        res = solve(_om(spark, sf), _params(precision="high", sketch=sketch_type, kind=kind, c=kind_c(kind),
                                            s=S_SAMPLE, iters=Q_ITERS))
        return _x_out(_final_iterates(res.solutions))
    return q


def q_ls_high_plain(spark, sf):
    res = solve(_om(spark, sf), _params(precision="high", sketch=None, iters=Q_ITERS))
    return _x_out(_final_iterates(res.solutions))


def q_exact_solution(spark, sf):
    sol = exact_solve(_om(spark, sf))
    return sol.select(*[rnd(F.element_at("x", i + 1), X_DIGITS).alias(f"x{i}") for i in range(3)], rnd("resid", 2).alias("f"))


def _history_run(spark, sf):
    return solve(_om(spark, sf), _params(precision="high", sketch="projection", kind="cw", c=C_CW, iters=Q_ITERS,
                                         trials=K_HISTORY))


def q_lsqr_history(spark, sf):
    res = _history_run(spark, sf)
    return _x_out(res.solutions, digits=LSQR_DIGITS, extra=["trial", "iter"])


def q_lsqr_residual_estimates(spark, sf):
    """H7's residual estimate phibar per (trial, iter) -- the monitor with a closed form."""
    res = _history_run(spark, sf)
    return res.history.to_frame(spark).select("trial", "iter", rnd("nrm_r", RESID_EST_DIGITS).alias("nrm_r"))


def q_lsqr_monitors(spark, sf):
    """H7 after the first two iterations, before n = 3 exhausts the Krylov space."""
    res = solve(_om(spark, sf), _params(precision="high", sketch="projection", kind="cw", c=C_CW, iters=2, trials=K_HISTORY))
    return res.history.to_frame(spark).select("trial", "iter", *[rnd(c, d).alias(c) for c, d in MONITOR_DIGITS.items()], "stag", "flag")


def q_preconditioner_cond(spark, sf):
    """H3/H4: extreme singular values of A N for the factors of every sketch, on the whole matrix."""
    mf = _om(spark, sf).persist()
    try:
        found = []
        for kind, sketch_type in [(k, "projection") for k in KINDS] + [("cw", "sampling")]:
            p = _params(precision="high", sketch=sketch_type, kind=kind, c=kind_c(kind), s=S_SAMPLE, iters=1, trials=K_COND)
            quality = E.preconditioner_quality(mf, compute_factors(mf, p, {}))
            label = kind if sketch_type == "projection" else sketch_type
            found.append(quality.select(F.lit(label).alias("factor"), "trial", *[rnd(c, COND_DIGITS).alias(c) for c in ("sv_min", "sv_max", "cond")]))
    finally:
        mf.unpersist()
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def _eval_low(spark, sf) -> DataFrame:
    # evaluate() returns materialized k-row errors, so the rows can be released right after
    mf = _om(spark, sf).persist()
    try:
        p = _params(precision="low", sketch="projection", kind="cw", c=C_CW, trials=K_EVAL, persist=False)
        return E.evaluate(solve(mf, p), mf, p)
    finally:
        mf.unpersist()


def q_eval_f_relerr(spark, sf):
    return _eval_low(spark, sf).select("cand", rnd("f_relerr", ERR_DIGITS).alias("err"))


def q_eval_x_relerr(spark, sf):
    return _eval_low(spark, sf).select("cand", rnd("x_relerr", ERR_DIGITS).alias("err"))


def q_eval_median_low(spark, sf):
    med = E.median_low(_eval_low(spark, sf))
    return med.select(rnd("x_relerr_median", ERR_DIGITS).alias("x_relerr_median"),
                      rnd("f_relerr_median", ERR_DIGITS).alias("f_relerr_median"))


def q_eval_median_trial(spark, sf):
    mf = _om(spark, sf).persist()  # released below: evaluate() returns materialized rows
    # two iterations: with n = 3 a third one is exact for every trial, and ranking trials by
    # a rounding-level final error would pick an arbitrary one
    try:
        p = _params(precision="high", sketch="projection", kind="cw", c=C_CW, iters=2, trials=4, persist=False)
        errs = E.evaluate(solve(mf, p), mf, p)
    finally:
        mf.unpersist()
    return E.median_trial(errs).select("iter", rnd("x_relerr", MEDIAN_DIGITS).alias("x_relerr"),
                                       rnd("f_relerr", MEDIAN_DIGITS).alias("f_relerr"))


def q_eval_stack_cost(spark, sf):
    return E.stack_cost(S.events_dense_matrix(spark, sf), STACK_CANDIDATES, STACK_R, "dense").select(
        "cand", rnd("cost", 4).alias("cost"))


def q_eval_stack_cost_many(spark, sf):
    """E3 for 1000 candidates in one pass, as a history of k·q iterates asks for."""
    return E.stack_cost(S.events_dense_matrix(spark, sf), MANY_CANDIDATES, STACK_R, "dense").select("cand", rnd("cost", 3).alias("cost"))


def q_job_end_to_end(spark, sf):
    """Text in, rows stacked, solved, written, evaluated; solutions and errors read back."""
    path = scratch_path(spark, "job")
    S.write_text_matrix(_om(spark, sf), f"{path}/in", with_key=False)
    p = _params(precision="high", sketch="projection", kind="cw", c=C_CW, iters=Q_ITERS, repeat=2, output_uri=f"{path}/out",
                evaluate=True, expect_dims=(S.table(spark, sf, "orders").count(), 3))
    run_job(spark, f"{path}/in", p, n=3)
    last = _final_iterates(sinks.read_solutions(spark, f"{path}/out"))
    errors = sinks.read_errors(spark, f"{path}/out").filter(F.col("iter") == Q_ITERS - 1)
    return _x_out(last).join(errors.select(F.col("cand").alias("trial"), rnd("x_relerr", 6).alias("x_relerr"),
                                           rnd("f_relerr", 6).alias("f_relerr")), "trial")


def q_factor_cache_roundtrip(spark, sf):
    mf = _om(spark, sf)
    p = _params(precision="high", sketch="projection", kind="cw", c=C_CW, iters=1, factor_cache=scratch_path(spark, "factors"))
    first = compute_factors(mf, p, {})
    timings: dict = {}
    again = compute_factors(mf, p, timings)
    if "factor_cache_hit" not in timings:
        raise RuntimeError("factor cache was not reused")
    assert all(np.array_equal(first[t], again[t]) for t in first)
    return _nnt_scaled(spark, again, _colnorms(sketch(mf, "cw", C_CW, 1, SEED)))


def q_solution_sink_roundtrip(spark, sf):
    res = solve(_om(spark, sf), _params(precision="low", sketch="projection", kind="cw", c=C_CW))
    path = scratch_path(spark, "result")
    sinks.write_result(res, path)
    return _x_out(sinks.read_solutions(spark, path))


def q_gen_matrix(spark, sf):
    mf = gen_matrix(S.table(spark, sf, "orders"), "o_orderkey", 4, SEED)
    return mf.df.select("key", *[rnd(f"a{j}", GEN_DIGITS[j]).alias(f"a{j}") for j in range(4)], rnd("b", GEN_DIGITS[4]).alias("b"))


def q_stream_sketch_cw(spark, sf):
    from tallsketch.streaming.sketch_stream import parquet_stream, run_to_table, stream_rows, streaming_cw_sketch

    rows = stream_rows(parquet_stream(spark, sf, "events"), "event_id", [F.lit(1.0), "user_id"], "value")
    name = "stream_sketch_" + scratch_path(spark, "q").rsplit("-", 1)[-1][:12]
    out = run_to_table(spark, streaming_cw_sketch(rows, 2, 100, 1, SEED), name)
    return out.select("trial", "bucket", rnd("v0", 6).alias("v0"), rnd("v1", 4).alias("v1"), rnd("v2", 4).alias("v2"))


ARRAY_V = [float((i % 7) - 3) for i in range(64)]  # fixed vector for the 64-wide mat-vec


def _array_sketch_out(sk) -> DataFrame:
    return sk.to_array().select("trial", "bucket", F.posexplode("v").alias("pos", "val")).select(
        "trial", "bucket", F.col("pos").cast("int").alias("pos"), rnd("val", 8).alias("val"))


def q_sketch_cw_array(spark, sf):
    return _array_sketch_out(sketch(S.embeddings_matrix(spark, sf), "cw", 100, 1, SEED))


def q_sketch_gaussian_array(spark, sf):
    return _array_sketch_out(sketch(S.embeddings_matrix(spark, sf), "gaussian", C_DENSE, 1, SEED))


def q_matvec_array(spark, sf):
    return V.matvec(S.embeddings_matrix(spark, sf), ARRAY_V).select("key", rnd("av", 8).alias("av"))


def _order_stream(spark, sf):
    """Orders and line items, each dealt to three micro-batches of as many files as there are cores, so
    line items come before, with and after their orders."""
    from tallsketch.streaming.sketch_stream import folder_stream, row_changes

    sides, files = {}, spark.sparkContext.defaultParallelism
    for name, cols in (("orders", ["o_orderkey", "o_totalprice"]), ("lineitem", ["l_orderkey", "l_quantity"])):
        sides[name] = scratch_path(spark, f"stream-{name}")
        S.table(spark, sf, name).select(*cols).repartition(3 * files).write.parquet(sides[name])
    return row_changes(folder_stream(spark, sides["orders"], files), "o_orderkey", [F.lit(1.0), F.lit(0.0), F.lit(0.0), "o_totalprice"],
                       folder_stream(spark, sides["lineitem"], files), "l_orderkey", [F.lit(0.0), F.lit(1.0), "l_quantity", F.lit(0.0)])


def q_stream_sketch_rows(spark, sf):
    """The sketch of orders x line items, both streamed, after the last micro-batch."""
    from tallsketch.streaming.sketch_stream import latest, maintain_sketch

    out = scratch_path(spark, "stream-sketch")
    maintain_sketch(_order_stream(spark, sf), 3, C_CW, out, k=1, seed=SEED, solve=False)
    df = latest(spark, f"{out}/sketch")
    return df.select("trial", "bucket", *[rnd(f"v{i}", SKETCH_DIGITS[i]).alias(f"v{i}") for i in range(4)])


def q_stream_ls_low_cw(spark, sf):
    """Orders and line items both arrive as streams.  The final micro-batch's solution equals the
    batch ``ls_low_cw``."""
    from tallsketch.streaming.sketch_stream import latest, maintain_sketch

    out = scratch_path(spark, "stream-solutions")
    maintain_sketch(_order_stream(spark, sf), 3, C_CW, out, k=1, seed=SEED)
    return _x_out(latest(spark, f"{out}/solutions"))


def queries() -> dict:
    q = {
        "read_text_matrix": q_read_text_matrix,
        "read_text_line_keys": q_read_text_line_keys,
        "read_optimum": q_read_optimum,
        "matrix_from_columns": q_matrix_from_columns,
        "matrix_from_array": q_matrix_from_array,
        "matrix_dims": q_matrix_dims,
        "matrix_head": q_matrix_head,
        "row_index": q_row_index,
        "stack_all": q_stack_all,
        "stack_dense": q_stack_dense,
        "target_vector": q_target_vector,
        "matvec": q_matvec,
        "vecmat": q_vecmat,
        "residual_norms": q_residual_norms,
        "uniform_sample": q_uniform_sample,
        "sketch_srdht_gaps": q_sketch_srdht_gaps,
        "sketch_merge": q_sketch_merge,
        "sketch_trials": q_sketch_trials,
        "sketch_solve": q_sketch_solve,
        "sketch_factor": q_sketch_factor,
        "leverage_scores": q_leverage_scores,
        "leverage_sum": q_leverage_sum,
        "inclusion_prob": q_inclusion_prob,
        "leverage_sample": q_leverage_sample,
        "sampling_sketch": q_sampling_sketch,
        "ls_high_sampling": q_ls_high("cw", "sampling"),
        "ls_high_plain": q_ls_high_plain,
        "exact_solution": q_exact_solution,
        "lsqr_history": q_lsqr_history,
        "lsqr_monitors": q_lsqr_monitors,
        "lsqr_residual_estimates": q_lsqr_residual_estimates,
        "preconditioner_cond": q_preconditioner_cond,
        "job_end_to_end": q_job_end_to_end,
        "eval_stack_cost_many": q_eval_stack_cost_many,
        "eval_f_relerr": q_eval_f_relerr,
        "eval_x_relerr": q_eval_x_relerr,
        "eval_median_low": q_eval_median_low,
        "eval_median_trial": q_eval_median_trial,
        "eval_stack_cost": q_eval_stack_cost,
        "factor_cache_roundtrip": q_factor_cache_roundtrip,
        "solution_sink_roundtrip": q_solution_sink_roundtrip,
        "gen_matrix": q_gen_matrix,
        "stream_sketch_cw": q_stream_sketch_cw,
        "stream_sketch_rows": q_stream_sketch_rows,
        "stream_ls_low_cw": q_stream_ls_low_cw,
        "sketch_cw_array": q_sketch_cw_array,
        "sketch_gaussian_array": q_sketch_gaussian_array,
        "matvec_array": q_matvec_array,
    }
    for kind in KINDS:
        q[f"sketch_{kind}"] = q_sketch(kind)
        q[f"ls_low_{kind}"] = q_ls_low(kind)
        q[f"ls_low_sampling_{kind}"] = q_ls_low_sampling(kind)
        q[f"ls_high_{kind}"] = q_ls_high(kind)
    return q


# ----------------------------------------------------------------------------- oracles

def _sketch_sel(src: str) -> str:
    vs = ", ".join(f"{O.rnd(f'v{i}', SKETCH_DIGITS[i])} AS v{i}" for i in range(4))
    return f"SELECT trial, bucket, {vs} FROM {src}"


def _exact_x() -> str:
    return O.with_(O.OM, O.gram("eg", "(SELECT 0 AS trial, * FROM om)", cols3=("a0", "a1", "a2", "b")),
                   O.cramer("ex", "eg")) + O.x_select("ex", X_DIGITS)


def _low_x(kind: str) -> str:
    return O.with_(O.OM, O.sketch("sk", "om", 3, kind, kind_c(kind), 1, SEED), O.gram("g", "sk"),
                   O.cramer("xs", "g")) + O.x_select("xs", X_DIGITS)


def _low_sampling_x(kind: str) -> str:
    chain = O.leverage_chain("L", "om", kind, kind_c(kind), 1, SEED, S_SAMPLE)
    return O.with_(O.OM, *chain, O.gram("sg", "L_smp", weight="(1.0 / p)", cols3=("a0", "a1", "a2", "b")),
                   O.cramer("xs", "sg")) + O.x_select("xs", X_DIGITS)


def _nnt_sql(extra_ctes: list[str], sk: str) -> str:
    rows = []
    for i in range(3):
        for j in range(3):
            rows.append(f"SELECT trial, CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, "
                        f"{O.inv(i, j)} * sqrt(g{i}{i}) * sqrt(g{j}{j}) AS nnt FROM fg")
    return (O.with_(O.OM, *extra_ctes, O.gram("fg", sk))
            + f"SELECT trial, i, j, {O.rnd('nnt', 6)} AS nnt FROM ({' UNION ALL '.join(rows)})")


def _eval_sql(select: str) -> str:
    """k=5 count-sketch solutions, their objective and errors against the exact optimum."""
    resid = "sqrt(sum((x.x0*o.a0 + x.x1*o.a1 + x.x2*o.a2 - o.b) * (x.x0*o.a0 + x.x1*o.a1 + x.x2*o.a2 - o.b)))"
    return O.with_(
        O.OM, O.sketch("sk", "om", 3, "cw", C_CW, K_EVAL, SEED), O.gram("g", "sk"), O.cramer("xs", "g"),
        O.gram("eg", "(SELECT 0 AS trial, * FROM om)", cols3=("a0", "a1", "a2", "b")), O.cramer("ex", "eg"),
        f"fopt AS (SELECT {resid.replace('x.', 'e.')} AS f FROM om o CROSS JOIN ex e)",
        f"fx AS (SELECT x.trial AS cand, {resid} AS f FROM om o CROSS JOIN xs x GROUP BY x.trial)",
        "errs AS (SELECT fx.cand, abs(fopt.f - fx.f) / fopt.f AS f_relerr, "
        "sqrt((xs.x0-ex.x0)*(xs.x0-ex.x0) + (xs.x1-ex.x1)*(xs.x1-ex.x1) + (xs.x2-ex.x2)*(xs.x2-ex.x2)) / "
        "sqrt(ex.x0*ex.x0 + ex.x1*ex.x1 + ex.x2*ex.x2) AS x_relerr "
        "FROM fx CROSS JOIN fopt JOIN xs ON xs.trial = fx.cand CROSS JOIN ex)") + select


def oracle_sql() -> dict[str, str]:
    om_sel = ", ".join(f"{O.rnd(f'a{i}', OM_DIGITS[i])} AS a{i}" for i in range(3))
    lev_chain = O.leverage_chain("L", "om", "cw", C_CW, 1, SEED, S_SAMPLE)
    q = {
        "read_text_matrix": O.with_(O.OM) + f"SELECT key, {om_sel}, {O.rnd('b', 6)} AS b FROM om",
        "read_text_line_keys": O.with_(O.OM) + f"SELECT CAST(row_number() OVER (ORDER BY key) - 1 AS BIGINT) AS key, {om_sel}, "
                                               f"{O.rnd('b', 6)} AS b FROM om",
        "matrix_from_columns": O.with_(O.OM) + f"SELECT key, {om_sel}, {O.rnd('b', 6)} AS b FROM om",
        "matrix_from_array": O.with_(O.EMB) + f"SELECT key, {O.rnd('a[1]', 6)} AS a_first, {O.rnd('a[len(a)]', 6)} AS a_last, "
                                              f"CAST(len(a) AS INTEGER) AS n, {O.rnd('b', 6)} AS b FROM emb",
        "matrix_dims": O.with_(O.EMB) + "SELECT CAST(count(*) AS BIGINT) AS m, CAST(max(len(a)) AS INTEGER) AS n FROM emb",
        "matrix_head": O.with_(O.OM) + f"SELECT key, {O.rnd('b', 6)} AS b FROM om ORDER BY key LIMIT 10",
        "row_index": "SELECT CAST(event_id AS BIGINT) AS event_id, "
                     "CAST(row_number() OVER (ORDER BY value NULLS FIRST, event_id) - 1 AS BIGINT) AS idx FROM events",
        "stack_all": O.with_(O.EV) + f"SELECT key * {STACK_R} + r.rep AS key, CAST(r.rep AS INTEGER) AS rep, "
                                     f"{O.rnd('b', 6)} AS b FROM ev CROSS JOIN (SELECT range AS rep FROM range({STACK_R})) r",
        "stack_dense": O.with_(O.EVD) + f"SELECT key * {STACK_R} + r.rep AS key, CAST(r.rep AS INTEGER) AS rep, "
                                        f"{O.rnd('b', 6)} AS b FROM evd CROSS JOIN (SELECT range AS rep FROM range({STACK_R})) r "
                                        "WHERE r.rep = 0 OR ((CASE WHEN a0 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN a1 <> 0 THEN 1 ELSE 0 END)"
                                        " + (CASE WHEN b <> 0 THEN 1 ELSE 0 END)) > 2",
        "target_vector": O.with_(O.OM) + f"SELECT key, {O.rnd('b', 6)} AS b FROM om",
        "matvec": O.with_(O.OM) + f"SELECT key, {O.rnd('1.0*a0 + 2.0*a1 + 3.0*a2', 6)} AS av FROM om",
        "vecmat": O.with_(O.OM, f"u AS (SELECT *, {vecmat_u_sql('duckdb')} AS u FROM om)",
                          "s AS (SELECT sum(u*a0) AS s0, sum(u*a1) AS s1, sum(u*a2) AS s2 FROM u)")
        + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS pos, {O.rnd(f's{i}', 4)} AS val FROM s" for i in range(3)),
        "residual_norms": O.with_(O.OM) + " UNION ALL ".join(
            f"SELECT CAST({c} AS INTEGER) AS cand, {O.rnd(f'sqrt(sum(pow({x[0]!r}*a0 + {x[1]!r}*a1 + {x[2]!r}*a2 - b, 2)))', 4)} AS norm FROM om"
            for c, x in RESID_CANDIDATES.items()),
        "uniform_sample": O.with_(O.EV, "pm AS (SELECT 1000.0 / CAST(count(*) AS DOUBLE) AS p FROM ev)")
        + f"SELECT key, {O.rnd('b * (1.0 / least(1.0, p))', 6)} AS b_scaled FROM ev CROSS JOIN pm WHERE "
          f"{H.sql_key_coin('key', H.sample_poly(SEED, 'uniform'), 'duckdb')} < least(1.0, p)",
        "sketch_srdht_gaps": O.with_(O.OM, "gaps AS (SELECT key * 7 + key % 5 AS key, a0, a1, a2, b FROM om)",
                                     O.sketch("sk", "gaps", 3, "srdht", C_DENSE, 1, SEED)) + _sketch_sel("sk"),
        "sketch_merge": O.with_(O.OM, O.sketch("sk", "om", 3, "cw", C_CW, 1, SEED)) + _sketch_sel("sk"),
        "sketch_trials": O.with_(O.OM, O.sketch("sk", "om", 3, "cw", C_CW, 3, SEED)) + _sketch_sel("sk"),
        "sketch_solve": _low_x("cw"),
        "sketch_factor": _nnt_sql([O.sketch("sk", "om", 3, "cw", C_CW, 1, SEED)], "sk"),
        "leverage_scores": O.with_(O.OM, *lev_chain) + f"SELECT trial, key, {O.rnd('lev', LEV_DIGITS)} AS lev FROM L_lev",
        "leverage_sum": O.with_(O.OM, *lev_chain) + f"SELECT trial, {O.rnd('lev_sum', LEV_DIGITS)} AS lev_sum FROM L_ls",
        "inclusion_prob": O.with_(O.OM, *lev_chain) + f"SELECT trial, key, {O.rnd('p', P_DIGITS)} AS p FROM L_p",
        "leverage_sample": O.with_(O.OM, *lev_chain) + "SELECT trial, key FROM L_smp",
        "sampling_sketch": O.with_(O.OM, *lev_chain) + "SELECT trial, key, " + ", ".join(
            f"{O.rnd(f'{c} / sqrt(p)', SAMPLE_DIGITS[i])} AS w{i}" for i, c in enumerate(["a0", "a1", "a2", "b"])) + " FROM L_smp",
        "ls_high_sampling": _exact_x(),
        "ls_high_plain": _exact_x(),
        "exact_solution": O.with_(O.OM, O.gram("eg", "(SELECT 0 AS trial, * FROM om)", cols3=("a0", "a1", "a2", "b")),
                                  O.cramer("ex", "eg"))
        + f"SELECT {O.rnd('x0', X_DIGITS)} AS x0, {O.rnd('x1', X_DIGITS)} AS x1, {O.rnd('x2', X_DIGITS)} AS x2, "
          f"{O.rnd('sqrt(sum((ex.x0*om.a0 + ex.x1*om.a1 + ex.x2*om.a2 - om.b)*(ex.x0*om.a0 + ex.x1*om.a1 + ex.x2*om.a2 - om.b)))', 2)} AS f "
          "FROM om CROSS JOIN ex GROUP BY ex.x0, ex.x1, ex.x2",
        "eval_f_relerr": _eval_sql(f"SELECT CAST(cand AS INTEGER) AS cand, {O.rnd('f_relerr', ERR_DIGITS)} AS err FROM errs"),
        "eval_x_relerr": _eval_sql(f"SELECT CAST(cand AS INTEGER) AS cand, {O.rnd('x_relerr', ERR_DIGITS)} AS err FROM errs"),
        "eval_median_low": _eval_sql(f"SELECT {O.rnd('median(x_relerr)', ERR_DIGITS)} AS x_relerr_median, "
                                     f"{O.rnd('median(f_relerr)', ERR_DIGITS)} AS f_relerr_median FROM errs"),
        "eval_stack_cost": O.with_(O.EVD) + " UNION ALL ".join(
            f"SELECT CAST({c} AS INTEGER) AS cand, {O.rnd(f'sqrt(sum(CASE WHEN ((CASE WHEN a0 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN a1 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN b <> 0 THEN 1 ELSE 0 END)) > 2 THEN {float(STACK_R)!r} ELSE 1.0 END * pow({x[0]!r}*a0 + {x[1]!r}*a1 - b, 2)) / {float(STACK_R)!r})', 4)} AS cost FROM evd"
            for c, x in STACK_CANDIDATES.items()),
        "lsqr_monitors": O.krylov_monitors_sql(K_HISTORY, C_CW, SEED, DEFAULT_TOL, MONITOR_DIGITS),
        "preconditioner_cond": O.conditions_sql({k: kind_c(k) for k in KINDS}, K_COND, SEED, S_SAMPLE, COND_DIGITS),
        "job_end_to_end": O.with_(O.OM, O.gram("eg", "(SELECT 0 AS trial, * FROM om)", cols3=("a0", "a1", "a2", "b")), O.cramer("ex", "eg"))
        + "SELECT *, CAST(0.0 AS DOUBLE) AS x_relerr, CAST(0.0 AS DOUBLE) AS f_relerr FROM (" + O.x_select("ex", X_DIGITS) + ")",
        "eval_stack_cost_many": O.with_(O.EVD, "w AS (SELECT *, CASE WHEN ((CASE WHEN a0 <> 0 THEN 1 ELSE 0 END) + "
                                        "(CASE WHEN a1 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN b <> 0 THEN 1 ELSE 0 END)) > 2 "
                                        f"THEN {float(STACK_R)!r} ELSE 1.0 END AS w FROM evd)",
                                        "cand AS (SELECT CAST(range AS INTEGER) AS cand, range / 500.0 - 0.5 AS x0, "
                                        "CAST(range % 40 AS DOUBLE) AS x1 FROM range(1000))")
        + f"SELECT cand, {O.rnd(f'sqrt(sum(w * pow(x0*a0 + x1*a1 - b, 2)) / {float(STACK_R)!r})', 3)} AS cost FROM w CROSS JOIN cand GROUP BY cand",
        "factor_cache_roundtrip": _nnt_sql([O.sketch("sk", "om", 3, "cw", C_CW, 1, SEED)], "sk"),
        "solution_sink_roundtrip": _low_x("cw"),
        "stream_sketch_rows": O.with_(O.OM, O.sketch("sk", "om", 3, "cw", C_CW, 1, SEED)) + _sketch_sel("sk"),
        "stream_ls_low_cw": _low_x("cw"),
        "lsqr_history": O.krylov_history_sql(K_HISTORY, C_CW, SEED, Q_ITERS, LSQR_DIGITS),
        "eval_median_trial": O.krylov_median_trial_sql(4, C_CW, SEED, MEDIAN_DIGITS),
        "lsqr_residual_estimates": O.krylov_residuals_sql(K_HISTORY, C_CW, SEED, Q_ITERS, RESID_EST_DIGITS),
        "gen_matrix": O.gen_matrix_sql(4, SEED, GEN_DIGITS),
        "stream_sketch_cw": O.with_(O.EV, O.sketch("sk", "ev", 2, "cw", 100, 1, SEED))
        + f"SELECT trial, bucket, {O.rnd('v0', 6)} AS v0, {O.rnd('v1', 4)} AS v1, {O.rnd('v2', 4)} AS v2 FROM sk",
    }
    q["read_optimum"] = q["exact_solution"]
    q["sketch_cw_array"] = O.with_(O.EMB, O.array_sketch("sk", "emb", 64, "cw", 100, SEED)) + \
        f"SELECT trial, bucket, pos, {O.rnd('val', 8)} AS val FROM sk"
    q["sketch_gaussian_array"] = O.with_(O.EMB, O.array_sketch("sk", "emb", 64, "gaussian", C_DENSE, SEED)) + \
        f"SELECT trial, bucket, pos, {O.rnd('val', 8)} AS val FROM sk"
    dot = " + ".join(f"{v!r} * a[{i + 1}]" for i, v in enumerate(ARRAY_V))
    q["matvec_array"] = O.with_(O.EMB) + f"SELECT key, {O.rnd(dot, 8)} AS av FROM emb"
    for kind in KINDS:
        q[f"sketch_{kind}"] = O.with_(O.OM, O.sketch("sk", "om", 3, kind, kind_c(kind), 1, SEED)) + _sketch_sel("sk")
        q[f"ls_low_{kind}"] = _low_x(kind)
        q[f"ls_low_sampling_{kind}"] = _low_sampling_x(kind)
        q[f"ls_high_{kind}"] = _exact_x()
    return q
