import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001, to_numpy
from tallsketch.plans.solve import JobParams, compute_factors, run_job, solve
from tallsketch.session import scratch_path
from tallsketch.sources import matrix as S
from tallsketch.sources import sinks


@pytest.mark.parametrize("kw", [
    dict(precision="mid", sketch="projection", c=10),
    dict(precision="low", sketch=None),
    dict(precision="low", sketch="sampling", c=10),
    dict(precision="high", sketch="projection", c=10),
    dict(precision="low", sketch="projection"),
    dict(precision="low", sketch="projection", kind="fft", c=10),
    dict(precision="low", sketch="projection", c=10, trials=0),
])
def test_job_validation_fails_before_any_job(kw):
    with pytest.raises(ValueError):
        JobParams(**kw).validate()


def test_rows_fewer_than_columns_rejected():
    with pytest.raises(ValueError):
        JobParams(precision="low", sketch="projection", c=10).validate(m=2, n=3)


def test_run_job_from_text_with_stacking_and_evaluation(spark):
    mf = S.orders_matrix(spark, SF001)
    path = scratch_path(spark, "job-in")
    S.write_text_matrix(mf, path)
    out = scratch_path(spark, "job-out")
    p = JobParams(precision="high", sketch="projection", kind="cw", c=100, iters=6, trials=2, repeat=2, stack="all",
                  evaluate=True, output_uri=out, expect_dims=None)
    mf_text = S.read_text_matrix(spark, path, key="first")
    res = run_job(spark, mf_text, p)
    errs = res.errors.where(F.col("iter") == 5).collect()
    assert len(errs) == 2 and all(e["x_relerr"] < 1e-6 for e in errs)
    back = sinks.read_solutions(spark, out)
    assert back.count() == 12
    assert spark.read.parquet(f"{out}/history").count() == 12


def test_factor_cache_reuse_and_staleness(spark):
    mf = S.orders_matrix(spark, SF001)
    cache = scratch_path(spark, "fc")
    p = JobParams(precision="high", sketch="projection", kind="cw", c=100, iters=1, factor_cache=cache)
    t1, t2, t3 = {}, {}, {}
    a = compute_factors(mf, p, t1)
    b = compute_factors(mf, p, t2)
    assert "factor_cache_hit" in t2 and all(np.array_equal(a[k], b[k]) for k in a)
    p.seed = 7
    compute_factors(mf, p, t3)
    assert "factor_cache_hit" not in t3
    smaller = mf.with_df(mf.df.where("key < 1000"))
    t4 = {}
    compute_factors(smaller, JobParams(precision="high", sketch="projection", kind="cw", c=100, iters=1, factor_cache=cache), t4)
    assert "factor_cache_hit" not in t4


def test_solutions_written_as_json(spark):
    mf = S.orders_matrix(spark, SF001)
    res = solve(mf, JobParams(precision="low", sketch="projection", kind="cw", c=100))
    out = scratch_path(spark, "json")
    sinks.write_result(res, out, fmt="json")
    assert spark.read.json(f"{out}/solutions").count() == 1


def test_head_is_ordered_top_k(spark):
    mf = S.orders_matrix(spark, SF001)
    assert [r["key"] for r in sinks.head(mf, 5).collect()] == [0, 1, 2, 3, 4]


def test_generator_structure(spark):
    from tallsketch.operators.generate import gen_matrix

    keys = spark.range(1000).withColumnRenamed("id", "k")
    mf = gen_matrix(keys, "k", 6, seed=3)
    _, A, b = to_numpy(mf)
    assert np.array_equal(A[-3:], np.hstack([np.zeros((3, 3)), np.eye(3)]))
    assert np.abs(A[:-3, 3:]).max() < 1e-6 and np.abs(A[:-3, :3]).std() > 20
    ax = A @ np.array(mf.meta["x_true"])
    assert np.isclose(np.linalg.norm(b - ax), 0.25 * np.linalg.norm(ax))


def test_streaming_sketch_equals_batch(spark):
    from tallsketch.operators.sketch import sketch
    from tallsketch.streaming.sketch_stream import parquet_stream, run_to_table, stream_rows, streaming_cw_sketch

    rows = stream_rows(parquet_stream(spark, SF001, "events"), "event_id", [F.lit(1.0), "user_id"], "value")
    got = run_to_table(spark, streaming_cw_sketch(rows, 2, 30, 2, 5), "stream_test_sketch")
    batch = sketch(S.events_matrix(spark, SF001), "cw", 30, 2, 5).df
    a = sorted(tuple(round(v, 6) for v in r) for r in got.collect())
    b = sorted(tuple(round(v, 6) for v in r) for r in batch.collect())
    assert a == b


def test_generator_wide_and_array_paths_agree(spark):
    from tallsketch.operators.generate import _gen_array, gen_matrix

    keys = spark.range(300).withColumnRenamed("id", "k")
    wide = gen_matrix(keys, "k", 6, seed=4)
    special = sorted(r["key"] for r in wide.df.orderBy(F.col("key").desc()).limit(3).collect())
    arr = _gen_array(keys.select(F.col("k").alias("key")), special, 6, 4)
    _, A1, b1 = to_numpy(wide)
    _, A2, b2 = to_numpy(arr)
    assert np.allclose(A1, A2, rtol=1e-12, atol=1e-20) and np.allclose(b1, b2, rtol=1e-9)


def test_cli_job_end_to_end(spark):
    from tallsketch.plans import cli

    mf = S.orders_matrix(spark, SF001)
    _, A, b = to_numpy(mf)
    x = np.linalg.lstsq(A, b, rcond=None)[0]
    data = scratch_path(spark, "cli-data")
    S.write_text_matrix(mf, data, with_key=False)
    xo, fo = scratch_path(spark, "xopt"), scratch_path(spark, "fopt")
    spark.createDataFrame([(repr(float(v)),) for v in x], "value string").coalesce(1).write.text(xo)
    spark.createDataFrame([(repr(float(np.linalg.norm(A @ x - b))),)], "value string").coalesce(1).write.text(fo)
    out = scratch_path(spark, "cli-out")
    summary = cli.main([data, "--dims", str(len(b)), "3", "--high_precision", "--projection", "-p", "cw", "-r", "100",
                        "-q", "8", "-k", "2", "-t", "--x-opt", xo, "--f-opt", fo, "--output", out], spark=spark)
    finals = [r for r in summary["median_errors"] if r["iter"] == 7]
    assert finals and finals[0]["x_relerr"] < 1e-6
    assert spark.read.parquet(f"{out}/solutions").count() == 16
    with pytest.raises(ValueError):
        cli.main([data, "--dims", "2", "3", "--low-precision", "--projection", "-r", "10"], spark=spark)


def test_sampling_factor_reuses_cached_projection_factor(spark):
    mf = S.orders_matrix(spark, SF001)
    cache = scratch_path(spark, "fc2")
    p = JobParams(precision="high", sketch="sampling", kind="cw", c=100, s=300, iters=1, factor_cache=cache)
    t1, t2 = {}, {}
    compute_factors(mf, p, t1)
    assert "factor_cache_hit" not in t1 and "projection" in t1
    p.s = 400  # another sampling size: the projection factor is reused from the cache
    compute_factors(mf, p, t2)
    assert "factor_cache_hit" in t2 and "projection" not in t2 and "sampling" in t2


def test_projection_smaller_than_columns_is_rejected_before_any_job(spark):
    mf = S.embeddings_matrix(spark, SF001)  # n = 64
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    before = jobs()
    with pytest.raises(ValueError):
        solve(mf, JobParams(precision="low", sketch="projection", kind="cw", c=32))
    with pytest.raises(ValueError):
        compute_factors(mf, JobParams(precision="high", sketch="projection", kind="gaussian", c=10, iters=3), {})
    assert jobs() == before


def test_storage_level_option(spark):
    mf = S.orders_matrix(spark, SF001)
    res = solve(mf, JobParams(precision="high", sketch="projection", kind="cw", c=100, iters=3, storage="DISK_ONLY"))
    assert res.solutions.count() == 3
    with pytest.raises(ValueError):
        JobParams(precision="low", sketch="projection", c=10, storage="FLOPPY").validate()


def test_cli_parquet_input(spark):
    from tallsketch.plans import cli

    summary = cli.main([f"{SF001}/orders.parquet", "--parquet", "--key", "o_orderkey", "--features", "o_custkey",
                        "--target", "o_totalprice", "--low-precision", "--projection", "-p", "cw", "-r", "50",
                        "-k", "2", "-t"], spark=spark)
    med = summary["median_errors"][0]
    assert 0 <= med["f_relerr_median"] < 0.5 and "solve" in summary["timings"]
    with pytest.raises(ValueError):
        cli.main([f"{SF001}/orders.parquet", "--parquet", "--low-precision", "--projection", "-r", "10"], spark=spark)


def test_stream_reads_a_folder_in_several_batches(spark, tmp_path):
    from tallsketch.streaming.sketch_stream import parquet_stream, run_to_table

    df = spark.range(200).withColumnRenamed("id", "k")
    df.repartition(4).write.parquet(str(tmp_path / "numbers.parquet"))
    agg = parquet_stream(spark, str(tmp_path), "numbers").groupBy().sum("k")
    assert run_to_table(spark, agg, "folder_sum").first()[0] == sum(range(200))


def _cached(spark, mf, cache, **kw):
    p = JobParams(**{**dict(precision="high", sketch="projection", kind="cw", c=60, iters=1, factor_cache=cache), **kw})
    return {r["stage"] for r in solve(mf, p).metrics.collect()}


def test_factor_cache_tells_sources_apart(spark):
    cache, one, two = (scratch_path(spark, n) for n in ("fc", "fc-one", "fc-two"))
    base = spark.range(500).selectExpr("id AS key", "CAST(id % 7 AS DOUBLE) AS x", "CAST(id % 11 AS DOUBLE) AS y")
    base.write.parquet(one)
    base.withColumn("x", F.col("x") * 3).write.parquet(two)
    read = lambda path: S.from_columns(spark.read.parquet(path), "key", [F.lit(1.0), "x"], "y")
    assert "factor_cache_hit" not in _cached(spark, read(one), cache)
    assert "factor_cache_hit" not in _cached(spark, read(two), cache)
    assert "factor_cache_hit" in _cached(spark, read(one), cache)
    assert "factor_cache_hit" in _cached(spark, read(one), cache, persist=False)
    # rows without a known origin are never taken for others
    for scale in (1.0, 2.0):
        rows = spark.createDataFrame([(i, float(i % 5) * scale, float(i % 3)) for i in range(200)], "key long, x double, y double")
        assert "factor_cache_hit" not in _cached(spark, S.from_columns(rows, "key", [F.lit(1.0), "x"], "y"), cache)


def test_factor_cache_of_a_rewritten_text_file_and_of_low_precision(spark):
    cache, path = scratch_path(spark, "fc"), scratch_path(spark, "fc-text")
    lines = lambda k: spark.range(300).selectExpr(f"concat_ws(' ', '1', CAST(id % {k} AS STRING), CAST(id % 5 AS STRING)) AS value")
    lines(7).write.text(path)
    assert "factor_cache_hit" not in _cached(spark, S.read_text_matrix(spark, path), cache, precision="low", iters=None)
    assert "factor_cache_hit" in _cached(spark, S.read_text_matrix(spark, path), cache)
    lines(9).write.mode("overwrite").text(path)
    assert "factor_cache_hit" not in _cached(spark, S.read_text_matrix(spark, path), cache)


def test_streamed_parts_change_the_sketch_of_their_row(spark, tmp_path):
    """Items before, with and after their order, an item without one, null keys, repeated items: after
    every micro-batch the sketch is that of the rows so far, and a batch reads its own rows only."""
    from tallsketch.operators.sketch import sketch
    from tallsketch.sources.matrix import MatrixFrame
    from tallsketch.streaming.sketch_stream import folder_stream, latest, maintain_sketch, row_changes

    orders = [[(k, 10.0 * k) for k in part] for part in (range(0, 12), range(12, 20), [(20)])] + [[(None, 5.0)]]
    items = [[(k % 25, 1.0 + k) for k in range(30)], [(3, 2.0), (3, 2.0), (19, 4.0), (None, 9.0), (99, 1.0)], [(0, 7.0)], [(20, 1.5)]]
    for name, batches, schema in (("o", orders, "o long, price double"), ("i", items, "l long, qty double")):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            time.sleep(1.1)  # files are streamed by modification time
    changes = row_changes(folder_stream(spark, str(tmp_path / "o")).filter("o is not null"), "o", [F.lit(1.0), F.lit(0.0), F.lit(0.0), "price"],
                          folder_stream(spark, str(tmp_path / "i")), "l", [F.lit(0.0), F.lit(1.0), "qty", F.lit(0.0)])
    out = str(tmp_path / "out")
    query = maintain_sketch(changes, 3, 16, out, k=2, seed=4)
    assert sum(p["numInputRows"] for p in query.recentProgress) <= 2 * 22 + 37
    seen = {}
    for epoch in range(4):
        o = [r for part in orders[:epoch + 1] for r in part if r[0] is not None]
        i = [r for part in items[:epoch + 1] for r in part]
        rows = [(k, 1.0, float(sum(x[0] == k for x in i)), float(sum(x[1] for x in i if x[0] == k)), p) for k, p in o]
        mf = MatrixFrame(spark.createDataFrame(rows, "key long, a0 double, a1 double, a2 double, b double"), 3)
        want = {(r["trial"], r["bucket"]): np.array(r[2:]) for r in sketch(mf, "cw", 16, 2, 4).df.collect()}
        got = {(r["trial"], r["bucket"]): np.array(r[2:]) for r in
               spark.read.parquet(f"{out}/sketch/epoch={epoch}").select("trial", "bucket", "v0", "v1", "v2", "v3").collect()}
        assert want.keys() <= got.keys() and all(np.allclose(got[k], want.get(k, 0.0), atol=1e-9) for k in got)
        seen[epoch] = got
    assert any(not np.allclose(seen[2][k], seen[1][k]) for k in seen[1])  # the late item of order 0
    assert latest(spark, f"{out}/solutions").count() == 2
    with pytest.raises(ValueError):
        row_changes(spark.range(1), "id", ["id"], spark.range(1), "id", ["id", "id"])


def test_parts_of_a_row_are_kept_as_one_sum(spark, tmp_path):
    """Keyed state holds no parts: a key has one row a micro-batch, however many parts wait for it; rows
    that come twice get every part twice, and null parts add nothing."""
    from tallsketch.streaming.sketch_stream import folder_stream, latest, maintain_sketch, row_changes

    batches = {"o": [[(9, 1.0)], [(1, 5.0), (1, 5.0)], [(2, None)]],
               "i": [[(1, 2.0)] * 300 + [(1, None), (2, 4.0)], [(1, 1.0), (7, 3.0)], [(1, 1.0), (2, None), (None, 8.0)]]}
    for name, schema in (("o", "o long, price double"), ("i", "l long, qty double")):
        for rows in batches[name]:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            time.sleep(1.1)  # files are streamed by modification time
    changes = row_changes(folder_stream(spark, str(tmp_path / "o")), "o", [F.lit(1.0), F.lit(0.0), "price"],
                          folder_stream(spark, str(tmp_path / "i")), "l", [F.lit(0.0), "qty", F.lit(0.0)])
    out = str(tmp_path / "out")
    query = maintain_sketch(changes, 2, 1, out, k=1, seed=4, solve=False)
    assert all(o["numRowsTotal"] == 0 for p in query.recentProgress for o in p["stateOperators"])
    log = spark.read.parquet(f"{out}/log")
    assert log.groupBy("epoch", "key").count().agg(F.max("count")).first()[0] == 1
    from tallsketch.functions import hashing as H
    sign = {key: float(H.np_sign(H.np_hash_key(np.array([key]), H.cw_polys(4, 0)[1]))[0]) for key in (1, 2, 9)}
    got = latest(spark, f"{out}/sketch").select("v0", "v1", "v2").first()
    want = [2 * sign[1] + sign[2] + sign[9], 2 * 602.0 * sign[1] + 4.0 * sign[2], 10.0 * sign[1] + sign[9]]
    assert np.allclose(list(got), want)


def _two_features(spark, shift, broadcast=None):
    """The same file with a feature from a Python function of one name and another body or value."""
    from pyspark.sql.types import DoubleType

    if broadcast is not None:
        feature = F.udf(lambda v: float(v) * broadcast.value, DoubleType())
    else:
        feature = F.udf(lambda v: float(v) * 1.0 + shift, DoubleType())
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    return S.from_columns(ev, "event_id", [F.lit(1.0), feature(F.col("user_id"))], "value", name="udf")


def test_factor_cache_tells_the_code_of_functions_apart(spark):
    cache = scratch_path(spark, "cache-udf")
    assert "factor_cache_hit" not in _cached(spark, _two_features(spark, 0.0), cache)
    assert "factor_cache_hit" not in _cached(spark, _two_features(spark, 7.0), cache)
    assert "factor_cache_hit" in _cached(spark, _two_features(spark, 0.0), cache)
    named = spark.read.parquet(f"{SF001}/events.parquet")
    root = F.udf(np.sqrt, "double")  # a function that is pickled by its name: its module's file counts
    mf = S.from_columns(named.withColumn("u", root(F.col("user_id") + 0.0)), "event_id", [F.lit(1.0), "u"], "value")
    assert len(sinks.plan_code(mf.df) or ["x"]) == 1
    value = spark.sparkContext.broadcast(3.0)
    for _ in range(2):  # the value of a broadcast variable is not in the plan: never cached
        assert "factor_cache_hit" not in _cached(spark, _two_features(spark, 0.0, value), cache)
    assert sinks.plan_code(named.filter("event_id in (select max(id) from range(3))")) == []


def test_factor_cache_modes_and_half_written_sets(spark):
    mf, cache = S.orders_matrix(spark, SF001), scratch_path(spark, "cache-modes")
    params = dict(precision="high", sketch="projection", kind="cw", c=60, iters=1, factor_cache=cache)
    fp = sinks.fingerprint(mf, JobParams(**params), "N")
    t = {}
    compute_factors(mf, JobParams(**params, save=False), t)  # load only: nothing there, nothing written
    assert "factor_cache_hit" not in t and sinks.complete_sets(spark, cache, fp) == []
    spark.range(3).write.parquet(f"{cache}/fp={fp}/set-dead/_temporary/0")  # a save that died
    assert sinks.load_factors(spark, cache, fp) is None
    first = compute_factors(mf, JobParams(**params, reuse=False), {})
    kept = sinks.complete_sets(spark, cache, fp)
    assert len(kept) == 1
    t = {}
    again = compute_factors(mf, JobParams(**params, reuse=False), t)  # save only: not read, and no set is replaced
    assert "factor_cache_hit" not in t and len(sinks.complete_sets(spark, cache, fp)) == 2 and kept[0] in sinks.complete_sets(spark, cache, fp)
    t = {}
    found = compute_factors(mf, JobParams(**params, save=False), t)
    assert "factor_cache_hit" in t and np.allclose(found[0] @ found[0].T, again[0] @ again[0].T) and np.allclose(abs(found[0]), abs(first[0]))
    with pytest.raises(ValueError):
        JobParams(**params, save=False, reuse=False).validate()


def test_cli_factor_flags_and_persist(spark):
    from tallsketch.plans.cli import params_from_args, parser

    base = ["data", "--high_precision", "--projection", "-r", "50", "-q", "3"]
    args = lambda *more: params_from_args(parser().parse_args(base + list(more)))
    assert not args().persist and args("-c").persist
    for flag in ("--load_N", "--save_N"):
        with pytest.raises(ValueError, match="factor-cache"):
            args(flag)
    load, save, both = args("--load_N", "--N-dir", "u"), args("--save_N", "--N-dir", "u"), args("--load_N", "--save_N", "--N-dir", "u")
    assert (load.reuse, load.save) == (True, False) and (save.reuse, save.save) == (False, True) and (both.reuse, both.save) == (True, True)


def test_history_times_count_from_the_first_sketch(spark):
    cache = scratch_path(spark, "cache-time")
    p = JobParams(precision="high", sketch="projection", kind="cw", c=60, iters=2, factor_cache=cache)
    mf = S.orders_matrix(spark, SF001)
    for stage in ("projection", "factor_cache_hit"):
        res = solve(mf, p)
        spent = {r["stage"]: r["elapsed_s"] for r in res.metrics.collect()}
        times = [h["elapsed_s"] for h in res.history.history]
        assert spent[stage] > 0 and times[0] > spent[stage] and times == sorted(times)


def test_job_writes_its_errors(spark):
    path = scratch_path(spark, "job")
    S.write_text_matrix(S.orders_matrix(spark, SF001), f"{path}/in", with_key=False)
    p = JobParams(precision="low", sketch="projection", kind="cw", c=100, trials=3, repeat=2, output_uri=f"{path}/out", evaluate=True)
    run_job(spark, f"{path}/in", p, n=3)
    assert sinks.read_solutions(spark, f"{path}/out").count() == 3
    assert all(0 <= r["x_relerr"] < 1 for r in sinks.read_errors(spark, f"{path}/out").collect())
