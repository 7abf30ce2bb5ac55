import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001, to_numpy
from tallsketch.operators import shape as M
from tallsketch.session import scratch_path
from tallsketch.sources import matrix as S


def test_orders_matrix_matches_pandas(spark):
    mf = S.orders_matrix(spark, SF001)
    keys, A, b = to_numpy(mf)
    orders = spark.read.parquet(f"{SF001}/orders.parquet").toPandas().set_index("o_orderkey").sort_index()
    li = spark.read.parquet(f"{SF001}/lineitem.parquet").toPandas().groupby("l_orderkey")
    n_items = li.size().reindex(orders.index).fillna(0).to_numpy()
    qty = li["l_quantity"].sum().reindex(orders.index).fillna(0).to_numpy()
    assert np.array_equal(keys, orders.index.to_numpy())
    assert np.allclose(A[:, 1], n_items) and np.allclose(A[:, 2], qty) and np.all(A[:, 0] == 1)
    assert np.allclose(b, orders["o_totalprice"].to_numpy())


def test_dims_and_array_layout(spark):
    mf = S.embeddings_matrix(spark, SF001, n=None)
    assert mf.n == 64 and mf.layout == "array"
    assert M.dims(mf) == (500, 64)


def test_ragged_array_rows_raise_or_drop(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1.0), (2, [1.0], 2.0), (3, [1.0, None], 0.5)], "k long, v array<double>, y double")
    mf = S.from_array(df, "k", "v", "y", n=2)
    with pytest.raises(Exception):
        mf.df.collect()
    kept = S.from_array(df, "k", "v", "y", n=2, mode="drop").df.collect()
    assert [r["key"] for r in kept] == [1]


def test_text_parsing_blanks_scientific_and_bad_tokens(spark):
    path = scratch_path(spark, "txt")
    spark.createDataFrame([("1e-8  -2.5E+01 3",), ("  4 5\t6 ",), ("1.0 x 3.0",)], "value string").coalesce(1).write.text(path)
    with pytest.raises(Exception):
        S.read_text_matrix(spark, path).df.collect()
    mf = S.read_text_matrix(spark, path, mode="drop")
    rows = sorted((r["a0"], r["a1"], r["b"]) for r in mf.df.collect())
    assert rows == [(1e-8, -25.0, 3.0), (4.0, 5.0, 6.0)]
    keys = sorted(r["key"] for r in mf.df.collect())
    assert keys == [0, 1]


def test_text_roundtrip_exact(spark):
    mf = S.orders_matrix(spark, SF001)
    path = scratch_path(spark, "omtxt")
    S.write_text_matrix(mf, path)
    back = S.read_text_matrix(spark, path, key="first")
    _, A1, b1 = to_numpy(mf)
    _, A2, b2 = to_numpy(back)
    assert np.array_equal(A1, A2) and np.array_equal(b1, b2)


def test_read_vector_text(spark):
    path = scratch_path(spark, "vec")
    spark.createDataFrame([(str(float(i) / 3),) for i in range(10)], "value string").coalesce(1).write.text(path)
    assert S.read_vector_text(spark, path) == [float(str(float(i) / 3)) for i in range(10)]


def test_stack_all_and_dense(spark):
    mf = S.events_dense_matrix(spark, SF001)
    _, A, b = to_numpy(mf)
    nnz = (A != 0).sum(1) + (b != 0)
    st = M.stack(mf, 3, "dense")
    assert st.df.count() == int(np.sum(np.where(nnz > 2, 3, 1)))
    assert M.stack(mf, 3, "all").df.count() == 3 * len(b)
    assert st.df.select("key").distinct().count() == st.df.count()
    with pytest.raises(ValueError):
        M.stack(mf, 3, "other")


def test_row_index_equals_row_number(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet").select("event_id", "value")
    for parts in (1, 3, 7):
        got = {r["event_id"]: r["idx"] for r in M.row_index(ev, ["value", "event_id"], "idx", partitions=parts).collect()}
        pdf = ev.toPandas().sort_values(["value", "event_id"]).reset_index(drop=True)
        assert got == {int(e): i for i, e in enumerate(pdf["event_id"])}


def test_contiguous_keys_reindexes(spark):
    df = spark.createDataFrame([(k * 10 + 3, float(k), float(k)) for k in range(20)], "k long, x double, y double")
    mf, m = M.contiguous_keys(S.from_columns(df, "k", ["x"], "y"))
    assert m == 20 and sorted(r["key"] for r in mf.df.collect()) == list(range(20))


def test_uniform_sample_scales_by_inverse_p(spark):
    mf = S.events_matrix(spark, SF001)
    smp = M.uniform_sample(mf, 100, 42)
    p = smp.meta["p"]
    orig = {r["key"]: r["b"] for r in mf.df.collect()}
    for r in smp.df.collect():
        assert abs(r["b"] - orig[r["key"]] / p) < 1e-9
    assert 50 < smp.df.count() < 160


def test_text_width_is_checked_and_partitions_keep_line_keys(spark):
    path = scratch_path(spark, "txtw")
    spark.createDataFrame([("1 2 3",), ("4 5 6",), ("7 8",), ("9 10 11",)], "value string").coalesce(1).write.text(path)
    with pytest.raises(Exception):
        S.read_text_matrix(spark, path, n=2).df.collect()
    mf = S.read_text_matrix(spark, path, n=2, mode="drop", partitions=3)
    got = sorted((r["key"], r["a0"]) for r in mf.df.collect())
    assert got == [(0, 1.0), (1, 4.0), (3, 9.0)]


def test_text_position_keys_are_unique_and_stable(spark):
    mf = S.orders_matrix(spark, SF001)
    path = scratch_path(spark, "txtpos")
    S.write_text_matrix(mf, path, with_key=False)
    a = S.read_text_matrix(spark, path, key="position")
    b = S.read_text_matrix(spark, path, key="position")
    ra = sorted((r["key"], r["b"]) for r in a.df.collect())
    assert ra == sorted((r["key"], r["b"]) for r in b.df.collect())
    assert len({k for k, _ in ra}) == len(ra) == mf.df.count()
    with pytest.raises(ValueError):
        S.read_text_matrix(spark, path, key="random")


def test_dense_stacking_counts_nonzeros_of_b(spark):
    rows = [(1, 0.0, 1.0, 5.0), (2, 2.0, 1.0, 0.0), (3, 2.0, 1.0, 5.0), (4, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k long, x double, z double, y double")
    st = M.stack(S.from_columns(df, "k", ["x", "z"], "y"), 3, "dense")
    reps = {}
    for r in st.df.collect():
        reps[r["key"] // 3] = reps.get(r["key"] // 3, 0) + 1
    assert reps == {1: 1, 2: 1, 3: 3, 4: 1}  # only the row with three non-zeros in [A b] repeats


def test_line_keys_follow_files_and_lines_under_any_split_size(spark):
    folder = scratch_path(spark, "lines")
    at = 0
    for k, count in enumerate([5, 4000, 300]):  # unequal files: tasks pack splits by length
        part = spark.range(at, at + count, 1, 1).selectExpr("concat(id, ' 1 ', id * 2) as value")
        part.write.mode("append").text(f"{folder}/part={k}")
        at += count
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            mf = S.read_text_matrix(spark, folder + "/part=*", key="line")
            assert mf.df.count() == at
            assert mf.df.where("key <> a0 or b <> 2 * a0").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_keys_write_no_rows_and_notice_other_splits(spark):
    """Line numbers under any split configuration; a scan whose splits changed after the count raises."""
    path = scratch_path(spark, "txtl")
    df = spark.range(4000).selectExpr("concat(id, '.5 ', id % 7, ' ', id * 3, if(id % 100 = 0, '\\n\\n', '')) AS value")
    df.repartitionByRange(5, F.expr("cast(split(value, '[.]')[0] as int)")).sortWithinPartitions(
        F.expr("cast(split(value, '[.]')[0] as int)")).write.text(path)
    name, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        frames = []
        for size in ("900", "7000", before):
            spark.conf.set(name, size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            mf = S.read_text_matrix(spark, path)
            assert "FileScan text" in mf.df._jdf.queryExecution().toString()
            rows = sorted((r["key"], r["a0"]) for r in mf.df.collect())
            assert rows == [(k, k + 0.5) for k in range(4000)]
            frames.append(mf)
        spark.conf.set(name, "900")
        with pytest.raises(Exception, match="read them again"):
            frames[1].with_df(frames[1].df.select("*")).df.collect()
    finally:
        spark.conf.set(name, before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
