import duckdb
import numpy as np
from pyspark.sql import functions as F

from tallsketch.functions import hashing as H

KEYS = [0, 1, 2, 7, 12345, H.P - 1, H.P, H.P + 1, 2**31, 2**40 + 3, 2**62 + 11, -1, -2, -H.P, -(2**40)]


def spark_values(spark, sql_of_key):
    df = spark.createDataFrame([(k,) for k in KEYS], "key bigint")
    return [r[0] for r in df.select(F.expr(sql_of_key("spark"))).collect()]


def duck_values(sql_of_key):
    con = duckdb.connect()
    vals = ", ".join(f"({k}::BIGINT)" for k in KEYS)
    return [r[0] for r in con.execute(f"SELECT {sql_of_key('duckdb')} FROM (VALUES {vals}) t(key)").fetchall()]


def test_key_hash_same_in_spark_numpy_duckdb(spark):
    h = H.poly(42, "test", 3)
    sq = lambda d: H.sql_hash_key("key", h, d)
    npv = list(H.np_hash_key(np.array(KEYS, dtype=np.int64), h))
    assert spark_values(spark, sq) == npv == duck_values(sq)
    assert all(0 <= v < H.P for v in npv)


def test_fold_keeps_small_keys_and_separates_large_ones():
    h = H.poly(1, "fold")
    small = np.arange(1000, dtype=np.int64)
    assert np.array_equal(H.np_fold_key(small, h), small)
    # keys P apart must not collide systematically
    assert H.np_fold_key(np.array([5]), h)[0] != H.np_fold_key(np.array([5 + H.P]), h)[0]


def test_dense_entries_same_in_spark_numpy_duckdb(spark):
    keys = np.array([0, 5, 99, 2**33 + 1], dtype=np.int64)
    c = 7
    g = H.np_gaussian_block(keys, c, 42, 1)
    r = H.np_rademacher_block(keys, c, 42, 1)
    df = spark.createDataFrame([(int(k), j) for k in keys for j in range(c)], "key bigint, bucket int")
    rows = df.select("key", "bucket", F.expr(H.sql_gaussian("key", "bucket", 42, 1, "spark")).alias("z"),
                     F.expr(H.sql_rademacher("key", "bucket", 42, 1, "spark")).alias("s")).collect()
    con = duckdb.connect()
    vals = ", ".join(f"({int(k)}::BIGINT, {j})" for k in keys for j in range(c))
    drows = con.execute(f"SELECT key, bucket, {H.sql_gaussian('key', 'bucket', 42, 1, 'duckdb')}, "
                        f"{H.sql_rademacher('key', 'bucket', 42, 1, 'duckdb')} FROM (VALUES {vals}) t(key, bucket)").fetchall()
    pos = {int(k): i for i, k in enumerate(keys)}
    for row, d in zip(sorted(rows), sorted(drows)):
        i, j = pos[row["key"]], row["bucket"]
        assert abs(row["z"] - g[j, i]) < 1e-12 and abs(d[2] - g[j, i]) < 1e-12
        assert row["s"] == r[j, i] == d[3]


def test_normal_and_sign_statistics():
    keys = np.arange(20000, dtype=np.int64)
    z = H.np_gaussian_block(keys, 20, 7, 0)
    assert abs(z.mean()) < 4 / np.sqrt(z.size)
    assert abs(z.var() - 1) < 0.02
    # cos/sin halves are uncorrelated
    assert abs(np.corrcoef(z[0], z[1])[0, 1]) < 0.03
    s = H.np_rademacher_block(keys, 40, 7, 0)
    assert abs(s.mean()) < 4 / np.sqrt(s.size)
    assert abs(np.corrcoef(s[0], s[1])[0, 1]) < 0.03


def test_srdht_frequencies_spark_equals_numpy(spark):
    assert H.srdht_frequencies(spark, 1000, 30, 42, 2) == H.np_srdht_frequencies(1000, 30, 42, 2)
    f = H.np_srdht_frequencies(1000, 30, 42, 2)
    assert len(set(f)) == 30 and all(0 <= x < 1000 for x in f)


def test_coins_have_62_bits(spark):
    h = H.poly(42, "coin")
    npv = H.np_key_coin(np.array(KEYS, dtype=np.int64), h)
    assert spark_values(spark, lambda d: H.sql_key_coin("key", h, d)) == list(npv)
    assert duck_values(lambda d: H.sql_key_coin("key", h, d)) == list(npv)
    df = H.spark_with_coin(spark.createDataFrame([(k,) for k in KEYS], "key bigint"), "key", h, "u")
    assert [r["u"] for r in df.collect()] == list(npv)
    # rows of one high hash value toss different coins, so a probability below 2^-31 does not
    # take all of them or none
    high, low = H.P // 3, np.arange(0, H.P, H.P // 1000, dtype=np.int64)
    coins = (high + H.np_uniform(low)) / float(H.P)
    assert len(np.unique(coins)) == len(low) and coins.max() - coins.min() < 1 / H.P


def test_rows_that_share_one_hash_have_different_sketch_columns(monkeypatch):
    hr, _, _, _ = H.dense_polys(3, 0)
    keys = np.arange(50, dtype=np.int64)
    plain = H.np_hash_key
    monkeypatch.setattr(H, "np_hash_key", lambda k, h: np.full(len(k), 7) if h == hr else plain(k, h))
    assert len(np.unique(H.np_gaussian_block(keys, 8, 3, 0).T, axis=0)) == 50
    assert len(np.unique(H.np_rademacher_block(keys, 64, 3, 0).T, axis=0)) == 50
