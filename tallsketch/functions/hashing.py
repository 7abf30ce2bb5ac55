"""Keyed randomness, identical in Spark SQL, NumPy and DuckDB SQL.

Every random number in the engine is a pure function of (seed, purpose, trial, row key
[, bucket]).  A retried task, a recomputed partition or another partitioning therefore
draws exactly the same sketch, and the numbers can be re-derived in plain SQL.

The family is a cubic polynomial over GF(P), P = 2^31 - 1, evaluated by Horner:

    h(x) = (((c3*x + c2) % P * x + c1) % P * x + c0) % P

which is 4-wise independent for x in [0, P) (what count-sketch and sign sketches need).
Every intermediate product stays below 2^62, so it is exact in BIGINT under ANSI overflow
checks and in NumPy int64.

A 64-bit key is folded into [0, P) as  (pmod(key, P) + pmod(key div P, P) * d) % P  with
a per-purpose multiplier d, so keys beyond 2^31 do not collide systematically; keys in
[0, P) map to themselves.

One hash has 31 bits.  What must stay distinct over more rows than that is drawn from two
independent hashes of the key: a coin is (h(x) + (h'(x) + 1/2) / P) / P, down to about 2^-62,
and the row part of a dense sketch entry is a pair, mixed with the bucket as
(h(x) + h'(x) * g(bucket) + g'(bucket)) mod P, so two rows share a column of the sketch only
if both hashes collide.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

P = 2147483647  # 2^31 - 1


@dataclass(frozen=True)
class Poly:
    """Coefficients of one hash function (c3, c2, c1, c0) plus the key-fold multiplier d."""

    c3: int
    c2: int
    c1: int
    c0: int
    d: int


def poly(seed: int, purpose: str, trial: int = 0) -> Poly:
    """Coefficients derived on the driver from (seed, purpose, trial) with SHA-256."""
    digest = hashlib.sha256(f"{int(seed)}|{purpose}|{int(trial)}".encode()).digest()
    words = [int.from_bytes(digest[4 * i: 4 * i + 4], "big") % P for i in range(5)]
    c3 = words[0] or 1
    d = words[4] or 1
    return Poly(c3, words[1], words[2], words[3], d)


def second(h: Poly) -> Poly:
    """An independent hash function that belongs to ``h`` (its low 31 bits of a 62-bit draw)."""
    return poly(h.c0, f"second|{h.c3}|{h.c2}|{h.c1}|{h.d}")


# ----------------------------------------------------------------------------- SQL text
# One generator for both dialects; Spark evaluates it through F.expr.

def _lit(v: int) -> str:
    return f"CAST({int(v)} AS BIGINT)"


def sql_fold_key(key_sql: str, h: Poly, dialect: str = "spark") -> str:
    """Key folded into [0, P).  ``key_sql`` must be BIGINT-valued."""
    k = f"CAST({key_sql} AS BIGINT)"
    lo = f"((({k} % {_lit(P)}) + {_lit(P)}) % {_lit(P)})"
    div = "div" if dialect == "spark" else "//"
    hi = f"(((({k} {div} {_lit(P)}) % {_lit(P)}) + {_lit(P)}) % {_lit(P)})"
    return f"(({lo} + {hi} * {_lit(h.d)}) % {_lit(P)})"


def sql_cubic(x_sql: str, h: Poly) -> str:
    """h(x) for x already in [0, P)."""
    t = f"(({_lit(h.c3)} * {x_sql} + {_lit(h.c2)}) % {_lit(P)})"
    t = f"(({t} * {x_sql} + {_lit(h.c1)}) % {_lit(P)})"
    return f"(({t} * {x_sql} + {_lit(h.c0)}) % {_lit(P)})"


def sql_hash_key(key_sql: str, h: Poly, dialect: str = "spark") -> str:
    return sql_cubic(sql_fold_key(key_sql, h, dialect), h)


def sql_uniform(h_sql: str) -> str:
    """Uniform in (0, 1) from a hash value."""
    return f"((CAST({h_sql} AS DOUBLE) + 0.5) / {float(P)!r})"


def sql_coin(high_sql: str, low_sql: str) -> str:
    """Uniform in (0, 1) of 62 bits from two independent hash values."""
    return f"((CAST({high_sql} AS DOUBLE) + {sql_uniform(low_sql)}) / {float(P)!r})"


def sql_key_coin(key_sql: str, h: Poly, dialect: str = "spark") -> str:
    return sql_coin(sql_hash_key(key_sql, h, dialect), sql_hash_key(key_sql, second(h), dialect))


def sql_sign(h_sql: str) -> str:
    return f"(CAST(({h_sql} % 2) * 2 - 1 AS DOUBLE))"


def sql_normal(u1_sql: str, u2_sql: str) -> str:
    """Box-Muller: sqrt(-2 ln u1) * cos(2 pi u2)."""
    return f"(sqrt(-2.0 * ln({u1_sql})) * cos(2.0 * pi() * {u2_sql}))"


def spark_expr(sql: str) -> Column:
    return F.expr(sql)


# ----------------------------------------------------------------------------- NumPy
# Same numbers inside Arrow batches.

def np_fold_key(keys: np.ndarray, h: Poly) -> np.ndarray:
    k = np.asarray(keys, dtype=np.int64)
    lo = np.mod(k, P)
    hi = np.where(k >= 0, k // P, -((-k) // P))  # truncating division, as SQL
    hi = np.mod(hi, P)
    return (lo + hi * np.int64(h.d)) % P


def np_cubic(x: np.ndarray, h: Poly) -> np.ndarray:
    x = np.asarray(x, dtype=np.int64)
    t = (np.int64(h.c3) * x + np.int64(h.c2)) % P
    t = (t * x + np.int64(h.c1)) % P
    return (t * x + np.int64(h.c0)) % P


def np_hash_key(keys: np.ndarray, h: Poly) -> np.ndarray:
    return np_cubic(np_fold_key(keys, h), h)


def np_uniform(hv: np.ndarray) -> np.ndarray:
    return (hv.astype(np.float64) + 0.5) / float(P)


def np_key_coin(keys: np.ndarray, h: Poly) -> np.ndarray:
    return (np_hash_key(keys, h).astype(np.float64) + np_uniform(np_hash_key(keys, second(h)))) / float(P)


def np_sign(hv: np.ndarray) -> np.ndarray:
    return ((hv % 2) * 2 - 1).astype(np.float64)


def np_normal(u1: np.ndarray, u2: np.ndarray) -> np.ndarray:
    return np.sqrt(-2.0 * np.log(u1)) * np.cos(2.0 * math.pi * u2)


# ----------------------------------------------------------------------------- named draws
# The purposes used by the operators, in one place so Spark, NumPy and SQL agree.

def cw_polys(seed: int, trial: int) -> tuple[Poly, Poly]:
    return poly(seed, "cw-bucket", trial), poly(seed, "cw-sign", trial)


def dense_polys(seed: int, trial: int) -> tuple[Poly, Poly, Poly, Poly]:
    """(row, column, u1, u2) hashes of a dense sketch entry (row key, bucket)."""
    return (poly(seed, "dense-row", trial), poly(seed, "dense-col", trial),
            poly(seed, "dense-u1", trial), poly(seed, "dense-u2", trial))


def np_dense_base(keys: np.ndarray, slots: int, seed: int, trial: int) -> np.ndarray:
    """(slots, r) matrix of entry hashes base[j, i] from both row hashes of key_i and both
    hashes of slot j."""
    hr, hc, _, _ = dense_polys(seed, trial)
    high, low = np_hash_key(keys, hr), np_hash_key(keys, second(hr))
    j = np.arange(slots, dtype=np.int64)
    s = np_cubic(j, second(hc))[:, None] * low[None, :]  # < 2^62, the sums below stay under 2^63
    s += high[None, :]
    s += np_cubic(j, hc)[:, None]
    s %= P
    return s


def sql_dense_mix(high_sql: str, low_sql: str, slot_sql: str, seed: int, trial: int) -> str:
    _, hc, _, _ = dense_polys(seed, trial)
    return f"(({low_sql} * {sql_cubic(slot_sql, second(hc))} + {high_sql} + {sql_cubic(slot_sql, hc)}) % {_lit(P)})"


def sql_dense_base(key_sql: str, slot_sql: str, seed: int, trial: int, dialect: str) -> str:
    hr, _, _, _ = dense_polys(seed, trial)
    return sql_dense_mix(sql_hash_key(key_sql, hr, dialect), sql_hash_key(key_sql, second(hr), dialect),
                         f"CAST({slot_sql} AS BIGINT)", seed, trial)


def _div(a: str, b: str, dialect: str) -> str:
    return f"({a} div {b})" if dialect == "spark" else f"({a} // {b})"


# Gaussian entries come in pairs: buckets 2p and 2p+1 share one Box-Muller draw (u1, u2)
# and take its cosine and sine halves, two independent normals for one pair of hashes.

def np_gaussian_block(keys: np.ndarray, c: int, seed: int, trial: int) -> np.ndarray:
    pairs = (c + 1) // 2
    base = np_dense_base(keys, pairs, seed, trial)
    _, _, h1, h2 = dense_polys(seed, trial)
    radius = np.sqrt(-2.0 * np.log(np_uniform(np_cubic(base, h1))))
    angle = 2.0 * math.pi * np_uniform(np_cubic(base, h2))
    out = np.empty((2 * pairs, base.shape[1]))
    out[0::2] = radius * np.cos(angle)
    out[1::2] = radius * np.sin(angle)
    return out[:c]


def sql_gaussian(key_sql: str, bucket_sql: str, seed: int, trial: int, dialect: str) -> str:
    pair = _div(f"CAST({bucket_sql} AS BIGINT)", _lit(2), dialect)
    base = sql_dense_base(key_sql, pair, seed, trial, dialect)
    _, _, h1, h2 = dense_polys(seed, trial)
    radius = f"sqrt(-2.0 * ln({sql_uniform(sql_cubic(base, h1))}))"
    angle = f"(2.0 * pi() * {sql_uniform(sql_cubic(base, h2))})"
    return f"({radius} * CASE WHEN {bucket_sql} % 2 = 0 THEN cos({angle}) ELSE sin({angle}) END)"


# Rademacher entries: 16 buckets share one hash and read one bit each.
SIGN_BITS = 16


def np_rademacher_block(keys: np.ndarray, c: int, seed: int, trial: int) -> np.ndarray:
    words = (c + SIGN_BITS - 1) // SIGN_BITS
    base = np_dense_base(keys, words, seed, trial)
    _, _, h1, _ = dense_polys(seed, trial)
    hv = np_cubic(base, h1)
    bits = (hv[:, None, :] >> np.arange(SIGN_BITS, dtype=np.int64)[None, :, None]) & 1
    return (bits.reshape(words * SIGN_BITS, -1)[:c] * 2 - 1).astype(np.float64)


def sql_rademacher(key_sql: str, bucket_sql: str, seed: int, trial: int, dialect: str) -> str:
    word = _div(f"CAST({bucket_sql} AS BIGINT)", _lit(SIGN_BITS), dialect)
    base = sql_dense_base(key_sql, word, seed, trial, dialect)
    _, _, h1, _ = dense_polys(seed, trial)
    bit = f"CAST({bucket_sql} % {SIGN_BITS} AS INTEGER)"
    shifted = f"shiftright({sql_cubic(base, h1)}, {bit})" if dialect == "spark" else f"({sql_cubic(base, h1)} >> {bit})"
    return f"(CAST(({shifted} % 2) * 2 - 1 AS DOUBLE))"


def srdht_sign_poly(seed: int, trial: int) -> Poly:
    return poly(seed, "srdht-sign", trial)


def srdht_freq_poly(seed: int, trial: int) -> Poly:
    return poly(seed, "srdht-freq", trial)


def srdht_frequencies(spark, m: int, c: int, seed: int, trial: int) -> list[int]:
    """c distinct frequencies in [0, m): the c indices with the smallest keyed hash (ties
    by index) -- a uniform draw without replacement that plain SQL can repeat.  Computed
    as a distributed top-c over ``range(m)`` (each task keeps c candidates)."""
    from pyspark.sql import functions as F

    if c > m:
        raise ValueError(f"srdht needs c <= m (c={c}, m={m})")
    h = F.expr(sql_hash_key("id", srdht_freq_poly(seed, trial), "spark"))
    top = spark.range(m).select("id", h.alias("h")).orderBy("h", "id").limit(c).collect()
    return sorted(int(r["id"]) for r in top)


def np_srdht_frequencies(m: int, c: int, seed: int, trial: int) -> list[int]:
    """NumPy version of the same rule (tests, small m)."""
    idx = np.arange(m, dtype=np.int64)
    hv = np_hash_key(idx, srdht_freq_poly(seed, trial))
    order = np.lexsort((idx, hv))[:c]
    return sorted(int(i) for i in idx[order])


def sample_poly(seed: int, purpose: str, trial: int = 0) -> Poly:
    return poly(seed, purpose, trial)


# ----------------------------------------------------------------------------- staged Spark columns
# sql_cubic repeats its argument three times (Horner), so nesting hashes as one expression
# duplicates the key fold many times and can push whole-stage codegen past the JVM method
# size.  On the Spark side every hash input is therefore staged as its own column; Catalyst
# does not collapse a non-trivial projection referenced more than once, so each value is
# computed once per row.  The numbers are identical to the nested SQL text.

def spark_with_hash(df, key_col: str, h: Poly, out: str):
    """df + ``out`` = h(key) (BIGINT in [0, P))."""
    tmp = f"{out}__x"
    return (df.withColumn(tmp, F.expr(sql_fold_key(key_col, h, "spark")))
            .withColumn(out, F.expr(sql_cubic(tmp, h))).drop(tmp))


def spark_with_coin(df, key_col: str, h: Poly, out: str):
    """df + ``out`` = the 62-bit coin of the key (DOUBLE in (0, 1))."""
    high, low = f"{out}__h", f"{out}__l"
    df = spark_with_hash(spark_with_hash(df, key_col, h, high), key_col, second(h), low)
    return df.withColumn(out, F.expr(sql_coin(high, low))).drop(high, low)


def spark_with_row_hash(df, key_col: str, seed: int, trial: int, out: str):
    """Row part of a dense entry hash, ``out`` and ``out``_low (compute it before rows meet buckets)."""
    hr, _, _, _ = dense_polys(seed, trial)
    return spark_with_hash(spark_with_hash(df, key_col, hr, out), key_col, second(hr), f"{out}_low")


def spark_with_dense_entry(df, row_hash_col: str, bucket_sql: str, kind: str, seed: int, trial: int, out: str):
    """df + ``out`` = Gaussian or Rademacher entry for (row, bucket), from the staged row hash."""
    _, _, h1, h2 = dense_polys(seed, trial)
    per = 2 if kind == "gaussian" else SIGN_BITS
    slot = _div(f"CAST({bucket_sql} AS BIGINT)", _lit(per), "spark")
    base = f"{out}__base"
    df = df.withColumn(base, F.expr(sql_dense_mix(row_hash_col, f"{row_hash_col}_low", slot, seed, trial)))
    if kind == "gaussian":
        r, a = f"{out}__r", f"{out}__a"
        df = (df.withColumn(r, F.expr(f"sqrt(-2.0 * ln({sql_uniform(sql_cubic(base, h1))}))"))
              .withColumn(a, F.expr(f"(2.0 * pi() * {sql_uniform(sql_cubic(base, h2))})")))
        df = df.withColumn(out, F.expr(f"({r} * CASE WHEN {bucket_sql} % 2 = 0 THEN cos({a}) ELSE sin({a}) END)"))
        return df.drop(base, r, a)
    g = f"{out}__g"
    df = df.withColumn(g, F.expr(sql_cubic(base, h1)))
    bit = f"CAST({bucket_sql} % {SIGN_BITS} AS INTEGER)"
    df = df.withColumn(out, F.expr(f"(CAST((shiftright({g}, {bit}) % 2) * 2 - 1 AS DOUBLE))"))
    return df.drop(base, g)
