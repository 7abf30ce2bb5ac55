"""Optimal length buckets: boundaries that minimise padding, then batches within a token budget.

The histogram holds one entry per distinct length over all rows; distinct lengths are at most the
root of twice the corpus' tokens.  Dynamic programming picks at most ``buckets`` boundaries among
them so that the padding, the sum of boundary minus length over all rows, is the least.  The costs
of a row of the table are the lower envelope of lines, so a bucket takes linear time.  Rows of a bucket are numbered in a fixed
pseudo-random order and cut into batches of as many rows as the padded budget holds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallsketch.llm.common import number_rows, stored, table

BUCKETS = 16
#: Padded tokens of a batch; a longer row is a batch by itself.
BUDGET = 65_536


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The boundaries (ascending, the last is the largest length) of least total padding.

    ``lengths`` are distinct and ascending, each standing for ``counts`` rows."""
    m = len(lengths)
    if not m:
        return []
    size, rows = [int(x) for x in lengths], [int(x) for x in np.cumsum(counts)]
    # padding of a bucket of lengths i+1..j: size[j] * (rows[j] - rows[i]) - tokens; the tokens are constant
    best = [s * r for s, r in zip(size, rows)]
    choice = []
    for _ in range(min(buckets, m) - 1):
        new, at, first = list(best), [0] * m, 0
        lines: list[int] = []  # the ends i on the lower envelope of best[i] - x * rows[i], from x = size[j] on
        for j in range(1, m):
            c = j - 1
            while len(lines) > 1:
                a, b = lines[-2], lines[-1]
                if (best[c] - best[a]) * (rows[b] - rows[a]) > (best[b] - best[a]) * (rows[c] - rows[a]):
                    break
                lines.pop()
            lines.append(c)
            first, x = min(first, len(lines) - 1), size[j]
            while first + 1 < len(lines) and best[lines[first + 1]] - x * rows[lines[first + 1]] < best[lines[first]] - x * rows[lines[first]]:
                first += 1
            cost = best[lines[first]] + x * (rows[j] - rows[lines[first]])
            if cost < new[j]:
                new[j], at[j] = cost, lines[first] + 1
        choice.append(at)
        best = new
    out, j = [], m - 1
    for at in [*reversed(choice), None]:
        out.append(int(lengths[j]))
        if at is None or not at[j]:
            if at is None:
                break
            out.pop()  # this many buckets do not help here: the same end with one bucket less
            continue
        j = at[j] - 1
    return sorted(out)


def words(text: Column) -> Column:
    """Number of words, runs of characters outside [\\x20\\x09-\\x0D]; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pack(df: DataFrame, key: str, length: Column, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(key, n_tokens, bucket, bucket_length, batch, slot) per row of ``df``.

    ``batch`` is numbered from 0 in its bucket, ``slot`` from 0 in its batch.  Lengths of 0 (null
    and empty texts) go to the first bucket; no row is cut or dropped; a row longer than the
    budget is a batch of its own.  Null and repeated keys get slots of their own; empty input
    gives no rows."""
    rows = stored(df.select(F.col(key).alias("key"), length.alias("n_tokens")), "pack-lengths")
    hist = sorted(rows.groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect())
    ends = boundaries(np.array([r["length"] for r in hist]), np.array([r["n"] for r in hist]), buckets)
    bucket = F.lit(max(0, len(ends) - 1))
    for b in reversed(range(len(ends) - 1)):
        bucket = F.when(F.col("n_tokens") <= ends[b], F.lit(b)).otherwise(bucket)
    placed = number_rows(rows.withColumn("bucket", bucket), ["bucket"], F.col("key"), "at")
    of = F.array(*[F.lit(e).cast("long") for e in ends or [0]])[F.col("bucket")]
    fit = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1))))
    return placed.withColumn("bucket_length", of).select(
        F.col("key").alias(key), "n_tokens", "bucket", "bucket_length",
        F.floor(F.col("at") / fit).cast("long").alias("batch"), (F.col("at") % fit).cast("long").alias("slot"))


def op10_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "doc_id", words(F.col("text")))


QUERIES = {"op10_length_buckets": op10_length_buckets}
