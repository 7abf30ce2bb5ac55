"""Weighted rendezvous hashing: every record key draws one exponential per shard and goes to
the shard with the smallest draw divided by its weight.

A shard's draw depends on the key and the shard's own name alone.  Adding a shard therefore
moves only the records whose draw for the new shard is the smallest (a share of
w_new / sum(w)), and changing one weight moves records only to or from that shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallsketch.llm.common import number_rows, stored, table

#: Hex digits of md5 that make a draw: 52 bits, exact in a double.
DIGITS = 13
SPAN = float(16 ** DIGITS)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Shard number 0..len(weights)-1 of a key; shards of weight 0 get nothing.

    A null key counts as the text 'null'.  Equal draws go to the lower shard number."""
    return F.array_min(costs(key, weights))["shard"]


def costs(key: Column, weights: list[float]) -> Column:
    """One (cost, shard) per shard: -ln(u) / weight, u uniform in (0, 1) from md5('<key>:<shard>')."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must be non-negative and not all zero")
    key = F.coalesce(key.cast("string"), F.lit("null"))
    shares = F.array(*[F.lit(float(w)) for w in weights])

    def cost(w: Column, s: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat_ws(":", key, s.cast("string"))), 1, DIGITS), 16, 10).cast("double")
        price = F.when(w > 0, -F.log((bits + 0.5) / SPAN) / w).otherwise(F.lit(float("inf")))
        return F.struct(price.alias("cost"), s.alias("shard"))

    return F.transform(shares, cost)


def assign_shards(df: DataFrame, key: str, weights: list[float], out: str = "shard") -> DataFrame:
    """``df`` with its shard: a projection, no shuffle; any other columns are kept.

    Null keys share one shard, repeated keys share their shard, an empty table stays empty.
    A column named like ``out`` is replaced."""
    return df.withColumn(out, rendezvous(F.col(key), weights))


def write_shards(df: DataFrame, key: str, weights: list[float], path: str) -> None:
    """Write the rows as Parquet under ``path/shard=<n>/``; each task writes its own files."""
    assign_shards(df, key, weights).write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame, shards: int, weights: list[float] | None = None) -> DataFrame:
    """Shard, gapless slot and the shard after growth by one equal shard, per document.

    Null text counts as empty; null doc_id is a key of its own; repeated rows get slots of
    their own.  Slots follow md5(doc_id) inside a shard."""
    weights = weights or [1.0] * shards
    draws = costs(F.col("doc_id"), [*weights, sum(weights) / len(weights)])  # the last is the shard to be added
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        draws.alias("draws"),
    ).select(
        "doc_id", "size", "text_crc32",
        F.array_min(F.slice("draws", 1, shards))["shard"].alias("shard"),
        F.array_min("draws")["shard"].alias("grown_shard"),
    )
    placed = number_rows(stored(rows, "shards"), ["shard"], F.col("doc_id"), "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         F.col("slot").cast("long").alias("slot"), "grown_shard")


SHARDS = 40


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(table(spark, sf_dir, "documents"), SHARDS)


# No oracle SQL: DuckDB has no CRC-32.  tests/llm checks the query against zlib and hashlib.
QUERIES = {"op2_rendezvous_sharding": op2_rendezvous_sharding}
