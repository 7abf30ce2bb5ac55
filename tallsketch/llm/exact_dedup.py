"""Exact deduplication through an extendible-hash index kept as Parquet on shared files.

Built-in DataFrame functions only.  Texts are equal when their bytes are equal after every
character of [\\x20\\x09-\\x0D] is deleted.

1. Entries: one narrow row per document with a 64-bit key hash and SHA-256 of the normalised
   text.
2. Directory: it starts with one bucket and doubles; a bucket whose entries exceed the
   capacity is split on the next hash bit, up to ``max_depth`` bits.  It has at most
   2**max_depth rows whatever the corpus size.
3. Index: one row per distinct key with its bucket, written by the bucket's owner task.  Copies
   are collapsed before the shuffle, so a text that makes up a third of the rows is one row
   per task.  Keys that share the 64-bit hash are chained under it.
4. Bytes: keys held by several documents are checked against the whole normalised texts; texts
   of one hash are told apart by comparing bytes, not digests alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallsketch.llm.common import free_name, join_hot, located, small, stored, table

SPACE = r"[\x20\x09-\x0D]"
#: Entries a bucket may hold before it is split.
CAPACITY = 100_000
MAX_DEPTH = 14


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def directory(entries: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(prefix, depth, bucket) for each prefix of ``max_depth`` hash bits that occurs.

    A prefix's local depth is the number of times its bucket had to be split: counts shrink
    with every bit, so it is the number of depths at which its bucket is overfull."""
    hist = entries.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    cells = (
        hist.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(max_depth))))
        .withColumn("cell", F.expr(f"shiftright(prefix, {max_depth} - d)"))
    )
    # at most (rows / capacity) cells of each depth, and 2**depth
    full = F.broadcast(cells.groupBy("d", "cell").agg(F.sum("n").alias("rows")).filter(F.col("rows") > capacity)
                       .select("d", "cell", F.lit(1).alias("full")))
    return (
        cells.join(full, ["d", "cell"], "left").groupBy("prefix")
        .agg(F.least(F.lit(max_depth), F.coalesce(F.sum("full"), F.lit(0))).cast("int").alias("depth"))
        .withColumn("bucket", F.expr(f"(1 << depth) + shiftright(prefix, {max_depth} - depth)"))
    )


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
            max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per document: key, row, text_sha256, keep_id, keep_row, group_size, kept.

    Of equal texts the row with the most code points in the original text stays, then the
    smallest key, then one row of them; a null key comes last.  Null text counts as empty.
    ``row`` tells repeated keys apart.  Empty input gives no rows."""
    place = free_name(docs, "_row")
    return _classes(located(docs, place), place, key, text, capacity, max_depth)


def _classes(docs: DataFrame, place: str, key: str, text: str, capacity: int = CAPACITY,
             max_depth: int = MAX_DEPTH) -> DataFrame:
    norm = normalised(F.col(text))
    entries = stored(
        docs.select(
            F.col(key).alias("id"),
            F.col(place).alias("row"),
            F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("points"),
            F.xxhash64(norm).alias("h"),
            F.unhex(F.sha2(norm, 256)).alias("sha"),
        ).withColumn("prefix", F.shiftrightunsigned("h", 64 - max_depth).cast("int")),
        "exact-entries",
    )
    # the directory has at most 2**max_depth rows
    dirs = F.broadcast(directory(entries, capacity, max_depth).select("prefix", "bucket"))
    best = F.max(F.struct("points", F.bitwise_not("id").alias("nid"), "row"))
    keys = entries.groupBy("prefix", "h", "sha").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
    index = stored(
        keys.join(dirs, "prefix")
        .select("bucket", "h", "sha", "n", F.bitwise_not("best.nid").alias("keep_id"),
                F.col("best.row").alias("keep_row"))
        .repartition("bucket").sortWithinPartitions("bucket", "h", "sha"),
        "exact-index",
    )
    chained = index.join(_byte_chains(docs, text, index), ["h", "sha"], "left").select(
        "h", "sha", "n", "keep_id", "keep_row",
        F.when(F.coalesce(F.col("strings"), F.lit(1)) == 1, F.lit(True))
        .otherwise(F.raise_error(F.lit("different texts share hash and SHA-256"))).alias("checked"),
    )
    out = join_hot(entries.drop("prefix"), stored(chained, "exact-chains"), ["h", "sha"], entries.count(), "n")
    return out.filter("checked").select(
        F.col("id").alias(key), "row", F.lower(F.hex("sha")).alias("text_sha256"), "keep_id", "keep_row",
        F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"))


def _byte_chains(docs: DataFrame, text: str, index: DataFrame) -> DataFrame:
    """(h, sha, strings): how many different byte strings lie behind each key of several rows."""
    shared = small(stored(index.filter("n > 1").select("h").distinct(), "exact-shared"))
    whole = docs.select(normalised(F.col(text)).alias("norm")).withColumn("h", F.xxhash64("norm"))
    texts = whole.join(shared, "h", "left_semi").groupBy("h", "norm").agg(F.count(F.lit(1)).alias("n"))
    return (texts.select("h", F.unhex(F.sha2("norm", 256)).alias("sha"))
            .groupBy("h", "sha").agg(F.count(F.lit(1)).alias("strings")))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, whatever their names."""
    place = free_name(docs, "_row")
    rows = located(docs, place)
    gone = stored(_classes(rows, place, key, text).filter("not kept").select(F.col("row").alias(place)), "exact-gone")
    return rows.join(small(gone), place, "left_anti").drop(place)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", "text_sha256")


ORACLE = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS sha FROM documents),
     g AS (SELECT *, count(*) OVER (PARTITION BY sha) AS group_size,
                  first_value(doc_id) OVER (PARTITION BY sha ORDER BY points DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM g
"""

QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLES = {"op5_exact_dedup": ORACLE}
