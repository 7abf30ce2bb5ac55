"""Streaming count-sketch.

A count-sketch is additive over rows, so a Structured Streaming aggregation
``groupBy(trial, bucket).agg(sum(sign*a_i))`` maintains it exactly as rows arrive; the
state is k·c rows whatever the stream length.  ``foreachBatch`` can re-solve the small
problem after each micro-batch (low-precision x that tracks the stream).

It is additive within a row as well: a row whose features are sums over parts (an order and its
line items) changes by exactly the new part's values, under the row's own bucket and sign.  So
parts are a stream of their own.  What a micro-batch brings is summed by key and kept as a log in
the shared folder, a row per key however many parts it has; the sums of earlier micro-batches
meet those of the new one by key, and the sketch of the changes is added to the one before.
No row or part is held in memory between micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallsketch.operators.sketch import cw_draw_columns
from tallsketch.session import scratch_path


def stream_rows(stream: DataFrame, key: str, features: list, target: str) -> DataFrame:
    feats = [(F.col(f) if isinstance(f, str) else f).cast("double").alias(f"a{i}") for i, f in enumerate(features)]
    return stream.select(F.col(key).cast("bigint").alias("key"), *feats, F.col(target).cast("double").alias("b"))


def streaming_cw_sketch(rows: DataFrame, n: int, c: int, k: int = 1, seed: int = 42) -> DataFrame:
    """The streaming aggregate (trial, bucket, v0..vn) of a streaming matrix DataFrame."""
    cols = ["key", *[f"a{i}" for i in range(n)], "b"]
    staged, draws = cw_draw_columns(rows.select(*cols), c, k, seed)
    exploded = staged.select(*cols, F.inline(F.array(*draws)))
    vals = [F.sum(F.col("sign") * F.col(f"a{i}")).alias(f"v{i}") for i in range(n)]
    vals.append(F.sum(F.col("sign") * F.col("b")).alias(f"v{n}"))
    return exploded.groupBy("trial", "bucket").agg(*vals)


def run_to_table(spark: SparkSession, agg: DataFrame, name: str, on_batch=None) -> DataFrame:
    """Drive the stream over everything available (trigger availableNow) into a memory
    table in complete mode, then return it.  Checkpoints live in the shared folder."""
    ckpt = scratch_path(spark, f"stream-{name}")
    writer = agg.writeStream.outputMode("complete").option("checkpointLocation", ckpt)
    if on_batch is not None:
        writer = writer.foreachBatch(on_batch)
    else:
        writer = writer.format("memory").queryName(name)
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name) if on_batch is None else None


def parquet_stream(spark: SparkSession, directory: str, table: str, max_files: int = 1) -> DataFrame:
    """A file stream over one table, a single Parquet file or a folder of part files."""
    path = f"{directory.rstrip('/')}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return files.parquet(path)
    return files.option("pathGlobFilter", f"{table}.parquet").parquet(directory)


def stream_low_precision(spark: SparkSession, rows: DataFrame, n: int, c: int, out_uri: str, k: int = 1,
                         seed: int = 42) -> None:
    """Low-precision least squares that tracks a stream: the count-sketch is maintained by a
    streaming aggregate (complete mode) and ``foreachBatch`` solves it after every
    micro-batch (TSQR per trial), appending ``(epoch, trial, x)`` to ``out_uri``."""
    from tallsketch.operators.sketch import SketchFrame
    from tallsketch.operators.small_solve import solve_sketch

    def on_batch(sketch_df: DataFrame, epoch: int) -> None:
        # One directory per epoch, overwritten: a retried micro-batch is idempotent.
        sf = SketchFrame(sketch_df, n, "cw", c, k, seed, "wide")
        solve_sketch(sf).select("trial", "x").write.mode("overwrite").parquet(f"{out_uri}/epoch={int(epoch)}")

    run_to_table(spark, streaming_cw_sketch(rows, n, c, k, seed), "unused", on_batch=on_batch)


def latest(spark: SparkSession, out_uri: str) -> DataFrame:
    """The rows of the last epoch below ``out_uri``."""
    rows = spark.read.parquet(out_uri)
    last = F.broadcast(rows.agg(F.max("epoch").alias("epoch")))  # one row
    return rows.join(last, "epoch").drop("epoch")


def latest_solutions(spark: SparkSession, out_uri: str) -> DataFrame:
    return latest(spark, out_uri).select("trial", "x")


# ----------------------------------------------------------------------------- rows made of parts

def row_changes(rows: DataFrame, key: str, row_values: list, parts: DataFrame, part_key: str, part_values: list,
                within=None) -> DataFrame:
    """What the streams ``rows`` and ``parts`` bring to the matrix rows, for ``maintain_sketch``: (key,
    a0 .. a{n-1}, b, part).  A row's own values arrive with it; each of its parts adds ``part_values``
    to them, early (the part waits for its row) or late.  Parts whose row never comes add nothing; null
    keys match nothing; values are n features and the target, columns or names.

    Streams with watermarks and a time condition ``within`` (over the columns of both) are joined here,
    without the column part: both sides are kept as state, and Spark drops what can no longer match."""
    def values(vals):
        cols = [(F.col(v) if isinstance(v, str) else v).cast("double") for v in vals]
        return [c.alias(f"a{i}") for i, c in enumerate(cols[:-1])] + [cols[-1].alias("b")]

    if len(row_values) != len(part_values):
        raise ValueError("rows and parts need the same number of values")
    own = rows.select(F.col(key).cast("bigint").alias("key"), *values(row_values))
    if within is not None:
        side = rows.withColumn("__row", F.col(key).cast("bigint"))
        met = parts.join(side, (parts[part_key].cast("bigint") == F.col("__row")) & within)
        return own.unionByName(met.select(F.col("__row").alias("key"), *values(part_values)))
    added = parts.select(F.col(part_key).cast("bigint").alias("key"), *values(part_values)).filter("key is not null")
    return own.withColumn("part", F.lit(False)).unionByName(added.withColumn("part", F.lit(True)))


def _log_changes(batch: DataFrame, log: str, epoch: int, values: list) -> DataFrame:
    """Write ``log``/epoch=e, a row per key of the micro-batch: its new rows, the sums of its new parts, and
    the change of the matrix, null where no row has come: own values of new rows, new parts of old and
    new rows, old parts of new rows; each of several rows of one key gets every part.  Returns the changes."""
    spark = batch.sparkSession
    own, added, before = ([f"{side}_{v}" for v in values] for side in ("own", "part", "old"))
    new = batch.select("key", F.lit(True).alias("new"), F.when(~F.col("part"), 1).cast("long").alias("rows"),
                       *[F.when(~F.col("part"), F.col(v)).alias(o) for v, o in zip(values, own)],
                       *[F.when(F.col("part"), F.col(v)).alias(o) for v, o in zip(values, added)])
    if epoch:
        old = spark.read.parquet(log).filter(F.col("epoch") < epoch).select(
            "key", F.lit(False).alias("new"), F.col("rows").alias("old_rows"), *[F.col(a).alias(o) for a, o in zip(added, before)])
        both = new.unionByName(old, allowMissingColumns=True)
    else:
        both = new.select("*", *[F.lit(None).cast("double").alias(o) for o in ("old_rows", *before)])
    met = both.groupBy("key").agg(F.max("new").alias("new"), *[F.sum(x).alias(x) for x in ("rows", "old_rows", *own, *added, *before)])
    every = F.coalesce(F.col("rows") + F.col("old_rows"), "rows", "old_rows").alias("every")

    def change(o, a, b):
        terms = [F.col(o), F.col("every") * F.col(a), F.col("rows") * F.col(b)]
        none = terms[0].isNull() & terms[1].isNull() & terms[2].isNull()
        return F.when(~none, sum((F.coalesce(t, F.lit(0.0)) for t in terms[1:]), F.coalesce(terms[0], F.lit(0.0))))

    path = f"{log}/epoch={epoch}"
    met.filter("new").select("*", every).select("key", "rows", *added, F.col("every").isNotNull().alias("met"), *[
        change(*of).alias(v) for *of, v in zip(own, added, before, values)]).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).filter("met").select("key", *values)


def maintain_sketch(changes: DataFrame, n: int, c: int, out_uri: str, k: int = 1, seed: int = 42, solve: bool = True):
    """Keep the count-sketch of a streamed matrix up to date and solve it after each micro-batch.

    ``{out_uri}/sketch/epoch=e`` is the sketch after micro-batch e, that of e-1 plus the sketch of the
    batch's changes (k·c rows each); ``{out_uri}/solutions/epoch=e`` its (trial, x).  Changes with a column
    part (``row_changes``) go to ``{out_uri}/log/epoch=e``, summed by key.  A batch reads its own rows once, k·c
    old ones and, of the earlier log, a row per key and micro-batch.  All are overwritten by a repeated micro-batch from the same predecessors, so a retry
    gives the same.  Runs what is available and returns the finished query; the checkpoint is in the
    shared folder."""
    from tallsketch.operators.sketch import SketchFrame, sketch
    from tallsketch.operators.small_solve import solve_sketch
    from tallsketch.sources.matrix import MatrixFrame

    names = [f"v{i}" for i in range(n + 1)]
    values = [*[f"a{i}" for i in range(n)], "b"]

    def on_batch(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if "part" in batch.columns:
            batch = _log_changes(batch, f"{out_uri}/log", int(epoch), values)
        total = sketch(MatrixFrame(batch, n), "cw", c, k, seed).df
        if epoch:
            total = total.unionByName(spark.read.parquet(f"{out_uri}/sketch/epoch={epoch - 1}"))
            total = total.groupBy("trial", "bucket").agg(*[F.sum(v).alias(v) for v in names])
        path = f"{out_uri}/sketch/epoch={int(epoch)}"
        total.write.mode("overwrite").parquet(path)
        if solve:
            kept = SketchFrame(spark.read.parquet(path), n, "cw", c, k, seed, "wide")
            solve_sketch(kept).select("trial", "x").write.mode("overwrite").parquet(f"{out_uri}/solutions/epoch={int(epoch)}")

    spark = changes.sparkSession
    q = (changes.writeStream.outputMode("append").option("checkpointLocation", scratch_path(spark, "stream-rows"))
         .foreachBatch(on_batch).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def folder_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder, ``max_files`` a micro-batch."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
