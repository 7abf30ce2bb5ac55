"""Plan-building helpers shared by the text operators: scratch tables, size-checked
broadcasts, joins that keep hot keys apart, gapless numbering, connected components."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallsketch.session import scratch_path

#: Rows of a narrow table (a few longs each) that may be broadcast; beyond it, a shuffle join.
BROADCAST_ROWS = 200_000
#: A key is hot when it holds more than this fraction of the rows: at most 1/HOT_SHARE keys can be.
HOT_SHARE = 1 / 2000
#: Rows of a small narrow table that a task takes, at least.
TASK_ROWS = 25_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's setting that removes the shuffle files of a job when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, clean_up: bool = False) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts the lineage, gives
    every later reader the same rows, and survives lost executors.  With ``clean_up`` the shuffle
    files go with the end of the write instead of the driver's next garbage collection."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEAN_UP, None)
    if clean_up:
        spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if clean_up:
            spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def located(df: DataFrame, out: str) -> DataFrame:
    """``df`` with a column that tells its rows apart and is the same whenever it is read again:
    file and row number of Parquet rows; other tables are stored first."""
    try:
        meta = df.metadataColumn("_metadata")
        return df.withColumn(out, F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("row")))
    except AnalysisException:
        return located(stored(df, "located"), out)


def discard(df: DataFrame) -> None:
    """Delete a scratch table made by ``stored`` whose readers have all finished."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored narrow table for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which comes from ``rows`` narrow rows, in few tasks if these may be broadcast as well:
    else each shuffle of a small table takes as many tasks as one of a large table."""
    return df.coalesce(2 + rows // TASK_ROWS) if rows <= BROADCAST_ROWS else df


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], total: int, size: str) -> DataFrame:
    """Inner join of many ``left`` rows with one ``right`` row per key, where ``right[size]``
    says how many left rows the key has.  The keys with more than ``total * HOT_SHARE`` rows
    are at most 2000; they are broadcast, so a hot key is never gathered in one task."""
    limit = max(1.0, total * HOT_SHARE)
    hot = F.broadcast(right.filter(F.col(size) > limit).withColumn("_hot", F.lit(True)))
    rest = right.filter(F.col(size) <= limit)
    near = left.join(hot, keys).drop("_hot")
    far = left.join(hot.select(*keys), keys, "left_anti").join(rest, keys)
    return near.unionByName(far)


def number_rows(df: DataFrame, group: list[str], key: Column, out: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in the order of md5(key), key.

    ``df`` must be narrow: equal rows are collapsed before the shuffle and expanded after it,
    so a row repeated without bound costs one row.  Each group is cut into 256 parts by md5;
    the parts' sizes (256 rows a group) give the starts, so no task sorts a whole group.
    """
    cols = df.columns
    parts = (
        df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_md5", F.md5(F.coalesce(key.cast("string"), F.lit("null"))))
        .withColumn("_part", F.substring("_md5", 1, 2))
    )
    sizes = parts.groupBy(*group, "_part").agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    upto = Window.partitionBy(*group, "_part").orderBy("_md5", *cols).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("_first", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    same = [placed[c].eqNullSafe(starts[c]) for c in [*group, "_part"]]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    step = 65536
    return (
        placed.join(starts, cond)
        .select(*[placed[c] for c in cols], "_n", (F.col("_start") + F.col("_first")).alias("_at"))
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(step).cast("long"))))
        .withColumn("_i", F.explode(F.sequence(F.col("_block"), F.least(F.col("_block") + (step - 1), F.col("_n") - 1))))
        .select(*cols, (F.col("_at") + F.col("_i")).alias(out))
    )


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected edge table: (node, component), component being
    the smallest node reachable; nodes without edges do not occur.

    Alternating large-star and small-star rounds (Kiveris et al. 2014), each a groupBy and a
    join; every round is written to the shared folder.  Both keep the components and let every
    edge point to a smaller node, so the search is over as soon as the edges are stars.  Edges
    never reach the driver; the number of rounds is logarithmic in practice.
    """
    total = edges.count()
    now = stored(gathered(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
                          .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), total), "cc")
    while (total := now.count()) and not _stars(now, total):
        # large-star: every larger neighbour of u points to the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = gathered(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")), 2 * total)
        large = _star(both, low, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(gathered(large.filter("u <> v").distinct(), 2 * total), "cc")
        # small-star: u and its smaller neighbours point to the smallest of them
        rows = large.count()
        low = gathered(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), rows)
        down = _star(large, low, rows).select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = stored(gathered(down.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), 2 * rows), "cc")
        discard(now)
        discard(large)
        now = nxt
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        gathered(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct(), total))


def _stars(edges: DataFrame, rows: int) -> bool:
    """Whether every node of the distinct edges (u, v) either has one edge out or only edges in."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    per = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return gathered(per, 2 * rows).filter("out > 1 or (out > 0 and in > 0)").count() == 0


def _star(pairs: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """Give each of ``total`` pairs its node's minimum; nodes with many neighbours do not gather in
    one task.  ``low`` has no more rows than ``pairs``, so a small one is broadcast."""
    if total <= BROADCAST_ROWS:
        return pairs.join(F.broadcast(low), "u")
    return join_hot(pairs, low, ["u"], total, "n")
