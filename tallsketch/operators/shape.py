"""Row shaping: dimensions (M1), global row index (M2), stacking (M3, M4), target (M6),
uniform sampling (M8)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallsketch.functions import hashing as H
from tallsketch.session import checkpoint_dir
from tallsketch.sources.matrix import MatrixFrame

LOCAL_BITS = 33  # monotonically_increasing_id = (partition id << 33) + position in partition
MAX_BROADCAST_PARTITIONS = 100_000  # offsets table = one (pid, offset) row per partition
MAX_BROADCAST_SPLITS = 1_000_000  # index of file splits: four longs each
MAX_RUNS = 1 << 17  # runs of consecutive keys that are sent to the tasks: two longs each


def dims(mf: MatrixFrame) -> tuple[int, int]:
    """M1: (m, n) in one aggregate; ragged array rows are an error."""
    if mf.layout == "wide":
        m = mf.df.agg(F.count(F.lit(1)).alias("m")).first()["m"]
        return int(m), mf.n
    r = mf.df.agg(F.count(F.lit(1)).alias("m"), F.max(F.size("a")).alias("hi"), F.min(F.size("a")).alias("lo")).first()
    if r["m"] and r["hi"] != r["lo"]:
        raise ValueError(f"ragged matrix: rows hold {r['lo']}..{r['hi']} features")
    return int(r["m"]), int(r["hi"] or 0)


def dims_frame(mf: MatrixFrame) -> DataFrame:
    """M1 as a DataFrame (m, n), for queries."""
    if mf.layout == "wide":
        return mf.df.agg(F.count(F.lit(1)).alias("m"), F.lit(mf.n).cast("int").alias("n"))
    return mf.df.agg(F.count(F.lit(1)).alias("m"), F.max(F.size("a")).cast("int").alias("n"))


def _attach_offsets(df: DataFrame, name: str) -> DataFrame:
    """Global 0-based position of each row of a *materialized* DataFrame in its current
    (partition, position) order: per-partition counts -> prefix sums -> broadcast join.

    The counts table has one row per partition, so its size is bounded by the partition
    count (checked), never by the data."""
    spark = df.sparkSession
    with_pid = df.withColumn("__pid", F.spark_partition_id()).withColumn(
        "__local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << LOCAL_BITS) - 1)))
    counts = with_pid.groupBy("__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    nparts = df.rdd.getNumPartitions()  # the input is materialized: no job
    from pyspark.sql.window import Window

    # The counts frame has one row per partition: a single-partition window over it is
    # bounded by the partition count, not by the rows.
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__cnt").over(w), F.lit(0)).alias("__off"))
    if nparts <= MAX_BROADCAST_PARTITIONS:  # 16 bytes per partition: a proven bound
        offsets = F.broadcast(offsets)
    return (with_pid.join(offsets, "__pid")
            .withColumn(name, (F.col("__off") + F.col("__local")).cast("bigint"))
            .drop("__pid", "__local", "__off"))


def row_index(df: DataFrame, order_cols: list[str], name: str = "idx", partitions: int | None = None) -> DataFrame:
    """M2: ``row_number() over (order by order_cols) - 1`` without a single-partition sort.

    Range-partition on the order columns, sort within partitions, cut the lineage with a
    reliable checkpoint (so both uses below see the same partition layout, even after an
    executor loss), then add per-partition offsets.  Order columns must be a total order
    (include a unique column)."""
    from tallsketch.operators.small_solve import estimated_partitions

    checkpoint_dir(df.sparkSession)
    # range partitions sized by the data (split size), never fewer than the cores
    nparts = partitions or max(df.sparkSession.sparkContext.defaultParallelism, estimated_partitions(df) or 0,
                               int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = df.repartitionByRange(nparts, *order_cols).sortWithinPartitions(*order_cols)
    stable = ordered.checkpoint(eager=True)
    return _attach_offsets(stable, name)


def row_index_natural(df: DataFrame, split: list[str], name: str = "idx") -> DataFrame:
    """M2 in the order of the files: ``split`` columns (path, start of the split) order the splits,
    and the rows of one are in their own order.  ``df`` is a scan of files and narrow steps on it.

    No row is written: one job counts the rows of each split (and reads no other column), and the
    first position of each split, a row per split, is joined to the scan.  A scan whose splits are
    cut or dealt to tasks in another way than the counted one raises: some split would then be
    found in a task that the index does not have it in, before any row behind it is numbered."""
    from pyspark.sql.window import Window

    checkpoint_dir(df.sparkSession)
    path, start = split
    placed = df.withColumn("__pid", F.spark_partition_id()).withColumn("__pos", F.monotonically_increasing_id())
    at = ["__pid", "__path", "__begin"]
    counts = placed.groupBy("__pid", path, start).agg(F.count(F.lit(1)).alias("__cnt"), F.min("__pos").alias("__first"))
    # one row per split: a single-partition window bounded by the files, not by the rows
    w = Window.orderBy(path, start).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.xxhash64(path).alias("__path"), F.col(start).alias("__begin"),
                            (F.coalesce(F.sum("__cnt").over(w), F.lit(0)) - F.col("__first")).alias("__off")).checkpoint(eager=True)
    size = offsets.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(*at).alias("keys")).first()
    if size["rows"] != size["keys"]:
        raise RuntimeError("two files of one task share a hash of their paths")
    if size["rows"] <= MAX_BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    joined = placed.withColumn("__path", F.xxhash64(path)).withColumn("__begin", F.col(start)).join(offsets, at, "left")
    number = F.coalesce(F.col("__pos") + F.col("__off"), F.raise_error(F.lit(
        "the files are split in another way than when their rows were counted; read them again")).cast("bigint"))
    return joined.withColumn(name, number.cast("bigint")).drop(*split, *at, "__pos", "__off")


@dataclass(frozen=True)
class KeyRuns:
    """The rank of a key among all keys, from the runs of consecutive keys: ``starts`` are the
    first keys of the runs, ``ranks`` theirs."""
    starts: np.ndarray
    ranks: np.ndarray

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.starts, keys, side="right") - 1
        return keys - self.starts[run] + self.ranks[run]


def key_ranks(mf: MatrixFrame) -> DataFrame:
    """(key, idx): the 0-based rank of every (unique) key.  Only the keys are sorted and written."""
    return row_index(mf.df.select("key"), ["key"], "idx")


def _key_range(mf: MatrixFrame) -> tuple[int, int, int]:
    r = mf.df.agg(F.count(F.lit(1)).alias("m"), F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    return int(r["m"]), int(r["lo"] or 0), int(r["hi"] or 0)


def _run_starts(batches):
    """The rows that do not go on from the one before; a run cut by a batch counts as two."""
    for b in batches:
        if b.num_rows:
            keys = b.column("key").to_numpy()
            yield b.filter(pa.array(np.concatenate([[True], np.diff(keys) != 1])))


def _rekeyed(mf: MatrixFrame, ranks: DataFrame) -> MatrixFrame:
    """Rows meet their rank by one shuffle on the key; the narrow side is the hashed one, so the
    rows are not sorted."""
    rows = mf.df.join(ranks.hint("shuffle_hash"), "key").drop("key").withColumnRenamed("idx", "key")
    return mf.with_df(rows.select(*mf.data_columns))


def contiguous_keys(mf: MatrixFrame) -> tuple[MatrixFrame, int]:
    """Matrix whose keys are exactly 0..m-1, in the order of the old ones.

    One aggregate checks whether the (unique) keys are consecutive already, which needs a
    subtraction at most; only otherwise are ranks computed and joined."""
    m, lo, hi = _key_range(mf)
    if m == 0 or hi - lo + 1 == m:
        if m == 0 or lo == 0:
            return mf, m
        return mf.with_df(mf.df.withColumn("key", F.col("key") - F.lit(lo)).select(*mf.data_columns)), m
    return _rekeyed(mf, key_ranks(mf)), m


def ranked_keys(mf: MatrixFrame, max_runs: int = MAX_RUNS) -> tuple[MatrixFrame, int, KeyRuns | None]:
    """(matrix, m, ranks): the ranks 0..m-1 of the keys for work in Arrow batches, which apply
    ``ranks`` to a batch's keys (None: the keys are ranks already).

    Keys of at most ``max_runs`` runs of consecutive numbers (1..m, order numbers with gaps) need no
    movement of rows at all: the runs go to the tasks.  Others are joined with a (key, rank) table."""
    m, lo, hi = _key_range(mf)
    if m == 0 or (lo == 0 and hi == m - 1):
        return mf, m, None
    if hi - lo + 1 == m:
        return mf, m, KeyRuns(np.array([lo], np.int64), np.zeros(1, np.int64))
    ranks = key_ranks(mf)
    runs = ranks.select("key", "idx").mapInArrow(_run_starts, "key long, idx long")
    if runs.count() > max_runs:
        return _rekeyed(mf, ranks), m, None
    runs = runs.toArrow().sort_by("key")
    return mf, m, KeyRuns(runs["key"].to_numpy(), runs["idx"].to_numpy())


def stack(mf: MatrixFrame, r: int, kind: str = "all") -> MatrixFrame:
    """M3 / M4: repeat rows vertically.

    ``all``: every row r times; ``dense``: only rows with more than two non-zeros in
    [A b] (stack type 2).  New key = key * r + rep, unique, no extra job."""
    if r < 1:
        raise ValueError("r must be >= 1")
    if kind not in ("all", "dense"):
        raise ValueError(f"stack kind must be 'all' or 'dense', not {kind!r}")
    df = mf.df
    if kind == "all":
        reps = F.sequence(F.lit(0), F.lit(r - 1))
    else:
        reps = F.sequence(F.lit(0), F.when(nnz(mf) > 2, F.lit(r - 1)).otherwise(F.lit(0)))
    out = (df.select("*", F.explode(reps).alias("rep"))
           .withColumn("key", F.col("key") * F.lit(r) + F.col("rep")))
    return mf.with_df(out.select(*mf.data_columns, "rep"), name=f"{mf.name}_stack{kind}_rep{r}",
                      meta={**mf.meta, "stack": kind, "repnum": r})


def nnz(mf: MatrixFrame):
    """Number of non-zeros of [A b] per row."""
    if mf.layout == "wide":
        terms = [F.when(c != 0, 1).otherwise(0) for c in mf.features()]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
    else:
        total = F.size(F.filter("a", lambda v: v != 0))
    return total + F.when(F.col("b") != 0, 1).otherwise(0)


def target(mf: MatrixFrame) -> DataFrame:
    """M6: the response as a keyed column (never collected)."""
    return mf.df.select("key", "b")


def uniform_sample(mf: MatrixFrame, s: float, seed: int, m: int | None = None) -> MatrixFrame:
    """M8: keep each row with p = s/m (keyed coin), return row / p."""
    if m is None:
        m = dims(mf)[0]
    p = min(1.0, float(s) / float(m))
    tossed = H.spark_with_coin(mf.df, "key", H.sample_poly(seed, "uniform"), "__u")
    kept = tossed.where(F.col("__u") < F.lit(p)).drop("__u")
    scale = 1.0 / p
    if mf.layout == "wide":
        out = kept.select("key", *[(F.col(c) * scale).alias(c) for c in mf.feature_names], (F.col("b") * scale).alias("b"))
    else:
        out = kept.select("key", F.transform("a", lambda v: v * scale).alias("a"), (F.col("b") * scale).alias("b"))
    return mf.with_df(out, meta={**mf.meta, "p": p})
