"""Row-distributed matrices [A b] as DataFrames (D1-D5) and their sources.

A ``MatrixFrame`` wraps a DataFrame with

* ``key``  BIGINT, unique per row (the source of all keyed randomness),
* either ``a0 .. a{n-1}`` DOUBLE columns ("wide", Catalyst expressions, n <= WIDE_MAX)
  or one ``a`` ARRAY<DOUBLE> column of length n ("array", NumPy in Arrow batches),
* ``b`` DOUBLE, the response.

Only the schema and n live on the driver; m is counted when an operator needs it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDE_MAX = 32  # above this many features, expressions leave whole-stage codegen; use Arrow


@dataclass(frozen=True)
class MatrixFrame:
    df: DataFrame
    n: int
    layout: str = "wide"  # "wide" | "array"
    name: str = "matrix"
    meta: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        if self.layout not in ("wide", "array"):
            raise ValueError(f"unknown layout {self.layout!r}")
        if self.n < 1:
            raise ValueError("a matrix needs at least one feature column")

    # ------------------------------------------------------------------ columns
    @property
    def feature_names(self) -> list[str]:
        return [f"a{i}" for i in range(self.n)]

    def feature(self, i: int) -> Column:
        if self.layout == "wide":
            return F.col(f"a{i}")
        return F.element_at(F.col("a"), i + 1)

    def features(self) -> list[Column]:
        return [self.feature(i) for i in range(self.n)]

    @property
    def data_columns(self) -> list[str]:
        return ["key", *(self.feature_names if self.layout == "wide" else ["a"]), "b"]

    def with_df(self, df: DataFrame, **kw) -> "MatrixFrame":
        return replace(self, df=df, **kw)

    # ------------------------------------------------------------------ M5 persist
    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> "MatrixFrame":
        """Keep the rows between passes.  Lost blocks are recomputed from the (short)
        lineage, and every random draw is keyed, so a recomputation is identical."""
        return self.with_df(self.df.persist(level))

    def unpersist(self) -> None:
        self.df.unpersist()

    # ------------------------------------------------------------------ conversions
    def to_array(self) -> "MatrixFrame":
        if self.layout == "array":
            return self
        df = self.df.select("key", F.array(*self.features()).alias("a"), "b")
        return replace(self, df=df, layout="array")

    def to_wide(self) -> "MatrixFrame":
        if self.layout == "wide":
            return self
        df = self.df.select("key", *[self.feature(i).alias(f"a{i}") for i in range(self.n)], "b")
        return replace(self, df=df, layout="wide")


def _cast_key(c) -> Column:
    return F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")


def from_columns(df: DataFrame, key: str | Column, features: list, target: str | Column,
                 name: str = "matrix", mode: str = "error") -> MatrixFrame:
    """S3: matrix from numeric columns.  Features may be names or Column expressions
    (e.g. ``F.lit(1.0)`` for an intercept).  Cast to DOUBLE (D3).  A row with a null feature,
    target or key raises (``mode='error'``) or is dropped, whatever is computed from it."""
    feats = [(F.col(f) if isinstance(f, str) else f).cast("double").alias(f"a{i}") for i, f in enumerate(features)]
    tgt = (F.col(target) if isinstance(target, str) else target).cast("double").alias("b")
    out = df.select(_cast_key(key).alias("key"), *feats, tgt)
    if mode == "drop":
        out = out.dropna()
    else:
        whole = F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in out.columns))
        out = out.where(F.when(whole, F.lit(True)).otherwise(
            F.raise_error(F.lit("matrix row with a null (mode='drop' leaves such rows out)")).cast("boolean")))
    n = len(features)
    if n > WIDE_MAX:
        return MatrixFrame(out, n, "wide", name).to_array()
    return MatrixFrame(out, n, "wide", name)


def from_array(df: DataFrame, key: str | Column, vector: str | Column, target: str | Column,
               n: int | None = None, name: str = "matrix", mode: str = "error") -> MatrixFrame:
    """S3: matrix from one array column.  ``n`` is counted (M1) when not given; rows whose
    length differs from n, or that hold nulls, raise (``mode='error'``) or are dropped."""
    vec = (F.col(vector) if isinstance(vector, str) else vector)
    tgt = (F.col(target) if isinstance(target, str) else target).cast("double").alias("b")
    out = df.select(_cast_key(key).alias("key"), F.transform(vec, lambda v: v.cast("double")).alias("a"), tgt)
    if n is None:
        first = out.where(F.col("a").isNotNull()).select(F.size("a").alias("n")).first()  # the others are checked below
        if first is None:
            raise ValueError("no row to take the number of columns from")
        n = first["n"]
    ok = (F.size("a") == F.lit(n)) & F.col("b").isNotNull() & F.forall("a", lambda v: v.isNotNull())
    if mode == "drop":
        out = out.where(ok)
    else:
        out = out.withColumn("a", F.when(ok, F.col("a")).otherwise(
            F.raise_error(F.lit(f"row is ragged or has nulls (expected {n} features)")).cast("array<double>")))
    return MatrixFrame(out, int(n), "array", name)


#: The columns that order the splits of text files.
SPLIT = ["__file", "__start"]


def _text_lines(spark: SparkSession, uri: str) -> DataFrame:
    """Lines with the file and the start of the split they come from."""
    return spark.read.text(uri).select("value", F.col("_metadata.file_path").alias("__file"),
                                       F.col("_metadata.file_block_start").alias("__start"))


def parse_text_lines(lines: DataFrame, mode: str = "error", keep: list[str] | None = None) -> DataFrame:
    """One text line -> array<double>, split on runs of blanks after trimming; the columns
    ``keep`` stay as they are."""
    tokens = F.split(F.trim(F.col("value")), r"\s+")
    if mode == "drop":
        vals = F.transform(tokens, lambda t: t.try_cast("double"))
    else:
        vals = F.transform(tokens, lambda t: t.cast("double"))
    out = lines.where(F.length(F.trim("value")) > 0).select(vals.alias("row"), *(keep or []))
    if mode == "drop":
        out = out.where(F.forall("row", lambda v: v.isNotNull()))
    return out


def read_text_matrix(spark: SparkSession, uri: str, n: int | None = None, key: str = "line",
                     partitions: int | None = None, name: str | None = None, mode: str = "error") -> MatrixFrame:
    """Read ``[A b]`` as blank-separated numbers, last column = b, one row per line.

    The URI scheme picks the filesystem (``file:``, ``hdfs:``, ``s3a:`` ...).  Keys:

    * ``'line'``: the number of the non-blank line over all files, ordered by path (M2 over the
      file order; one more pass that counts lines and writes a row per split) -- identical under any
      cluster or split configuration;
    * ``'position'``: ``monotonically_increasing_id()`` of the raw file scan -- no extra
      pass, stable across re-reads of the same files with the same split size
      (``spark.sql.files.maxPartitionBytes``), not contiguous;
    * ``'first'``: the first number of each line (files of ``key a0 .. b`` lines).
    """
    lines, meta = spark.read.text(uri), {}
    rows = parse_text_lines(lines, mode) if key != "line" else parse_text_lines(_text_lines(spark, uri), mode, SPLIT)
    if key == "first":
        keyed = rows.select(F.element_at("row", 1).cast("bigint").alias("key"), F.slice("row", 2, 1 << 30).alias("row"))
    elif key == "position":
        keyed = rows.select(F.monotonically_increasing_id().alias("key"), "row")
    elif key != "line":
        raise ValueError(f"key must be 'line', 'position' or 'first', not {key!r}")
    else:
        from tallsketch.operators.shape import row_index_natural
        from tallsketch.sources.sinks import source_state

        meta = {"source": source_state(lines)}  # the index of the splits has no files of its own
        keyed = row_index_natural(rows, SPLIT, "key").select("key", "row")
    if n is None:
        first = keyed.select(F.size("row").alias("w")).first()  # every other row is checked against it below
        if first is None:
            raise ValueError("no row to take the number of columns from")
        n = int(first["w"]) - 1
    ok = F.size("row") == F.lit(n + 1)
    if mode == "drop":
        keyed = keyed.where(ok)
    else:
        keyed = keyed.withColumn("row", F.when(ok, F.col("row")).otherwise(
            F.raise_error(F.lit(f"text row does not hold {n + 1} numbers")).cast("array<double>")))
    if partitions:  # after numbering, so line keys keep the file order
        keyed = keyed.repartition(int(partitions), "key")
    arr = keyed.select("key", F.slice("row", 1, n).alias("a"), F.element_at("row", -1).alias("b"))
    mf = MatrixFrame(arr, n, "array", name or uri, meta)
    return mf.to_wide() if n <= WIDE_MAX else mf


def read_vector_text(spark: SparkSession, uri: str) -> list[float]:
    """A known optimum x* (one number per line) or f* (one line).  n+1 numbers at most;
    read with Spark so any filesystem works."""
    from tallsketch.operators.shape import row_index_natural

    rows = row_index_natural(_text_lines(spark, uri).where(F.length(F.trim("value")) > 0), SPLIT, "i")
    return [float(r["value"]) for r in rows.orderBy("i").select(F.trim("value").alias("value")).collect()]


def write_vector_text(values: DataFrame, uri: str) -> None:
    """Write the doubles ``value`` of one row or one small vector, one a line, in their order."""
    values.select(F.format_string("%.17g", F.col("value").cast("double")).alias("value")).coalesce(1).write.text(uri)


def write_text_matrix(mf: MatrixFrame, uri: str, with_key: bool = True) -> None:
    """Write ``key a0 .. b`` lines (``%.17g`` keeps doubles exact); ``with_key=False`` writes
    plain ``[A b]`` lines (no key column), in key order."""
    mfw = mf.to_wide() if mf.n <= WIDE_MAX else mf
    parts = [F.format_string("%.17g", c) for c in mfw.features()] + [F.format_string("%.17g", "b")]
    df = mfw.df
    if with_key:
        parts = [F.col("key").cast("string")] + parts
    else:
        df = df.orderBy("key")
    df.select(F.concat_ws(" ", *parts).alias("value")).write.mode("overwrite").text(uri)


# ----------------------------------------------------------------------------- driver-table views

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders_matrix(spark: SparkSession, sf_dir: str) -> MatrixFrame:
    """OM: one row per order: [1, number of line items, total quantity | o_totalprice].

    lineitem is pre-aggregated by l_orderkey (partial aggregation before the shuffle, so
    a hot order key collapses to one row per map task) and the result is hash-partitioned
    on the join key, so the left join only shuffles ``orders``.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    items = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
             .agg(F.count(F.lit(1)).alias("n_items"), F.sum("l_quantity").alias("sum_qty")))
    joined = orders.join(items, orders.o_orderkey == items.l_orderkey, "left")
    return from_columns(
        joined, "o_orderkey",
        [F.lit(1.0), F.coalesce(F.col("n_items"), F.lit(0)), F.coalesce(F.col("sum_qty"), F.lit(0.0))],
        "o_totalprice", name="orders_items")


def events_matrix(spark: SparkSession, sf_dir: str) -> MatrixFrame:
    """EV: [1, user_id | value] keyed by event_id."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return from_columns(ev, "event_id", [F.lit(1.0), "user_id"], "value", name="events")


def events_dense_matrix(spark: SparkSession, sf_dir: str) -> MatrixFrame:
    """EV-dense: [user_id, 1 unless event_id % 10 = 0 | value]; about a tenth of the rows
    have at most two non-zeros in [A b] (the light rows of stack type 2)."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    ind = F.when(F.col("event_id") % 10 != 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return from_columns(ev, "event_id", ["user_id", ind], "value", name="events_dense")


def embeddings_matrix(spark: SparkSession, sf_dir: str, n: int | None = 64) -> MatrixFrame:
    """EMB: the 64 embedding floats as doubles, label as b."""
    emb = table(spark, sf_dir, "embeddings")
    return from_array(emb, "vec_id", "embedding", "label", n=n, name="embeddings")
