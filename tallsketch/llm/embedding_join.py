"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine >= c lie within eps = sqrt(2 - 2c) of each other.  They are rotated to
leading principal dimensions, ordered by their grid cells of width eps, and cut into sequence
intervals of ``BLOCK`` vectors.  Interval pairs are refined from the whole sequence down, 16
parts at a time, and dropped as soon as their bounding boxes are further apart than eps; what
is left are block pairs, whose cosines are computed in double precision.  A rotation keeps
distances, so no link is lost whatever sample the principal dimensions come from.

Equal vectors are one class and joined once.  A block pair returns link counts and a spanning
forest of its links, at most one row per vector, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallsketch.llm.blocks import block_stream, cut_blocks, forest, meet
from tallsketch.llm.common import components, join_hot, stored, table
from tallsketch.session import ship_package

#: Vectors in a block.
BLOCK = 1024
#: Leading principal dimensions of the grid.
DIMS = 8
#: Numbers in the sample that the principal dimensions of a vector length are computed from, about.
SAMPLE_VALUES = 1_280_000
#: Parts that an interval is split into; a power of two.
FAN = 16


def rotations(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length (dim, DIMS) leading principal directions, of a sample of unit vectors.

    One grouped pass: of each length the vectors whose hash is below a threshold that lets about
    ``SAMPLE_VALUES`` numbers pass; the driver gets the directions alone."""
    def fit(part: pd.DataFrame) -> pd.DataFrame:
        dim = int(part["dim"].iloc[0])
        x = np.stack(part.sort_values("cid")["vec"].to_list())
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        values, axes = np.linalg.eigh(np.cov(x.T).reshape(dim, dim) if len(x) > 1 else np.eye(dim))
        return pd.DataFrame({"dim": [dim], "axes": [axes[:, np.argsort(values)[::-1][:DIMS]].ravel()]})

    sizes = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("rows"))
    share = F.lit(float(SAMPLE_VALUES)) / (F.col("rows") * F.col("dim"))
    some = classes.join(sizes, "dim").filter(F.pmod(F.xxhash64("cid"), F.lit(1 << 32)) < share * float(1 << 32))
    found = some.select("dim", "cid", "vec").groupBy("dim").applyInPandas(fit, "dim int, axes array<double>")
    axes = {r[0]: np.array(r[1]).reshape(r[0], -1) for r in found.collect()}  # a row per vector length
    for (dim,) in sizes.select("dim").collect():
        axes.setdefault(dim, np.eye(dim)[:, :DIMS])  # no vector passed: any rotation is right
    return axes


def _project(axes: dict[int, np.ndarray], eps: float):
    """Adds the vector's bytes, its leading coordinates and its grid cells."""
    def run(batches):
        for b in batches:
            vec = b.column("vec")
            dims = b.column("dim").to_numpy()
            flat, at = vec.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(dims)])
            coords = np.zeros((len(dims), DIMS))
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                x = flat[at[rows][:, None] + np.arange(d)]
                coords[rows, : axes[d].shape[1]] = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes[d]
            data = [flat[a:e].tobytes() for a, e in zip(at, at[1:])]
            cells = np.floor(coords / eps).astype(np.int32)
            cols = [b.column(n) for n in ("grp", "dim", "cid", "n")]
            cols += [pa.array(data, pa.binary())]
            cols += [pa.array(coords[:, j]) for j in range(DIMS)] + [pa.array(cells[:, j]) for j in range(DIMS)]
            yield pa.RecordBatch.from_arrays(cols, names=["grp", "dim", "cid", "n", "vec", *P, *C])
    return run


P = [f"p{j}" for j in range(DIMS)]
C = [f"c{j}" for j in range(DIMS)]


def _near(eps: float):
    """Squared distance of two bounding boxes is at most eps squared (with room for rounding)."""
    gap = [F.greatest(F.lit(0.0), F.col(f"a.lo{j}") - F.col(f"b.hi{j}"), F.col(f"b.lo{j}") - F.col(f"a.hi{j}"))
           for j in range(DIMS)]
    return sum((g * g for g in gap[1:]), gap[0] * gap[0]) <= eps * eps * (1 + 1e-9) + 1e-12


def block_pairs(boxes: DataFrame, eps: float, bits: int) -> DataFrame:
    """(grp, dim, a, b), a <= b: pairs of blocks that may hold a link, by recursive refinement."""
    step = FAN.bit_length() - 1
    level = -(-bits // step) * step
    pairs = boxes.select("grp", "dim", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).distinct()
    while True:
        level = max(0, level - step)
        cut = boxes.withColumn("code", F.shiftright("code", level)).groupBy("grp", "dim", "code").agg(
            *[F.min(f"lo{j}").alias(f"lo{j}") for j in range(DIMS)], *[F.max(f"hi{j}").alias(f"hi{j}") for j in range(DIMS)])
        cut = cut.withColumn("up", F.shiftright("code", step))
        left = pairs.join(cut.alias("a"), (pairs["grp"] == F.col("a.grp")) & (pairs["dim"] == F.col("a.dim"))
                          & (pairs["a"] == F.col("a.up")))
        both = left.join(cut.alias("b"), (pairs["grp"] == F.col("b.grp")) & (pairs["dim"] == F.col("b.dim"))
                         & (pairs["b"] == F.col("b.up")) & (F.col("a.code") <= F.col("b.code")) & _near(eps))
        pairs = both.select(pairs["grp"], pairs["dim"], F.col("a.code").alias("a"), F.col("b.code").alias("b"))
        if level == 0:
            return pairs
        pairs = stored(pairs, "ego-pairs")


def _join(cosine: float):
    """Streams (block a's rows, then partner blocks' rows) and yields links of each pair."""
    def links(a, b):
        (ia, na, xa, la), (ib, nb, xb, lb) = a, b or a
        near = (xa @ xb.T) / (la[:, None] * lb[None, :]) >= cosine
        if b is None:
            np.fill_diagonal(near, False)
        if not near.any():
            return
        low = forest(near)
        ids = np.concatenate([ia, ib])
        count = np.concatenate([near @ nb, np.zeros(len(ib), np.int64) if b is None else na @ near])
        hit = np.flatnonzero(np.concatenate([near.any(1), np.zeros(len(ib), bool) if b is None else near.any(0)]))
        if b is None:  # both sides are the same vectors
            low = np.minimum(low[: len(ia)], low[len(ia):])
            root = ids[low % len(ia)]
        else:
            root = ids[low]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[hit]), pa.array(count[hit].astype(np.int64)), pa.array(root[hit])], names=["cid", "links", "root"])

    def pack(rows):
        ids, n, dim = (np.concatenate([r[k] for r in rows]) for k in (0, 1, 2))
        x = np.frombuffer(b"".join(v for r in rows for v in r[3]), float).reshape(len(ids), dim[0])
        return ids, n, x, np.linalg.norm(x, axis=1)

    def run(batches):
        own = None
        for _, b, slices in block_stream(batches):
            block = pack([[s.column(n).to_numpy() for n in ("cid", "n", "dim")] + [s.column("vec").to_pylist()]
                          for s in slices])
            if b == -1:
                own = block
                yield from links(own, None)
            else:
                yield from links(own, block)

    return run


def linked(df: DataFrame, key: str, vec: str, group: str, cosine: float) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept.

    Links hold between vectors of equal, non-null group and equal length with cosine >=
    ``cosine``.  Null, empty and zero vectors and vectors with null or non-finite components
    link with nothing and are their own component.  Vectors of very large or small components
    are scaled by a power of two, which keeps their cosines.  Equal vectors (repeated rows too) link with
    one another; a null key counts as a vector but never names a component of others.  Other
    columns are not read; empty input gives no rows."""
    spark = df.sparkSession
    ship_package(spark)
    v = F.col(vec).cast("array<double>")
    top = F.array_max(F.transform(v, F.abs))
    unit = F.pow(F.lit(2.0), F.floor(F.log2(top)))
    v = F.when((top > 1e100) | (top < 1e-100), F.transform(v, lambda x: x / unit)).otherwise(v)
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    ok = F.col(group).isNotNull() & F.coalesce(norm > 0, F.lit(False)) & F.coalesce(norm < float("inf"), F.lit(False))
    rows = stored(df.select(F.col(key).alias("key"), F.col(group).cast("string").alias("grp"), v.alias("vec"),
                            ok.alias("ok")).withColumn("row", F.monotonically_increasing_id()), "ego-rows")
    good = rows.filter("ok")
    classes = stored(good.groupBy("grp", "vec").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("cid"),
                                                    F.min("key").alias("low"), F.size("vec").alias("dim")), "ego-classes")
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    axes = rotations(classes)
    kind = "grp string, dim int, cid long, n long, vec binary, " + ", ".join(f"{p} double" for p in P)
    grid = stored(classes.select("grp", "dim", "cid", "n", "vec").mapInArrow(
        _project(axes, eps), kind + ", " + ", ".join(f"{c} int" for c in C)), "ego-grid")
    blocks = cut_blocks(grid, ["grp", "dim", *C, "cid"], ["grp", "dim"], BLOCK)
    boxes = stored(blocks.groupBy("grp", "dim", "code").agg(
        *[F.min(p).alias(f"lo{j}") for j, p in enumerate(P)], *[F.max(p).alias(f"hi{j}") for j, p in enumerate(P)]),
        "ego-boxes")
    bits = max(1, int(boxes.agg(F.max("code")).first()[0] or 0).bit_length())
    pairs = block_pairs(boxes, eps, bits).filter("a < b").select("a", "b")
    found = stored(meet(blocks, blocks, pairs, ["cid", "n", "dim", "vec"], _join(cosine),
                        "cid long, links long, root long"), "ego-links")
    direct = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comp = components(found, "cid", "root").withColumnRenamed("node", "cid")
    per = stored(classes.join(direct, "cid", "left").join(comp, "cid", "left").select(
        "grp", "vec", "n", "low", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "cid").alias("component")), "ego-classes")
    lows = per.groupBy("component").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("size"))
    named = join_hot(per, stored(lows, "ego-lows"), ["component"], per.count(), "size").drop("size", "low", "component")
    out = join_hot(good, stored(named, "ego-named"), ["grp", "vec"], rows.count(), "n").select("key", "n_links", "component_id")
    alone = rows.filter("not ok").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return out.unionByName(alone).select(
        F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 0.93)


QUERIES = {"op6_embedding_near_dedup": op6_embedding_near_dedup}
