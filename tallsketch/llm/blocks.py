"""Joins inside groups by blocks: rows are sorted, cut into blocks of bounded size, and pairs of
blocks meet in tasks that hold two blocks at a time.  No pair of rows is ever a row of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallsketch.llm.common import components, gathered, small, stored


def cut_blocks(rows: DataFrame, order: list[str], same: list[str], max_ids: int, weight: str | None = None,
               max_weight: int = 0, ordered: bool = True) -> DataFrame:
    """``rows`` sorted over all tasks by ``order``, with the block's ``code`` (ordered alike, unless
    ``ordered`` is off).

    Runs of ``max_ids`` ids or ``max_weight`` of ``weight`` are cut within each task; those that
    begin in the same ``max_ids`` ids and ``max_weight`` of all rows are one block, so the number
    of tasks does not make blocks small (ordered blocks with ``same`` end with their task).  A block has less than twice as many ids and, beyond its
    first id of each task, twice as much weight; a new one begins where a column of ``same``
    changes.  The last column of ``order`` is the id; rows of one id stay together."""
    key = order[-1]
    schema = rows.schema
    names = rows.columns
    places = ["_seq", "_ids", "_mass", "_all_ids", "_all_mass"]

    def run(batches):
        seq, ids, mass, at_ids, at_mass, last, group = -1, 0, 0, 0, 0, None, None
        for b in batches:
            out = np.empty((5, b.num_rows), np.int64)
            keys = b.column(key).to_pylist()
            groups = list(zip(*(b.column(n).to_pylist() for n in same))) if same else [None] * len(keys)
            weights = b.column(weight).to_pylist() if weight else [0] * len(keys)
            for k, now in enumerate(keys):
                if not ids or groups[k] != group or now != last:
                    if not ids or groups[k] != group or ids - at_ids == max_ids or (
                            weight and mass - at_mass + weights[k] > max_weight):
                        seq, at_ids, at_mass = seq + 1, ids, mass
                    ids, last, group = ids + 1, now, groups[k]
                mass += weights[k]
                out[:, k] = seq, at_ids, at_mass, ids, mass
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), b.column("_part"), *map(pa.array, out)],
                                             names=[*names, "_part", *places])

    # rows of one id must meet: the range is by every column of order, which equal ids share
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    cut = stored(ranged.mapInArrow(run, f"{kinds}, _part int, " + ", ".join(f"{p} long" for p in places)), "blocks")
    if same and ordered:
        bits = max(1, int(cut.agg(F.max("_seq")).first()[0] or 0).bit_length())
        return cut.select(*names, (F.shiftleft(F.col("_part").cast("long"), bits) + F.col("_seq")).alias("code"))
    # ids and weight before each task: one row per task
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(cut.groupBy("_part").agg(F.max("_all_ids").alias("i"), F.max("_all_mass").alias("m"))
                  .select("_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in "im")), "block-starts")
    code = F.floor((F.col("_ids") + F.col("_i")) / max_ids)
    if weight:
        code += F.floor((F.col("_mass") + F.col("_m")) / max_weight)
    code = F.xxhash64(*same, code) if same else code.cast("long")
    return cut.join(small(base), "_part").select(*names, code.alias("code"))


def meet(own: DataFrame, partners: DataFrame, pairs: DataFrame, columns: list[str],
         run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str,
         order: list[str] | None = None) -> DataFrame:
    """Run ``run`` over rows (a, b, *columns) sorted by a, b: for each block a its own rows with
    b = -1, then the rows of each partner block b of ``pairs`` (a, b)."""
    sent = own.select(F.col("code").alias("a"), F.lit(-1).cast("long").alias("b"), *columns).unionByName(
        pairs.join(partners.select(F.col("code").alias("b"), *columns), "b").select("a", "b", *columns))
    return sent.repartition("a").sortWithinPartitions("a", "b", *(order or [])).mapInArrow(run, schema)


def block_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[pa.RecordBatch]]]:
    """(a, b, slices) for each block of a sorted stream; one block is held at a time."""
    key, held = None, []
    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else []
        for s, e in zip(edge, [*edge[1:], len(a)]):
            if (a[s], b[s]) != key:
                if held:
                    yield *key, held
                key, held = (a[s], b[s]), []
            held.append(batch.slice(s, e - s))
    if held:
        yield *key, held


def smallest(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """Smallest node of each node's component, for links i - j among the nodes 0..size-1."""
    low = np.arange(size)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def ends(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of a boolean (rows, columns) matrix: rows are nodes 0.., columns follow them."""
    i, j = np.nonzero(link)
    return i, j + len(link)


def forest(link: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component, for a boolean link matrix as in ``ends``."""
    return smallest(*ends(link), sum(link.shape))


def linked_groups(rows: DataFrame, group: str, key: str, columns: list[str], pack, link, max_ids: int,
                  weight: str | None = None, max_weight: int = 0, order: list[str] | None = None) -> DataFrame:
    """(u, v) edges with the connected components of the graph ``link`` among the keys (long)
    that share a group; ``pack(slices)[0]`` are the keys of a block.  ``link(a, b)`` of two packed
    blocks is a boolean matrix, or two arrays of row numbers (those of b follow those of a) that
    connect whatever the links among the rows of a group connect.  Linked keys of different groups that meet may be joined too.

    First every block, in a task of its own, meets itself and the first block of each group it shares; in groups of
    three or more blocks, keys outside the group's largest component then meet all of its
    blocks.  So all pairs are compared, but for those already known to be connected, and a group
    that hangs together through its first block takes linear work.  At most one edge per key and
    block pair comes out."""
    def run_with(self_pairs: bool):
        def run(batches):
            own = None
            for _, b, slices in block_stream(batches):
                block = pack(slices)
                if b == -1:
                    own = block
                    if not self_pairs:
                        continue
                near = link(own, block)
                i, j = near if isinstance(near, tuple) else ends(near)
                if not len(i):
                    continue
                ids = np.concatenate([own[0], block[0]])
                root = ids[smallest(i, j, len(ids))]
                hit = np.flatnonzero(root != ids)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(root[hit])], names=["u", "v"])
        return run

    blocks = cut_blocks(rows, [group, key], [], max_ids, weight, max_weight)
    total = blocks.count()
    where = stored(gathered(blocks.groupBy(group, "code").agg(F.count(F.lit(1)).alias("n")), total), "group-blocks")
    spans = stored(gathered(where.groupBy(group).agg(F.min("code").alias("first"), F.count(F.lit(1)).alias("codes"))
                            .filter("codes > 1"), where.count()), "group-spans")
    to_first = where.join(spans, group).filter("code > first").select(F.col("code").alias("a"), F.col("first").alias("b"))
    cols = [group, key, *columns]
    edges = stored(meet(blocks, blocks, to_first.distinct(), cols, run_with(True), "u long, v long",
                        [key, *(order or [])]), "group-edges")
    large = spans.filter("codes > 2")
    if large.isEmpty():
        return edges
    known = stored(components(edges, "u", "v"), "group-known")
    # what is known as stars: whoever goes on from here need not find it again
    edges = known.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    inside = stored(blocks.select(group, key).distinct().join(large.select(group), group, "left_semi")
                    .join(known.withColumnRenamed("node", key), key, "left")
                    .withColumn("component", F.coalesce("component", key)), "group-inside")
    main = inside.groupBy(group, "component").agg(F.count(F.lit(1)).alias("n")).groupBy(group).agg(
        F.max(F.struct("n", "component"))["component"].alias("main"))
    left_out = stored(inside.join(main, group).filter("component <> main").select(group, key), "group-rest")
    if left_out.isEmpty():
        return edges
    some = cut_blocks(blocks.drop("code").join(left_out, [group, key], "left_semi"), [group, key], [group], max_ids,
                      weight, max_weight, ordered=False)
    pairs = some.select(group, F.col("code").alias("a")).distinct().join(
        where.select(group, F.col("code").alias("b")), group).select("a", "b").distinct()
    more = meet(some, blocks, pairs, cols, run_with(False), "u long, v long", [key, *(order or [])])
    return stored(edges.unionByName(more.distinct()), "group-edges")
