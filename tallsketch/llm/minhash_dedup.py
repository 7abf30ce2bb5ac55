"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A document's set is its distinct shingles of five words.  ``SYMBOLS`` minima of 16 bits make its
signature; two sets of Jaccard similarity J differ in a symbol with probability 1 - J.  The
signature threshold (``distance_of``) is the smallest distance that a pair just at the similarity
threshold exceeds with probability below ``MISS`` (a closer pair hardly ever does).

Pigeonhole: of more chunks than half the distance (``chunks_of``), a pair within it has one with
at most one error, so the chunk agrees in all symbols but one.  Each chunk is
entered once per symbol that may be wrong, with that symbol left out: all pairs within the
distance share an entry, for sure.  Entries with the same members are merged; members are
compared by whole signatures, entry by entry in blocks, and what hangs together is a cluster of candidates.
Inside the clusters, links are confirmed on the full sets.

Documents with equal sets are one class throughout.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallsketch.llm.blocks import linked_groups, smallest
from tallsketch.llm.common import components, free_name, join_hot, located, small, stored, table
from tallsketch.session import ship_package

WORDS = 5
SYMBOLS = 64
#: Probability that the signatures of a pair just at the similarity threshold are too far apart.
MISS = 1e-5


def distance_of(percent: int) -> int:
    """Signature threshold for a similarity of ``percent``: a pair just at it differs in a
    binomial number of symbols."""
    p, tail, d = 1 - percent / 100, 0.0, SYMBOLS
    while d and (more := tail + math.comb(SYMBOLS, d) * p**d * (1 - p) ** (SYMBOLS - d)) < MISS:
        tail, d = more, d - 1
    return d


def chunks_of(distance: int) -> int:
    """Chunks of which one has at most one of ``distance`` errors."""
    return distance // 2 + 1


#: Link when percent * (size of the union) <= 100 * (size of the intersection); op3's percent.
PERCENT = 85
DISTANCE = distance_of(PERCENT)
CHUNKS = chunks_of(DISTANCE)
#: Members of a block of signatures; documents and shingles of a block of sets.
SIGNATURES, SETS, SHINGLES = 4096, 256, 300_000
#: Rows of an entry within a block compared pair by pair; rows compared with all first in larger ones.
FEW, PIVOTS = 16, 4
#: Shingles of a set in one row.
PIECE = 1024
_LAST = 2**63 - 1

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_FACTORS = np.random.default_rng(20).integers(0, 2**31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ORDER = np.random.default_rng(21).integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_WORDS) > 500_000:
        _WORDS.clear()
    for w in set(words).difference(_WORDS):
        _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    out = np.full(n, min(len(h), WORDS), np.uint64)
    for j in range(min(WORDS, len(h))):
        out = mix(out + h[j : j + n] * _ORDER[j])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """SYMBOLS minima of a non-empty set, 16 bits each."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(SYMBOLS, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096, None] * _FACTORS
        np.minimum(low, part.min(axis=0), out=low)
    return mix(low.astype(np.uint64)).astype(np.uint16)


def class_id(s: np.ndarray) -> int:
    """64 bits of the set: documents with equal sets are one class."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


def _chunks(chunks: int) -> list[np.ndarray]:
    return np.array_split(np.arange(SYMBOLS), chunks)


def entries(sigs: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """(rows, SYMBOLS) 64-bit entries: for each chunk and each of its symbols, the others."""
    wide, cols = sigs.astype(np.uint64), []
    for c, chunk in enumerate(_chunks(chunks)):
        for skip in chunk:
            key = np.full(len(sigs), np.uint64(c * 1000 + skip))
            for j in chunk:
                if j != skip:
                    key = mix(key + wide[:, j] * np.uint64(0x9E3779B97F4A7C15))
            cols.append(key)
    return np.column_stack(cols)


def _sign(batches):
    for b in batches:
        cid, n, sig = [], [], []
        for t in b.column("text"):
            s = shingles(t.as_py())
            n.append(len(s))
            cid.append(class_id(s) if len(s) else None)
            sig.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc"), b.column("row"), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(sig, pa.binary())],
            names=["doc", "row", "n", "cid", "sig"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _enter(chunks: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            e = entries(_matrix(b.column("sig")), chunks)
            cid = b.column("cid").to_numpy()
            for at in range(0, len(e), 2000):
                part = e[at : at + 2000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.ravel().view(np.int64)), pa.array(np.repeat(cid[at : at + 2000], SYMBOLS))],
                    names=["entry", "cid"])
    return run


def _pack_signatures(slices):
    return (*(np.concatenate([s.column(n).to_numpy() for s in slices]) for n in ("cid", "entry")),
            np.concatenate([_matrix(s.column("sig")) for s in slices]))


def _close_signatures(a, b, distance):
    """Links within ``distance`` among the rows of two blocks (or one) that share an entry: all of
    small entries, and of large ones enough to connect what all of them connect."""
    entry, sig = (a[1], a[2]) if a is b else (np.concatenate([a[k], b[k]]) for k in (1, 2))
    order = np.argsort(entry, kind="stable")
    sorted_entry = entry[order]
    edge = np.flatnonzero(np.diff(sorted_entry)) + 1
    start, stop = np.append(0, edge), np.append(edge, len(entry))
    few = np.repeat(stop - start <= FEW, stop - start)
    i, j = [], []
    for d in range(1, FEW):
        at = np.flatnonzero((sorted_entry[d:] == sorted_entry[:-d]) & few[d:])
        for s in range(0, len(at), 100_000):
            x, y = order[at[s : s + 100_000]], order[at[s : s + 100_000] + d]
            near = (sig[x] != sig[y]).sum(axis=1) <= distance
            i.append(x[near])
            j.append(y[near])
    for s, t in zip(start, stop):
        if t - s > FEW:
            rows = order[s:t]
            for x, y in _connect(sig[rows], distance):
                i.append(rows[x])
                j.append(rows[y])
    return (np.concatenate(i), np.concatenate(j)) if i else (np.empty(0, np.int64),) * 2


def _connect(sig, distance):
    """Links that connect what all links within ``distance`` connect: a few rows are compared with
    all, then every row outside the largest component so far with all."""
    links, left = [], np.arange(len(sig))
    for _ in range(PIVOTS):
        if len(left):
            near = np.flatnonzero((sig != sig[left[0]]).sum(axis=1) <= distance)
            links.append((np.full(len(near), left[0]), near))
            left = np.setdiff1d(left, near, assume_unique=True)
    low = smallest(*(np.concatenate(k) for k in zip(*links)), len(sig))
    outside = np.flatnonzero(low != np.bincount(low).argmax())
    # unrelated rows differ in nearly all of the first symbols and are beyond the distance already
    first, there = distance + 3, np.ascontiguousarray(sig.T)
    for at in range(0, len(outside), 512):
        mine = outside[at : at + 512]
        d = np.zeros((len(mine), len(sig)), np.uint8)
        for k in range(first):
            d += there[k][mine][:, None] != there[k][None, :]
        x, y = np.nonzero(d <= distance)
        for s in range(0, len(x), 200_000):
            u, v = x[s : s + 200_000], y[s : s + 200_000]
            near = d[u, v] + (sig[mine[u], first:] != sig[v, first:]).sum(axis=1) <= distance
            links.append((mine[u[near]], v[near]))
    return links


def _sets(batches):
    for b in batches:
        cid, n, piece, data = [], [], [], []
        for t in b.column("text"):
            s = shingles(t.as_py())
            for k, at in enumerate(range(0, len(s), PIECE)):
                cid.append(class_id(s))
                n.append(len(s))
                piece.append(k)
                data.append(s[at : at + PIECE].tobytes())
        if cid:
            yield pa.RecordBatch.from_arrays(
                [pa.array(cid, pa.int64()), pa.array(n, pa.int64()), pa.array(piece, pa.int32()), pa.array(data, pa.binary())],
                names=["cid", "size", "piece", "part"])


def _pack_sets(slices):
    """(keys, set sizes, all shingles, owner of each shingle); the stream is sorted by key and piece."""
    cid, part = (sum((s.column(n).to_pylist() for s in slices), []) for n in ("cid", "part"))
    keys, owner = np.unique(np.array(cid, np.int64), return_inverse=True)
    values = np.frombuffer(b"".join(part), np.uint64)
    owner = np.repeat(owner, [len(p) // 8 for p in part])
    return keys, np.bincount(owner, minlength=len(keys)), values, owner


def _similar_sets(a, b, percent):
    """Exact: intersections are counted over the shingles that occur on both sides."""
    common = np.intersect1d(a[2], b[2]) if a is not b else None
    if common is None:
        values, counts = np.unique(a[2], return_counts=True)
        common = values[counts > 1]
    both = np.zeros((len(a[0]), len(b[0])), np.float32)
    places = []
    for side in (a, b):
        at = np.minimum(np.searchsorted(common, side[2]), max(len(common) - 1, 0))
        ok = common[at] == side[2] if len(common) else np.zeros(len(side[2]), bool)
        order = np.argsort(at[ok], kind="stable")
        places.append((at[ok][order], side[3][ok][order]))
    for begin in range(0, len(common), 2048):
        dense = []
        for (at, owner), side in zip(places, (a, b)):
            s, e = np.searchsorted(at, [begin, begin + 2048])
            m = np.zeros((len(side[0]), 2048), np.float32)
            m[owner[s:e], at[s:e] - begin] = 1
            dense.append(m)
        both += dense[0] @ dense[1].T
    inter = both.astype(np.int64)
    return 100 * inter >= percent * (a[1][:, None] + b[1][None, :] - inter)


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: key (long), n_shingles, component_id, kept.

    Documents whose sets have a similarity of ``percent`` or more in a hundred are linked.

    Null and empty texts have no shingles and link with nothing.  The component is the smallest
    key reachable by links; documents with equal sets are linked.  Rows of a repeated key are
    documents of their own; of those with the smallest key of a component, one is kept.  A null
    key comes after all others, so it names a component (null) only of documents without keys.
    Other columns are not read; empty input gives no rows."""
    place = free_name(docs, "_row")
    return _components(located(docs, place), place, key, text, percent).select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"), "component_id", "kept")


def _components(docs: DataFrame, place: str, key: str, text: str, percent: int) -> DataFrame:
    """(doc, row, n, component_id, kept)"""
    distance = distance_of(percent)
    ship_package(docs.sparkSession)
    whole = docs.select(F.col(key).cast("long").alias("doc"), F.col(place).alias("row"), F.col(text).alias("text"))
    order = F.struct(F.coalesce("doc", F.lit(_LAST)).alias("ord"), "row")
    signed = stored(whole.mapInArrow(_sign, "doc long, row struct<file: long, row: long>, n long, cid long, sig binary"),
                    "minhash-signed")
    classes = stored(signed.filter("cid is not null").groupBy("cid").agg(
        F.min(order).alias("low"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig")), "minhash-classes")
    entered = classes.select("cid", "sig").mapInArrow(_enter(chunks_of(distance)), "entry long, cid long")
    # one entry for each set of members
    shared = (
        entered.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("a"), F.max("cid").alias("b"),
                                     F.bit_xor(F.xxhash64("cid")).alias("x"))
        .filter("n > 1").groupBy("n", "a", "b", "x").agg(F.min("entry").alias("entry")).select("entry")
    )
    members = entered.join(small(stored(shared, "minhash-entries")), "entry").join(classes.select("cid", "sig"), "cid")
    clusters = components(
        linked_groups(stored(members, "minhash-members"), "entry", "cid", ["sig"], _pack_signatures,
                      partial(_close_signatures, distance=distance), SIGNATURES),
        "u", "v")
    inside = stored(clusters.select(F.col("node").alias("cid"), F.col("component").alias("cluster"))
                    .join(classes.select("cid", "low"), "cid"), "minhash-clusters")
    # the sets of one document per class, from its whole text
    chosen = whole.join(small(stored(inside.select(F.col("low.row").alias("row")), "minhash-docs")), "row", "left_semi")
    sets = (chosen.select("text").mapInArrow(_sets, "cid long, size long, piece int, part binary")
            .join(inside.select("cid", "cluster"), "cid"))
    links = linked_groups(
        sets.select("cluster", "cid", "piece", F.least("size", F.lit(PIECE).cast("long")).alias("weight"), "part"),
        "cluster", "cid", ["piece", "part"], _pack_sets, partial(_similar_sets, percent=percent), SETS, "weight", SHINGLES, ["piece"])
    named = components(links, "u", "v")
    per = stored(classes.select("cid", "low", "copies").join(named.withColumnRenamed("node", "cid"), "cid", "left")
                 .withColumn("component", F.coalesce("component", "cid")), "minhash-per-class")
    lows = stored(per.groupBy("component").agg(F.min("low").alias("first"), F.count(F.lit(1)).alias("size")), "minhash-lows")
    final = stored(join_hot(per, lows, ["component"], per.count(), "size").select("cid", "copies", "first"), "minhash-final")
    linked = join_hot(signed.filter("cid is not null").select("doc", "row", "n", "cid"), final, ["cid"], signed.count(), "copies")
    alone = signed.filter("cid is null").select("doc", "row", "n", F.col("doc").alias("component_id"), F.lit(True).alias("kept"))
    return linked.select("doc", "row", "n", F.when(F.col("first.ord") != _LAST, F.col("first.ord")).alias("component_id"),
                         (F.col("row") == F.col("first.row")).alias("kept")).unionByName(alone)


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents that stay, one per component, with all their columns, whatever their names."""
    place = free_name(docs, "_row")
    rows = located(docs, place)
    gone = stored(_components(rows, place, key, text, percent).filter("not kept").select(F.col("row").alias(place)), "minhash-gone")
    return rows.join(small(gone), place, "left_anti").drop(place)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


QUERIES = {"op3_minhash_near_dedup": op3_minhash_near_dedup}
