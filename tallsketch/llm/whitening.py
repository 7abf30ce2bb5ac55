"""Whitening of vectors by a bit-sliced scatter matrix.

Entries become integers x = floor(256 c).  The fit list holds every distinct x vector once.

1. Planes: a block of rows is shifted by its least entry per dimension, and each bit of a
   dimension is packed across the rows into 64-bit words.
2. Scatter: the cross-product of two shifted dimensions is the sum over their planes of
   2**(b + c) times the popcount of the AND of plane b and plane c; undoing the shifts in integers
   gives the exact sum of x_i x_j.  Tasks add their blocks up and return one row per pair of
   dimensions, however many rows they saw; Spark sums those.
3. Centring: n^2 V = n * sum(x x') - S S' in integers, divided once, then ``eigh``.  Only numbers
   of the model, two per pair of dimensions, reach the driver.
4. Rows are projected where they are; the whitened covariance is measured in a second pass over
   the fit list.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallsketch.llm.common import stored, table
from tallsketch.session import ship_package

#: Components returned.
COMPONENTS = 4
#: Sums of a task stay below this, then they are handed out and start from zero again.
ROOM = 1 << 62
#: Larger sums are handed out in digits of this base.
LIMB = 1 << 60
#: A component whose variance is below this share of the largest is not whitened.
RANK = 1e-12


def integers(vec: F.Column) -> F.Column:
    """x = floor(256 c); entries beyond the range of a long are held at its ends."""
    scaled = lambda c: F.lit(256.0) * c.cast("double")
    top = float(2**63)
    return F.transform(vec, lambda c: F.when(scaled(c) >= top, F.lit(2**63 - 1)).when(scaled(c) < -top, F.lit(-(2**63)))
                       .otherwise(F.floor(scaled(c)).cast("long")))


def finite(vec: F.Column) -> F.Column:
    whole = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(vec.isNotNull() & whole, F.lit(False))


def planes(y: np.ndarray) -> np.ndarray:
    """(bits, dims, words): the bit planes of the non-negative (rows, dims) ``y`` packed across rows."""
    bits = max(1, int(y.max()).bit_length())
    words = -(-len(y) // 64)
    out = np.zeros((bits, y.shape[1], words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((y >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=0)
        out[b, :, : len(packed)] = packed.T
    return out.view(np.uint64)


def shifted_scatter(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross-products (dims, dims) and sums (dims,) of the rows behind the planes ``p``, as
    integers: 64-bit ones where the sums fit, else Python's."""
    bits, dims, words = p.shape
    kind = np.int64 if words * 64 << (2 * bits) < ROOM else object
    flat = p.reshape(bits * dims, words)
    weight = lambda k: (1 << k) if kind is object else np.int64(1 << k)
    upper, own = np.zeros((dims, dims), kind), np.zeros(dims, kind)
    sums = np.zeros(dims, kind)
    for a in range(bits * dims):
        b, i = divmod(a, dims)
        counts = np.bitwise_count(flat[a] & flat[a:]).sum(axis=1, dtype=np.int64).astype(kind)
        sums[i] += counts[0] * weight(b)
        own[i] += counts[0] * weight(2 * b)
        counts[0] = 0
        padded = np.concatenate([np.zeros(i, kind), counts]).reshape(bits - b, dims)
        for c in range(bits - b):
            upper[i] += padded[c] * weight(2 * b + c)
    return upper + upper.T + np.diag(own), sums


def block_scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Exact (sum of x x', sum of x, largest absolute number in them) of the int64 rows ``x``."""
    low = x.min(axis=0)
    y = (x.view(np.uint64) - low.view(np.uint64)).astype(np.uint64)  # modulo 2**64 the difference is exact
    cross, sums = shifted_scatter(planes(y))
    rows, top = len(x), max(abs(int(x.max())), abs(int(x.min())), int(y.max()), 1)
    kind = np.int64 if 4 * rows * top * top < ROOM else object
    cross, sums, low = cross.astype(kind), sums.astype(kind), low.astype(kind)
    shift = np.outer(low, sums)
    return cross + shift + shift.T + rows * np.outer(low, low), sums + rows * low, 4 * rows * top * top


def _limbs(value: int) -> list[int]:
    out = []
    while not -LIMB < value < LIMB:
        value, low = divmod(value, LIMB)
        out.append(low)
    return out + [value]


def _scatter(batches):
    """Rows (dim, i, j, limb, value): i < j <= dim pairs of dimensions, and i = -1 for sums (and the
    count at j = -1).  One row per pair and task, unless the sums outgrow 64 bits."""
    acc: dict[int, list] = {}

    def rows(dim, cross, sums, count):
        i, j = np.triu_indices(dim)
        at = np.concatenate([i, np.full(dim, -1), [-1]]), np.concatenate([j, np.arange(dim), [-1]])
        values = np.concatenate([cross[i, j], sums, np.array([count], cross.dtype)])
        if values.dtype == object:
            spread = [(a, b, q, v) for a, b, x in zip(*at, values) for q, v in enumerate(_limbs(int(x)))]
            a, b, limb, values = (np.array(c, np.int64) for c in zip(*spread))
        else:
            (a, b), limb = at, np.zeros(len(values))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), dim, np.int32)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)),
             pa.array(limb.astype(np.int32)), pa.array(values.astype(np.int64))], names=["dim", "i", "j", "limb", "value"])

    for batch in batches:
        vec = batch.column(0)
        dims = np.diff(vec.offsets.to_numpy())
        flat, at = vec.values.to_numpy(zero_copy_only=False), vec.offsets.to_numpy()
        for dim in np.unique(dims):
            which = np.flatnonzero(dims == dim)
            cross, sums, bound = block_scatter(np.ascontiguousarray(flat[at[which][:, None] + np.arange(dim)]))
            held = acc.get(dim)
            if held and held[3] + bound >= ROOM:
                yield rows(dim, *held[:3])
                held = None
            if bound >= ROOM:
                yield rows(dim, cross.astype(object), sums.astype(object), len(which))
            elif held:
                acc[dim] = [held[0] + cross, held[1] + sums, held[2] + len(which), held[3] + bound]
                continue
            else:
                acc[dim] = [cross, sums, len(which), bound]
                continue
            acc.pop(dim, None)
    for dim, held in acc.items():
        yield rows(dim, *held[:3])


@dataclass(frozen=True)
class Model:
    """The fit of one vector length: count and sums as exact integers, ``axes`` (dims, components)
    and ``values`` by falling eigenvalue, the trace, and the whitened covariance's error."""
    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    error: float | None = None

    @property
    def scale(self) -> np.ndarray:
        """One over the standard deviation; NaN for a component without variance."""
        alive = self.values > RANK * max(self.values[0], 0.0) if len(self.values) else np.zeros(0, bool)
        return np.where(alive, 1 / np.sqrt(np.where(alive, self.values, 1.0)), np.nan)

    def project(self, x: np.ndarray) -> np.ndarray:
        """x - S/n on the components, over the standard deviations.  The mean is taken off in two
        parts, the nearest integers exactly, so it costs no digits."""
        near = np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)
        rest = np.array([(s - self.n * int(m)) / self.n for s, m in zip(self.sums, near)])
        return ((x - near).astype(float) - rest) @ (self.axes * self.scale)


def covariance(n: int, cross: list[list[int]], sums: list[int]) -> np.ndarray:
    """V from exact integers, centred before the one rounding of each entry."""
    d = len(sums)
    return np.array([[(n * cross[i][j] - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)])


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model per vector length from distinct vectors ``x`` (array of long)."""
    ship_package(vectors.sparkSession)
    parts = vectors.select("x").mapInArrow(_scatter, "dim int, i int, j int, limb int, value long")
    total = parts.groupBy("dim", "i", "j", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    exact: dict[int, dict] = {}
    for dim, i, j, limb, value in total.collect():  # a row per pair of dimensions
        at = exact.setdefault(dim, {})
        at[i, j] = at.get((i, j), 0) + (int(value) << (60 * limb))
    models = {}
    for dim, at in exact.items():
        n, sums = at[-1, -1], [at[-1, j] for j in range(dim)]
        cov = covariance(n, [[at[min(i, j), max(i, j)] for j in range(dim)] for i in range(dim)], sums)
        values, axes = np.linalg.eigh(cov)
        top = np.argsort(values, kind="stable")[::-1][:components]
        models[dim] = Model(n, tuple(sums), axes[:, top], values[top], float(np.trace(cov)))
    return models


def _blocks(batch: pa.RecordBatch, name: str):
    """(rows, dim, x) of each vector length in a batch."""
    vec = batch.column(name)
    at, flat = vec.offsets.to_numpy(), vec.values.to_numpy(zero_copy_only=False)
    dims = np.diff(at)
    for dim in np.unique(dims):
        which = np.flatnonzero(dims == dim)
        yield which, int(dim), flat[at[which][:, None] + np.arange(dim)].reshape(len(which), dim)


def measured(vectors: DataFrame, models: dict[int, Model]) -> dict[int, Model]:
    """The models with the largest entry of |covariance of the whitened fit list - identity|."""
    def sums(batches):
        acc: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, dim, x in _blocks(batch, "x"):
                z = models[dim].project(x)
                one = np.column_stack([np.ones(len(z)), z])
                acc[dim] = acc.get(dim, 0.0) + one.T @ one
        for dim, m in acc.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)),
                                              pa.array(j.astype(np.int32)), pa.array(m[i, j])], names=["dim", "i", "j", "value"])

    total = vectors.select("x").mapInArrow(sums, "dim int, i int, j int, value double").groupBy("dim", "i", "j").agg(F.sum("value"))
    found: dict[int, dict] = {}
    for dim, i, j, value in total.collect():
        found.setdefault(dim, {})[i, j] = value
    out = {}
    for dim, m in models.items():
        c = len(m.values)
        got = found[dim]
        # z is centred by S/n already: its own mean is rounding error, taken off all the same
        err = [abs(got[i, j] / m.n - got[0, i] * got[0, j] / m.n**2 - (i == j))
               for i in range(1, c + 1) for j in range(i, c + 1)]
        alive = [e for e in err if not np.isnan(e)]
        out[dim] = Model(m.n, m.sums, m.axes, m.values, m.trace, max(alive, default=0.0))
    return out


def deviations(x: np.ndarray, m: Model) -> list[int]:
    """Sum over dimensions of (n x - S)^2, exact: n^2 sum(x^2) - 2 n sum(x S) + sum(S^2), the
    inner sums in 64 bits where they fit."""
    top = max(abs(int(x.max())), abs(int(x.min())), 1)
    limit = ROOM // (x.shape[1] * top)
    square = [s * s for s in m.sums]
    if top >= limit:
        return [sum((m.n * int(v) - s) ** 2 for v, s in zip(row, m.sums)) for row in x]
    high = np.array([s >> 31 for s in m.sums], object)
    low = np.array([s & (2**31 - 1) for s in m.sums], np.int64)
    fits = all(abs(h) < limit for h in high) and 2**31 < limit
    norm = (x * x).sum(axis=1)
    if fits:
        dot = [(int(a) << 31) + int(b) for a, b in zip(x @ high.astype(np.int64), x @ low)]
    else:
        dot = [sum(int(v) * s for v, s in zip(row, m.sums)) for row in x]
    rest = sum(square)
    return [m.n * m.n * int(a) - 2 * m.n * d + rest for a, d in zip(norm, dot)]


def whiten(df: DataFrame, key: str, vec: str, components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: key, component (from 1 by falling variance), n (size of the
    fit list), deviation decimal(38,0), whitened, explained, identity_error.

    Null vectors and vectors with null or non-finite entries are dropped.  Vectors of each length
    are a list of their own; a length below ``components`` has only as many, empty vectors none.
    Repeated vectors count once in the fit, and each keeps its rows; null keys stay.  A component
    without variance (equal vectors) has a null ``whitened`` and is left out of identity_error;
    ``explained`` is null where the trace is zero.  Entries beyond a long are held at its ends; a
    deviation beyond 38 digits is null.  Other columns are not read; empty input gives no rows."""
    spark = df.sparkSession
    ship_package(spark)
    v = F.col(vec)
    rows = df.filter(finite(v) & (F.size(v) > 0)).select(F.col(key).alias("key"), integers(v).alias("x"))
    kind = df.schema[key].dataType
    vectors = stored(rows.select("x").distinct(), "whitening-fit")
    models = measured(vectors, fit(vectors, components))
    arrow_key = rows.select("key").limit(0).toArrow().schema.field("key").type
    widest = Decimal(10) ** 38

    def run(batches):
        for batch in batches:
            keys = batch.column("key")
            for which, dim, x in _blocks(batch, "x"):
                m = models[dim]
                z, c = m.project(x), len(m.values)
                dev = pa.array([d if abs(d) < widest else None for d in map(Decimal, deviations(x, m))], pa.decimal128(38, 0))
                again = np.repeat(np.arange(len(which)), c)
                share = m.values / m.trace if m.trace > 0 else np.full(c, np.nan)
                cells = len(again)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(which[again])).cast(arrow_key), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(which))),
                     pa.array(np.full(cells, m.n, np.int64)), dev.take(pa.array(again)),
                     pa.array(z.reshape(-1), mask=np.isnan(z.reshape(-1))),
                     pa.array(np.tile(share, len(which)), mask=np.isnan(np.tile(share, len(which)))),
                     pa.array(np.full(cells, m.error))],
                    names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    shape = (f"key {kind.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, "
             "explained double, identity_error double")
    return rows.mapInArrow(run, shape).withColumnRenamed("key", key)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deviation as a long, as asked; null where it does not fit (the operator's decimal has it)."""
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn(
        "deviation", F.col("deviation").try_cast("long"))


QUERIES = {"op12_embedding_whitening": op12_embedding_whitening}
