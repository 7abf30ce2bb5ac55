"""Sinks: solutions and timings (S5), the factor cache (S6), peeking."""

from __future__ import annotations

import hashlib
import importlib.util
import inspect
import os
import sys
import time
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallsketch.sources.matrix import MatrixFrame

CACHE_VERSION = 3


def write_result(result, uri: str, fmt: str = "parquet") -> None:
    """``{uri}/solutions`` (trial, iter, x), ``{uri}/metrics`` (stage, elapsed_s) and,
    for LSQR, ``{uri}/history``.  ``fmt='json'`` writes JSON lines instead."""
    writer = (lambda df, p: df.write.mode("overwrite").parquet(p)) if fmt == "parquet" else \
        (lambda df, p: df.write.mode("overwrite").json(p))
    writer(result.solutions, f"{uri}/solutions")
    writer(result.metrics, f"{uri}/metrics")
    if result.history is not None:
        writer(result.history.to_frame(result.solutions.sparkSession), f"{uri}/history")


def write_errors(errors: DataFrame, uri: str, fmt: str = "parquet") -> None:
    """The accuracy report of a job: ``{uri}/errors`` (cand, iter, x_relerr, f_relerr)."""
    errors.write.mode("overwrite").format(fmt).save(f"{uri}/errors")


def read_errors(spark: SparkSession, uri: str) -> DataFrame:
    return spark.read.parquet(f"{uri}/errors")


def read_solutions(spark: SparkSession, uri: str) -> DataFrame:
    return spark.read.parquet(f"{uri}/solutions")


def head(mf: MatrixFrame, k: int = 10) -> DataFrame:
    """The first k rows by key (distributed top-k); no full collect is offered."""
    return mf.df.orderBy("key").limit(int(k))


# ----------------------------------------------------------------------------- factor cache

def file_states(spark: SparkSession, roots: list[str]) -> str:
    """Digest of (path, length, modification time) of every file below ``roots``: one Spark job
    over the listing, which opens no file and brings one row to the driver."""
    if not roots:
        return ""
    state = F.xxhash64("path", "length", "modificationTime")
    row = spark.read.format("binaryFile").load(sorted(set(roots))).agg(
        F.count(F.lit(1)).alias("files"), F.sum(state.cast("decimal(38,0)")).alias("digest"),
        F.bit_xor(state).alias("parity"), F.sum("length").alias("bytes")).first()
    return "|".join(map(str, row))


def source_state(df: DataFrame) -> str | None:
    """What ``df`` is read from, persisted or not: the state of the files below its relations.
    None when a leaf of its plan is neither files nor a range, so the rows have no known origin."""
    roots: list[str] = []
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        kind = leaf.getClass().getSimpleName()
        if kind == "Range":
            continue
        if kind != "LogicalRelation" or leaf.relation().getClass().getSimpleName() != "HadoopFsRelation":
            return None
        paths = leaf.relation().location().rootPaths()
        roots += [paths.apply(i).toString() for i in range(paths.size())]
    return file_states(df.sparkSession, roots)


#: Plan nodes and expressions that run code Spark keeps no text of.
OPAQUE = {"ScalaUDF", "ScalaAggregator", "MapElements", "MapPartitions", "TypedFilter", "AppendColumns", "MapGroups",
          "FlatMapGroupsWithState", "CoGroup", "ScriptTransformation"}


def _file_digest(module: str) -> str | None:
    spec = importlib.util.find_spec(module)
    if spec is None or not spec.origin or not os.path.exists(spec.origin):
        return None
    with open(spec.origin, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _function_code(function) -> str | None:
    """Digest of a Python function of a plan: its pickled bytes, which hold the code and the values it
    closes over, and the file of the module if the bytes only name it.  None when it reads a
    broadcast variable, whose value the plan does not hold, or its module's file is not found."""
    if not function.broadcastVars().isEmpty():
        return None
    raw = bytes(int(v) & 255 for v in function.command().mkString(",").split(","))
    code = hashlib.sha256(raw).hexdigest()
    try:
        loaded = cloudpickle.loads(raw)
    except Exception:  # made by another session: the bytes alone
        return code
    for f in loaded if isinstance(loaded, tuple) else (loaded,):
        f = inspect.unwrap(f) if callable(f) else None
        module = getattr(f, "__module__", None)
        if module and module != "__main__" and hasattr(sys.modules.get(module), getattr(f, "__qualname__", "").split(".")[0] or " "):
            at = _file_digest(module)
            if at is None:
                return None
            code += at
    return code


def plan_code(df: DataFrame) -> list[str] | None:
    """Digests of the Python functions in the analyzed plan of ``df``, whose text holds only their
    names.  None when the plan runs code that cannot be told from other code of the same name."""
    out: list[str] = []
    todo = [(df._jdf.queryExecution().analyzed(), True)]
    while todo:
        node, is_plan = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind in OPAQUE:
            return None
        if not is_plan and kind.startswith("Python"):
            code = _function_code(node.func())
            if code is None:
                return None
            out.append(code)
        below = [(node.children(), is_plan)]
        if is_plan:
            below += [(node.expressions(), False), (node.subqueries(), True)]
        todo += [(found.apply(k), plan) for found, plan in below for k in range(found.size())]
    return sorted(out)


def fingerprint(mf: MatrixFrame, params, objective: str) -> str | None:
    """Identity of a factor: the analyzed input plan, the state of its input files and every
    parameter that changes N.  Needs no pass over the rows.  None when the origin of the rows
    is unknown (rows of a local collection or an RDD), or the code that makes them: such factors
    are never cached."""
    # a matrix whose plan was cut carries the state of the files it was read from
    files = mf.meta.get("source") or source_state(mf.df)
    if files is None:
        return None
    code = plan_code(mf.df)
    if code is None:
        return None
    # The canonicalized analyzed plan (expression ids normalized) is the same text in every
    # session; Dataset.semanticHash is not stable across sessions.
    plan = hashlib.sha256(mf.df._jdf.queryExecution().analyzed().canonicalized().toString().encode()).hexdigest()
    parts = [str(CACHE_VERSION), mf.name, str(plan), ",".join(code), files, str(mf.n), objective,
             str(params.sketch), str(params.kind), str(params.c),
             str(params.s) if params.sketch == "sampling" else "-",  # s does not change a projection N
             str(params.trials), str(params.seed)]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:32]


def save_factors(spark: SparkSession, uri: str, fp: str, factors: dict[int, np.ndarray], elapsed_s: float) -> None:
    """Each save is a set of its own below ``fp=...``, which counts once Spark has marked it complete;
    no set is ever written over, so a reader never sees half of one."""
    rows = [(int(t), int(i), int(j), float(N[i, j])) for t, N in factors.items()
            for i in range(N.shape[0]) for j in range(N.shape[1])]
    df = spark.createDataFrame(rows, "trial int, i int, j int, value double").withColumn("elapsed_s", F.lit(float(elapsed_s)))
    df.coalesce(1).write.parquet(f"{uri.rstrip('/')}/fp={fp}/set-{uuid.uuid4().hex}")


def complete_sets(spark: SparkSession, uri: str, fp: str) -> list[str]:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{uri.rstrip('/')}/fp={fp}/set-*/_SUCCESS")
    found = done.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(done)
    return sorted(f.getPath().getParent().toString() for f in found or [])


def load_factors(spark: SparkSession, uri: str, fp: str) -> tuple[dict[int, np.ndarray], float] | None:
    sets = complete_sets(spark, uri, fp)
    if not sets:
        return None
    rows = spark.read.parquet(sets[0]).collect()  # k n² numbers
    n = max(r["i"] for r in rows) + 1
    out: dict[int, np.ndarray] = {}
    for r in rows:
        out.setdefault(int(r["trial"]), np.zeros((n, n)))[r["i"], r["j"]] = r["value"]
    return out, float(rows[0]["elapsed_s"])


def cached_factors(mf: MatrixFrame, params, timings: dict, compute) -> dict[int, np.ndarray]:
    """Load N for (input, parameters) if cached and ``reuse``; else compute it, and write it
    if ``save``.  Load-only never writes, save-only never reads."""
    spark = mf.df.sparkSession
    fp = fingerprint(mf, params, "N")
    if params.reuse and fp:
        hit = load_factors(spark, params.factor_cache, fp)
        if hit is not None:
            timings["factor_cache_hit"] = hit[1]
            return hit[0]
    t = time.time()
    factors = compute(mf, params, timings)
    if params.save and fp:
        save_factors(spark, params.factor_cache, fp, factors, time.time() - t)
    return factors


def keep_factors(mf: MatrixFrame, params, factors: dict[int, np.ndarray], elapsed_s: float) -> None:
    """Save N that a low-precision solve has found on its way, for later solves."""
    fp = fingerprint(mf, params, "N")
    if fp:
        save_factors(mf.df.sparkSession, params.factor_cache, fp, factors, elapsed_s)
