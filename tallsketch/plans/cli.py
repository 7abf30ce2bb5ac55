"""Command-line job for ``spark-submit`` (options and defaults of the original least-squares job).

    spark-submit --py-files tallsketch.zip -m tallsketch.plans.cli DATA_URI --dims m n \\
        --high_precision --projection -p gaussian -r 200 -q 5 -k 3 -t --output URI

DATA_URI is a text matrix ``[A b]`` (any filesystem scheme) or, with ``--parquet``, a
Parquet table with ``--key``, ``--features`` and ``--target`` columns.  The known optimum
is read from ``--x-opt``/``--f-opt`` text files when given, else computed by TSQR.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from tallsketch.plans.solve import JobParams, run_job
from tallsketch.sources.matrix import from_columns, read_text_matrix, read_vector_text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallsketch", description="randomized least squares on Spark")
    p.add_argument("dataset", help="URI of the [A b] text matrix (or Parquet table with --parquet)")
    p.add_argument("--dims", metavar=("m", "n"), type=int, nargs=2, help="expected size of A (checked)")
    p.add_argument("--nrepetitions", type=int, default=1, help="stack the matrix vertically this many times")
    p.add_argument("--stack", type=int, default=1, choices=(1, 2), help="1: repeat every row; 2: only rows with nnz > 2")
    p.add_argument("--npartitions", type=int, default=None, help="hash-repartition the rows by key")
    p.add_argument("-c", "--cache", action="store_true", help="persist the rows between passes")
    g = p.add_mutually_exclusive_group()
    g.add_argument("--low-precision", "--low_precision", dest="precision", action="store_const", const="low", default="low")
    g.add_argument("--high-precision", "--high_precision", dest="precision", action="store_const", const="high")
    g = p.add_mutually_exclusive_group()
    g.add_argument("--projection", dest="sketch", action="store_const", const="projection")
    g.add_argument("--sampling", dest="sketch", action="store_const", const="sampling")
    p.add_argument("-p", dest="kind", default="gaussian", choices=("cw", "gaussian", "rademacher", "srdht"))
    p.add_argument("-r", dest="c", type=int, help="projection size")
    p.add_argument("-s", dest="s", type=int, help="sampling size")
    p.add_argument("-q", "--niters", dest="iters", type=int, help="LSQR iterations")
    p.add_argument("-k", "--ntrials", dest="trials", type=int, default=1)
    p.add_argument("-t", "--test", action="store_true", help="report relative errors")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--storage", default="MEMORY_AND_DISK", help="storage level of the persisted rows (e.g. DISK_ONLY)")
    p.add_argument("--output", default=None, help="URI for solutions/metrics/history (Parquet)")
    p.add_argument("--factor-cache", "--N-dir", dest="factor_cache", default=None, help="URI of the factor cache")
    p.add_argument("--load_N", action="store_true", help="reuse cached factors")
    p.add_argument("--save_N", action="store_true", help="write factors to the cache")
    p.add_argument("--x-opt", default=None)
    p.add_argument("--f-opt", default=None)
    p.add_argument("--text-key", default="line", choices=("line", "position", "first"),
                   help="row keys of a text matrix: global line number, scan position, or first number")
    p.add_argument("--parquet", action="store_true")
    p.add_argument("--key", default="key")
    p.add_argument("--features", default=None, help="comma-separated feature columns (Parquet input)")
    p.add_argument("--target", default="b")
    return p


def params_from_args(a) -> JobParams:
    if (a.load_N or a.save_N) and not a.factor_cache:
        raise ValueError("--load_N and --save_N need the URI of the factors (--factor-cache)")
    return JobParams(
        precision=a.precision, sketch=a.sketch, kind=a.kind, c=a.c, s=a.s, iters=a.iters, trials=a.trials,
        seed=a.seed, storage=a.storage, persist=a.cache,
        partitions=a.npartitions, expect_dims=tuple(a.dims) if a.dims else None, repeat=a.nrepetitions,
        stack="all" if a.stack == 1 else "dense", evaluate=a.test, output_uri=a.output,
        factor_cache=a.factor_cache if (a.load_N or a.save_N) else None, reuse=a.load_N,
        save=a.save_N or not a.load_N)


def main(argv=None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(argv)
    p = params_from_args(a)
    p.validate(*(a.dims or (None, None)))
    spark = spark or SparkSession.builder.appName("tallsketch").getOrCreate()
    if a.parquet:
        feats = a.features.split(",") if a.features else None
        if not feats:
            raise ValueError("--parquet needs --features")
        mf = from_columns(spark.read.parquet(a.dataset), a.key, feats, a.target, name=a.dataset)
    else:
        mf = read_text_matrix(spark, a.dataset, n=a.dims[1] if a.dims else None, key=a.text_key, name=a.dataset)
    if a.test and a.x_opt and a.f_opt:
        p.x_opt = read_vector_text(spark, a.x_opt)
        p.f_opt = read_vector_text(spark, a.f_opt)[0]
    res = run_job(spark, mf, p)
    summary = {"timings": {r["stage"]: r["elapsed_s"] for r in res.metrics.collect()}}
    if res.errors is not None:
        from tallsketch.operators.evaluate import median_low, median_trial

        med = median_low(res.errors) if p.precision == "low" else median_trial(res.errors)
        summary["median_errors"] = [r.asDict() for r in med.collect()]
    print(json.dumps(summary))
    return summary


if __name__ == "__main__":
    main()
