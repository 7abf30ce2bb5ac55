"""tallsketch: randomized least squares on very tall tables, Spark-first.

A *matrix* is any DataFrame with a unique row key, numeric features and a target
column.  The engine compresses it with mergeable random projections or leverage
sampling, solves the small problem, or uses the sketch as a preconditioner for a
distributed LSQR that costs one Spark aggregate per iteration for all trials.
"""

from tallsketch.sources.matrix import MatrixFrame, from_array, from_columns, read_text_matrix
from tallsketch.operators.sketch import sketch
from tallsketch.operators.small_solve import solve_sketch, exact_solve
from tallsketch.operators.lsqr import lsqr
from tallsketch.plans.solve import JobParams, SolveResult, run_job, solve

__all__ = [
    "MatrixFrame", "from_array", "from_columns", "read_text_matrix", "sketch",
    "solve_sketch", "exact_solve", "lsqr",
    "JobParams", "SolveResult", "run_job", "solve",
]
