import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from conftest import ROOT, SF001

import __spark_entry__ as ENTRY

ROWS_ONLY = set()


def test_catalogue_keys_and_oracles():
    q, o = ENTRY.queries(), ENTRY.oracle_sql()
    assert set(o) <= set(q)
    own = set(ENTRY.catalogue.queries())
    assert own <= set(q) and own - set(o) == ROWS_ONLY


def test_entry_runs(spark):
    df = ENTRY.entry(spark)
    rows = df.collect()
    assert df.columns == ["trial", "x0", "x1", "x2"] and len(rows) == 1


def test_some_oracles_match_at_smallest_scale(spark):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    q, o = ENTRY.queries(), ENTRY.oracle_sql()
    for name in ("sketch_cw", "sketch_srdht", "ls_low_gaussian", "ls_high_cw", "leverage_sample", "gen_matrix"):
        df = q[name](spark, SF001)
        cols = df.columns
        got = sorted(tuple(r[c] for c in sorted(cols)) for r in df.collect())
        res = con.execute(o[name])
        ocols = [d[0] for d in res.description]
        want = sorted(tuple(r[ocols.index(c)] for c in sorted(cols)) for r in res.fetchall())
        assert sorted(ocols) == sorted(cols) and got == want, name


@pytest.mark.parametrize("gone", [["tallsketch/llm"], ["tallsketch/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_the_optional_modules(tmp_path, gone):
    """The solver's queries stay whatever of the text operators and their pipeline is missing."""
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "tallsketch"):
        at = os.path.join(ROOT, name)
        skip = shutil.ignore_patterns("__pycache__", *(["llm"] if "tallsketch/llm" in gone else []))
        if os.path.isdir(at):
            shutil.copytree(at, tmp_path / name, ignore=skip)
        elif os.path.exists(at) and name not in gone:
            shutil.copy(at, tmp_path / name)
    code = "import __spark_entry__ as e; print(len(set(e.catalogue.queries()) - set(e.queries())), len(e.oracle_sql()) > 50, 'pipeline' in e.queries())"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=300)
    assert out.stdout.split() == ["0", "True", "False"], out.stderr[-2000:]
