import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tallsketch.session import local_session

    s = local_session("4", shuffle_partitions=8, app="tallsketch-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def to_numpy(mf):
    """Collect a SMALL test matrix ordered by key: (keys, A, b)."""
    import numpy as np

    rows = mf.to_array().df.orderBy("key").collect()
    keys = np.array([r["key"] for r in rows], dtype=np.int64)
    A = np.array([r["a"] for r in rows], dtype=float).reshape(len(rows), mf.n)
    b = np.array([r["b"] for r in rows], dtype=float)
    return keys, A, b
