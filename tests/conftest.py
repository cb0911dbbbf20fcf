import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bidlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def planted(spark):
    """Three dense groups and a few far single points."""
    import numpy as np

    rng = np.random.default_rng(7)
    groups = [(0, 20, 2.0), (20, 15, -1.5), (35, 10, 0.5)]
    rows = []
    for start, n, shift in groups:
        rows += [(start + i, [float(v) for v in rng.normal(shift, 0.05, 12)]) for i in range(n)]
    rows += [(45 + i, [float(v) for v in rng.normal(0, 30, 12)]) for i in range(5)]
    return spark.createDataFrame(rows, "id long, vec array<double>")
