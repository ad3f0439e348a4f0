import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from wattsift.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "wattsift-tests", "local[8]", 8,
        {"spark.ui.enabled": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="wattsift-tests-")})
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="wattsift-tests-")


@pytest.fixture
def values(spark):
    """Evaluate an expression over the rows of a one-column frame."""

    def run(rows, kind, make):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
        return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]

    return run
