"""Task code must run where this package is not installed."""

import os
import subprocess
import sys
import tempfile

SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("contract", sys.argv[1])
contract = importlib.util.module_from_spec(spec)
spec.loader.exec_module(contract)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "Asia/Kolkata").getOrCreate()
for name in ("forest_scores", "autoencoder_scores", "autoencoder_encoding"):
    assert contract.queries()[name](spark, "/root/testdata/sf0.001").count() == 15, name
print("all ran")
"""


def test_models_run_without_the_package_on_the_workers():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    away = tempfile.mkdtemp(prefix="wattsift-tests-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" or root not in v}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, f"{root}/__spark_entry__.py"], cwd=away, env=env, capture_output=True,
        text=True, timeout=300)
    assert "all ran" in done.stdout, done.stderr[-2000:]
