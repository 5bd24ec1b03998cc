"""Folds must run where the package is not importable by the Python workers."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as entry
print("rows", entry.entry(spark).count())
print("rows", entry.queries()["store_balance_segmented"](spark, entry.SMALLEST).count())
spark.stop()
"""


def test_entry_runs_from_another_folder(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=environment,
                          capture_output=True, text=True, timeout=600)
    assert done.stdout.split() == ["rows", "1000", "rows", "1000"], done.stderr[-3000:]
