"""Executors must not need the package on their path (driver cwd elsewhere)."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()
import __spark_entry__ as E
print('ROWS', E.queries()['knn_peers'](s, '/root/testdata/sf0.001').count())
"""


def test_knn_runs_from_another_working_directory(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=str(tmp_path), env=env, capture_output=True, text=True,
                       timeout=600)
    assert "ROWS" in r.stdout, r.stderr[-2000:]
    assert int(r.stdout.split("ROWS")[1].split()[0]) > 0
