"""Queries with Python workers run from a folder where the package cannot be imported."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", {entry!r})
module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(module)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {work!r}).getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
for name in {names!r}:
    print(name, module.queries()[name](spark, {sf!r}).count())
"""
NAMES = [
    "gradient_covariance", "gradient_sensitivity", "active_subspace_errors", "active_subspace_sensitivity",
    "gaussian_process_errors", "gaussian_process_sensitivity",
]


def test_workers_need_no_copy_of_the_package(tmp_path, sf_dir):
    entry = str(Path(__file__).resolve().parents[1] / "__spark_entry__.py")
    text = SCRIPT.format(entry=entry, work=str(tmp_path / "work"), names=NAMES, sf=sf_dir)
    done = subprocess.run([sys.executable, "-c", text], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.split()[:1] and line.split()[0] in NAMES] == NAMES
