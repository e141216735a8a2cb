"""The driver contract works when the entry file is loaded by path from another directory
(executors then cannot import the package; task functions must travel by value)."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry_mod", {os.path.join(ROOT, "__spark_entry__.py")!r})
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").getOrCreate())
assert m.entry(spark).count() >= 0
qs, ors = m.queries(), m.oracle_sql()
assert set(ors) <= set(qs)
print("rows", qs["nth_state"](spark, "/root/testdata/sf0.001").count(),
      qs["describe_item"](spark, "/root/testdata/sf0.001").count())
"""


def test_entry_from_foreign_cwd(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True,
                         timeout=600)
    assert out.returncode == 0, out.stderr[-3000:]
    assert "rows" in out.stdout
