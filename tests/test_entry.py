import os
import subprocess
import sys

from conftest import ROOT

SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry_module", sys.argv[1])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "4").getOrCreate()
print("rows", entry.entry(spark).count(), entry.queries()["T2_ordered_gate"](spark, "/root/testdata/sf0.001").count())
"""


def test_entry_runs_from_another_folder(tmp_path):
    """Workers do not have the package on their path, as on a cluster where it is not installed."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    command = [sys.executable, "-c", SCRIPT, os.path.join(ROOT, "__spark_entry__.py")]
    done = subprocess.run(command, cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    rows = [line.split()[1:] for line in done.stdout.splitlines() if line.startswith("rows")]
    assert rows and all(int(n) > 0 for n in rows[0]), done.stderr[-3000:]


def test_every_query_has_sql():
    import __spark_entry__ as entry
    from sparksymbols.plans import QUERIES

    assert QUERIES.keys() <= entry.oracle_sql().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
