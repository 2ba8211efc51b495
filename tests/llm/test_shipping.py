"""Every query runs where the workers cannot import the package: only the driver has a path to it."""
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from logsieve.llm.queries import QUERIES
from logsieve.session import checkpoint_dir, get_spark
spark = get_spark("local[4]", 4)
checkpoint_dir(spark)
for name, query in QUERIES.items():
    print("ran", name, query(spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_queries_without_the_package_on_the_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")}
    run = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    done = {x.split()[1] for x in run.stdout.splitlines() if x.startswith("ran ")}
    from logsieve.llm.queries import QUERIES
    assert done == set(QUERIES), run.stderr[-2000:]
