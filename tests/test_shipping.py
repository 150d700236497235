"""Workers need not have the package: it reaches them with the job."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import os, sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from cohortlens.session import local_session
spark = local_session("2")
spark.sparkContext.setLogLevel("ERROR")
for name in ("knn_join_cells", "svm_rbf"):
    assert entry.queries()[name](spark, {sf!r}).count() > 0, name
print("workers ran")
"""


def test_queries_run_from_another_folder_without_pythonpath(sf, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=ROOT, sf=sf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600
    )
    assert "workers ran" in done.stdout, done.stderr[-3000:]
