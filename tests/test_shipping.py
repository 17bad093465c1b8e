"""Python workers find the package although the session starts somewhere else."""

from __future__ import annotations

import os
import subprocess
import sys

from conftest import SF_DIR

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import importlib.util, sys
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
entry.queries()["round_schedule"](spark, sys.argv[2])

def run(batches):
    from roundscope.functions import hashing
    for batch in batches:
        assert hashing.__name__
        yield batch

print("rows", spark.range(3).mapInArrow(run, "id bigint").count())
"""


def test_workers_import_the_package_from_an_empty_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", RUN, REPO, SF_DIR], cwd=tmp_path, env=env, capture_output=True,
        text=True, timeout=180,
    )
    assert "rows 3" in done.stdout, done.stderr[-2000:]
