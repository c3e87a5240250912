"""The shared work folder on a cluster, with every way to name it."""

import os
import subprocess
import sys

import pytest
from conftest import ROOT

RUN = """
import sys
from pyspark.sql import SparkSession
from tablewright import storage
folder, named, path = sys.argv[1:]
b = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "512m")
     .config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.warehouse.dir", folder + "/warehouse"))
if named == "setting":
    b = b.config("spark.checkpoint.dir", path)
spark = b.getOrCreate()
if named == "method":
    spark.sparkContext.setCheckpointDir(path)
out = storage.materialize(spark.range(0, 1000, 1, 5))
print("ROWS", out.count(), storage.work_root(spark))
spark.stop()
"""


@pytest.mark.parametrize(("named", "path", "below"), [
    ("setting", "{0}/shared", "{0}/shared/"), ("setting", "file://{0}/shared", "{0}/shared/"),
    ("method", "{0}/shared", "{0}/shared/"), ("none", "", "{0}/warehouse/"),
])
def test_cluster_folder(tmp_path, named, path, below):
    env = {**os.environ, "PYTHONPATH": ROOT, "PYSPARK_PYTHON": sys.executable, "SPARK_CONF_DIR": str(tmp_path)}
    args = [sys.executable, "-c", RUN, str(tmp_path), named, path.format(tmp_path)]
    done = subprocess.run(args, cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    found = [line.split() for line in done.stdout.splitlines() if line.startswith("ROWS")]
    assert found, done.stderr[-2000:]
    assert found[0][1] == "1000"
    assert found[0][2].removeprefix("file:").startswith(below.format(tmp_path))


def test_folder_that_is_not_shared_is_refused(tmp_path):
    script = RUN.replace("out = storage.mat", "storage._shared = lambda *a: False\nout = storage.mat")
    env = {**os.environ, "PYTHONPATH": ROOT, "PYSPARK_PYTHON": sys.executable, "SPARK_CONF_DIR": str(tmp_path)}
    args = [sys.executable, "-c", script, str(tmp_path), "setting", str(tmp_path / "own")]
    done = subprocess.run(args, cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode and "a folder every executor can reach" in done.stderr


QUERIES = """
import sys
from pyspark.sql import SparkSession
folder, path, data = sys.argv[1:]
b = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "512m")
     .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
     .config("spark.sql.warehouse.dir", folder + "/warehouse"))
spark = (b.config("spark.checkpoint.dir", path) if path else b).getOrCreate()
import __spark_entry__
for name in ("copy_structure", "copy_table", "lookup_pipeline", "read_json_rows", "snapshot_tables", "stream_upsert_sink"):
    print("ROWS", name, __spark_entry__.queries()[name](spark, data).count())
spark.stop()
"""


@pytest.mark.parametrize("path", ["{0}/shared", ""])
def test_queries_that_write_steps_end_on_a_cluster(tmp_path, path):
    env = {**os.environ, "PYTHONPATH": ROOT, "PYSPARK_PYTHON": sys.executable, "SPARK_CONF_DIR": str(tmp_path)}
    args = [sys.executable, "-c", QUERIES, str(tmp_path), path.format(tmp_path), "/root/testdata/sf0.001"]
    done = subprocess.run(args, cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    found = [line.split() for line in done.stdout.splitlines() if line.startswith("ROWS")]
    assert len(found) == 6, done.stderr[-2000:]
    assert all(int(n) > 0 for _, _, n in found)
