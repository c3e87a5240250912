"""Written intermediate results.

Iterative jobs and plans that read one intermediate result twice cut their
lineage by writing it as parquet below the folder named in
``spark.checkpoint.dir``, or below the warehouse where that is not set. That folder is
shared, so a lost executor costs only its own tasks, and a column-pruned second read
stays cheap.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_ROOTS: dict[str, str] = {}  # by application


def work_root(spark: SparkSession) -> str:
    """The application's own folder below the shared one; removed when the driver ends."""
    app = spark.sparkContext.applicationId
    if app in _ROOTS:
        return _ROOTS[app]
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    one_machine = master.startswith("local") and not master.startswith("local-cluster")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    if not root:
        root = tempfile.mkdtemp(prefix="tablewright-") if one_machine else spark.conf.get("spark.sql.warehouse.dir")
    root = f"{root.rstrip('/')}/tablewright-{app}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(hadoop)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    if not one_machine:
        root = fs.makeQualified(path).toString()  # a folder without a scheme is one for every machine
        if not _shared(spark, f"{root}/probe"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach; {root} is not")
    _ROOTS[app] = root
    return root


def _shared(spark: SparkSession, path: str) -> bool:
    """Whether the driver finds in a folder what tasks on all cores write there."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).write.mode("overwrite").parquet(path)
    return spark.read.schema("id bigint").parquet(path).count() == n


def work_path(spark: SparkSession, label: str) -> str:
    return f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared work folder and read it back."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._step_path = path
    return out


def bucketed(df: DataFrame, column: str, label: str = "step") -> DataFrame:
    """``df``, one row per value of ``column``, written in buckets of it: a join on the column
    then shuffles the other side alone."""
    spark = df.sparkSession
    path, name = work_path(spark, label), f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(n, column).dropDuplicates([column])
    rows.write.bucketBy(n, column).format("parquet").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._step_path, out._step_table = path, name
    return out


def discard(*steps: DataFrame) -> None:
    """Remove materialized steps that nothing reads any more."""
    for step in steps:
        spark = step.sparkSession
        if table := getattr(step, "_step_table", None):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(step._step_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps.

    It does so when the driver's JVM collects the objects that refer to them, which a
    driver with a large heap seldom does; long jobs of several written steps ask for it."""
    for _ in range(2):  # the first frees the frames, the second what they alone held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
