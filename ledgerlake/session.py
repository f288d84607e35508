"""Session defaults and helpers that depend on the running session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def make_session(name: str = "ledgerlake", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.appName(name)
        .master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    )
    if master.startswith("local["):  # one process: as many partitions as threads; a cluster keeps its own or Spark's default
        threads = master[6:-1].split(",")[0]
        builder = builder.config("spark.sql.shuffle.partitions", str(os.cpu_count() or 8) if threads == "*" else threads)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship_package(spark)


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the package to the Python workers, once a context, wherever the driver runs from."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerlake_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    home = os.path.dirname(root)
    if home not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        at = tempfile.mkdtemp(prefix="ledgerlake-package-")  # the driver serves it from here
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        path = os.path.join(at, "ledgerlake.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, files in os.walk(root):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.relpath(full, home))
        sc.addPyFile(path)
    sc._ledgerlake_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset and
    everything runs in one process (tests, local mode) an own folder is made, and it is used for
    checkpoints from then on.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="ledgerlake-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop file system of a path, and its path class."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for intermediate tables; removed when the driver ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, path = file_system(spark, at)
    fs.mkdirs(path(at))
    fs.deleteOnExit(path(at))
    return at


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of a plan; runs no job. None where it has none (after a checkpoint)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def buckets_for(*dfs: DataFrame, target_mb: float = 8.0, rows: int = 0, target_rows: int = 100_000, each: int = 1) -> int:
    """Number of hash buckets so that one holds about ``target_mb`` of estimated input, or
    ``target_rows`` of ``rows`` already counted. At least ``each`` a shuffle partition."""
    spark = dfs[0].sparkSession
    least = each * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    size = sum(plan_bytes(d) or 0 for d in dfs)
    return int(max(least, size / (target_mb * 1e6), rows / target_rows))


def spread(df: DataFrame) -> DataFrame:
    """Even partitions for work that is heavy per row, where the scan gives fewer than two a core.

    Large inputs are split finely enough by the scan and are left as they are.
    """
    wanted = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
