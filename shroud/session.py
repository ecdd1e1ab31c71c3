"""Spark session helpers: local test sessions and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "shroud") -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SHROUD_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``)."""
    return ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use ``spark.checkpoint.dir`` when the cluster names one.

    Only a local-mode session (tests, benchmarks) without one gets a fresh
    scratch folder; on a cluster a machine-local folder would not survive
    executor loss, so a missing setting is an error there.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if conf_dir:
        if not current:
            sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster (e.g. on HDFS or S3)")
    scratch = tempfile.mkdtemp(prefix="shroud-ckpt-", dir=os.environ.get("SHROUD_SCRATCH", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", scratch)
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, label: str):
    """Write ``df`` as a parquet table in the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` but computes the plan once (an
    eager ``checkpoint()`` runs it twice: once to count, once to write) and
    stores it columnar, so later reads prune columns. Survives executor loss:
    the table lives in the cluster's shared folder, not on a local disk.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Inside, the shuffle files of a query are deleted when it ends; else they stay until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def table_path(df) -> str | None:
    """Folder of a DataFrame read by :func:`materialize` (None otherwise)."""
    files = df.inputFiles()
    if not files:
        return None
    return files[0].rsplit("/", 1)[0]


def remove_tables(spark: SparkSession, paths) -> None:
    """Delete intermediate tables this library wrote under the checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        if not p:
            continue
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        qualified = str(fs.makeQualified(path))
        if qualified.startswith(str(fs.makeQualified(jvm.org.apache.hadoop.fs.Path(base)))):
            fs.delete(path, True)
