"""Session and shared-folder helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "captionloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE, exact column case."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.caseSensitive": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all runs in one
    local process (tests) a folder of our own is made, and then remembered in the session; a
    cluster without a shared folder is refused, as each executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    root = spark.conf.get("spark.captionloom.sharedDir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="captionloom-")
        spark.conf.set("spark.captionloom.sharedDir", root)
    return root


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/captionloom/{spark.sparkContext.applicationId}"


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path of its own below the shared folder, for one run's files."""
    return f"{_run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Deletes what this application wrote to the shared folder.

    To be called once results are stored elsewhere: tables read from there are gone then.
    """
    drop_path(spark, _run_dir(spark))


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this application wrote, if it is there, on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def make_path(spark: SparkSession, path: str) -> None:
    """Makes a folder, on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a result to the shared folder and read it back.

    Cuts the lineage as a checkpoint does, survives the loss of executors, and leaves
    Spark with file statistics to plan the next stage.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hands a scan of fewer files than cores to all cores before heavy text work.

    A table of many files is left as it is: no exchange is added at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if len(df.inputFiles()) < cores else df
