"""Metric logs: one JSON record per logged step, appended to, read in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ("loss", "lr", "clip_mean", "clip_std")
LOG_SCHEMA = "timestamp double, step bigint, " + ", ".join(f"{m} double" for m in METRICS)


def append_log(records: DataFrame, path: str) -> None:
    """Appends records; a metric that is null in a record is left out of its line.

    Records without a timestamp get the present time in seconds.
    """
    if "timestamp" not in records.columns:
        records = records.withColumn("timestamp", F.unix_micros(F.current_timestamp()) / 1e6)
    rest = [c for c in records.columns if c not in ("timestamp", "step")]
    records.select("timestamp", "step", *rest).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def stream_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def long_form(log: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """``timestamp, step, series, value``: one row per logged metric."""
    at = F.timestamp_micros(F.round(F.col("timestamp") * 1e6).cast("bigint"))
    wide = log.select(at.alias("timestamp"), "step", *metrics)
    rows = wide.unpivot(["timestamp", "step"], list(metrics), "series", "value")
    return rows.filter(F.col("value").isNotNull())
