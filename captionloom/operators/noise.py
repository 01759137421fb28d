"""Noise schedules and fixed-noise evaluation sets over vector tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from captionloom.functions.hashing import normal, timestep_sample
from captionloom.functions.vectors import as_double

# Fixed values of the cosine schedule (Nichol and Dhariwal 2021): offset and clamp of beta.
COSINE_OFFSET = 0.008
BETA_MIN, BETA_MAX = 1e-8, 0.999
MAX_TIMESTEPS = 100_000


def noise_schedule(
    spark: SparkSession, kind: str, timesteps: int, beta_start: float = 1e-4, beta_end: float = 0.02
) -> DataFrame:
    """One row per timestep: ``t, beta, alpha_bar`` and what is derived from them.

    A dimension table of ``timesteps`` rows, bounded, and so always fit to be broadcast.
    """
    if not 0 < timesteps <= MAX_TIMESTEPS:
        raise ValueError(f"timesteps must be in 1..{MAX_TIMESTEPS}")
    steps = spark.range(0, timesteps, 1, 1).withColumnRenamed("id", "t")
    if kind == "linear":
        beta = F.lit(beta_start) + F.col("t") * F.lit((beta_end - beta_start) / max(timesteps - 1, 1))
    elif kind == "cosine":
        curve = lambda x: F.pow(
            F.cos((x / timesteps + COSINE_OFFSET) / (1 + COSINE_OFFSET) * (math.pi * 0.5)), F.lit(2.0)
        )
        ratio = curve(F.col("t") + 1) / curve(F.col("t"))
        beta = F.greatest(F.least(1 - ratio, F.lit(BETA_MAX)), F.lit(BETA_MIN))
    else:
        raise ValueError(f"Unknown beta schedule {kind}")
    by_t = W.orderBy("t")
    log_sum = F.sum(F.log1p(-F.col("beta"))).over(by_t.rowsBetween(W.unboundedPreceding, 0))
    bars = steps.withColumn("beta", beta).withColumn("alpha_bar", F.exp(log_sum))
    bars = bars.withColumn("alpha_bar_prev", F.lag("alpha_bar", 1, 1.0).over(by_t))
    return bars.withColumns(
        {
            "sqrt_alpha_bar": F.sqrt("alpha_bar"),
            "sqrt_one_minus_alpha_bar": F.sqrt(1 - F.col("alpha_bar")),
            "posterior_variance": F.col("beta") * (1 - F.col("alpha_bar_prev")) / (1 - F.col("alpha_bar")),
        }
    ).withColumn("t", F.col("t").cast("int"))


def gather_schedule(rows: DataFrame, schedule: DataFrame, t: str = "t") -> DataFrame:
    """Each row with the schedule values of its timestep."""
    return rows.join(F.broadcast(schedule.withColumnRenamed("t", t)), t)


def forward_noise(
    rows: DataFrame, key: str, vec: str, schedule: DataFrame, timesteps: int, seed, with_noise: bool = False
) -> DataFrame:
    """Adds ``t`` and ``noised``: sqrt(a) x + sqrt(1-a) e, with t and e drawn by hash of the key.

    Narrow apart from the broadcast of the schedule; a rerun gives the same noise.
    """
    drawn = rows.withColumn("t", timestep_sample(timesteps, seed, F.col(key), "t"))
    keep = schedule.select("t", "sqrt_alpha_bar", "sqrt_one_minus_alpha_bar")
    noise = F.transform(as_double(vec), lambda x, i: normal(seed, F.col(key), i))
    placed = gather_schedule(drawn, keep).withColumn("noise", noise)
    mixed = F.zip_with(
        as_double(vec),
        "noise",
        lambda x, e: F.col("sqrt_alpha_bar") * x + F.col("sqrt_one_minus_alpha_bar") * e,
    )
    out = placed.withColumn("noised", mixed).drop("sqrt_alpha_bar", "sqrt_one_minus_alpha_bar")
    return out if with_noise else out.drop("noise")


def mse_by_timestep(
    predicted: DataFrame, true: DataFrame, key: str, bucket: int, prediction: str = "prediction", noise: str = "noise"
) -> DataFrame:
    """Mean squared error of predicted noise per range of ``bucket`` timesteps."""
    joined = predicted.select(key, "t", prediction).join(true.select(key, noise), key)
    squares = F.zip_with(as_double(prediction), as_double(noise), lambda p, n: (p - n) * (p - n))
    error = F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)
    per_row = joined.select(
        F.floor(F.col("t") / bucket).cast("bigint").alias("t_bucket"),
        error.alias("_sse"),
        F.size(noise).alias("_n"),
    )
    return per_row.groupBy("t_bucket").agg(
        F.count("*").alias("rows"), (F.sum("_sse") / F.sum("_n")).alias("mse")
    )
