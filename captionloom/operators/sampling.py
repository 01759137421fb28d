"""Repeatable sampling: dropout, splits, shard resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionloom.functions.hashing import u32, uniform
from captionloom.functions.tokens import CONTEXT_LENGTH, attention_mask, null_tokens
from captionloom.operators.ordering import global_rank


def is_dropped(key: Column, p: float, seed, epoch=0) -> Column:
    """The dropout decision of a row in an epoch."""
    return uniform(seed, epoch, key) < F.lit(p)


def caption_dropout(
    df: DataFrame, key: str, p: float, seed, epoch=0, tokens: str = "tokens", length: int = CONTEXT_LENGTH
) -> DataFrame:
    """With probability ``p`` the tokens become the null prompt; the mask follows them.

    All other columns, the caption among them, are left as they are.
    """
    dropped = df.withColumn(tokens, F.when(is_dropped(F.col(key), p, seed, epoch), null_tokens(length)).otherwise(F.col(tokens)))
    return dropped.withColumn("mask", attention_mask(tokens))


def split_name(key: Column, heldout: float, seed) -> Column:
    """``heldout`` for the given share of keys, else ``train``; stable as the table grows."""
    return F.when(uniform(seed, key, "split") < F.lit(heldout), "heldout").otherwise("train")


def resample_shards(
    samples: DataFrame, shard: str, seed, draws: int | None = None, draws_per_shard: float = 1.0, epoch=None
) -> DataFrame:
    """An epoch of shards drawn with replacement: the samples of each drawn shard, once per draw.

    Shards are numbered by name; a draw picks a number by hash. The draws are a table of shard and
    draw; a shard that is drawn often is split by Spark in the join.
    """
    numbered = global_rank(samples.select(shard).distinct(), [shard], "_pos")
    n_shards = numbered.count()
    n_draws = draws if draws is not None else round(n_shards * draws_per_shard)
    salt = ("draw",) if epoch is None else (epoch, "draw")
    picks = samples.sparkSession.range(n_draws).select(
        F.col("id").alias("draw"), F.pmod(u32(seed, F.col("id"), *salt), F.lit(max(n_shards, 1))).alias("_pos")
    )
    return samples.join(picks.join(numbered, "_pos").drop("_pos"), shard)
