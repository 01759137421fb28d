"""From shards to token batches, as the settings say."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from captionloom.functions.text import clean_rows
from captionloom.functions.vectors import has_rank
from captionloom.operators import encode, ordering, sampling
from captionloom.settings import DataSettings
from captionloom.sources import shards
from captionloom.sources.vocab import read_vocab

_ARRAY = pa.struct([("shape", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))])


def npy_array(raw: bytes) -> np.ndarray:
    return np.load(io.BytesIO(raw), allow_pickle=False)


def media_array(column: Column | str, decode: Callable[[bytes], np.ndarray] = npy_array) -> Column:
    """``shape`` and ``values`` of the array that ``decode`` makes of the bytes; null where it fails."""

    def one(raw: bytes | None) -> dict | None:
        try:
            array = np.asarray(decode(raw), np.float32)
        except Exception:  # any failure of the caller's code drops the sample, as the loader does
            return None
        return {"shape": list(array.shape), "values": array.ravel()}

    @F.arrow_udf("struct<shape:array<int>,values:array<float>>")
    def stage(values: pa.Array) -> pa.Array:
        return pa.array([one(v.as_py()) for v in values], _ARRAY)

    return stage(column)


def token_batches(
    spark: SparkSession,
    settings: DataSettings,
    seed,
    epoch: int = 0,
    skip_bad: bool = False,
    media: Callable[[bytes], np.ndarray] | None = None,
    draws: int | None = None,
) -> DataFrame:
    """``batch_id, batch_rows, key, tokens, mask``: one epoch, shuffled, with caption dropout.

    Batches name their samples by key. With ``media`` they hold ``shape`` and ``values`` of each sample's array
    too; samples that it cannot decode, and in latent mode those whose array has not three axes, are left out.
    ``draws`` takes so many shards with replacement instead of each once; keys then begin with the draw. With
    ``skip_bad`` samples behind a shard's damage are left out; ``shards.shard_faults`` accounts for them.
    """
    samples = shards.read_shards(spark, settings.shards_path, skip_bad=skip_bad)
    pick, name = (shards.latent_samples, "latent") if settings.latent_mode else (shards.image_samples, "image")
    picked = pick(samples)
    if draws is not None:
        drawn = sampling.resample_shards(picked, "shard", seed, draws=draws, epoch=epoch)
        picked = drawn.withColumn("key", F.concat_ws("/", F.format_string("%09d", "draw"), "key"))
    columns = ["key", "tokens", "mask"]
    kept = clean_rows(picked, "caption", "key", name)
    if media is None:
        kept = kept.select("key", "caption")
    else:
        kept = kept.select("key", "caption", media_array(name, media).alias("media")).filter("media IS NOT NULL")
        kept = kept.select("key", "caption", "media.shape", "media.values")
        if settings.latent_mode:
            kept = kept.filter(has_rank("shape", 3, "values"))
        columns += ["shape", "values"]
    vocab = read_vocab(spark, settings.tokenizer_path)
    rows = encode.token_rows(kept, vocab, "caption", settings.max_length)
    dropped = sampling.caption_dropout(rows, "key", settings.caption_dropout, seed, epoch, length=settings.max_length)
    ranked = ordering.shuffle_rank(dropped.select(*columns), "key", seed, epoch)
    return ordering.batches(ranked, "shuffle_rank", columns, settings.batch_size)
