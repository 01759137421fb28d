"""Whole jobs: from folders and shards to scores, latents and prepared shards. Models are the caller's."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionloom.operators import filters, moments, ordering, payload, scores, stages
from captionloom.session import materialize
from captionloom.sources import images, shards

VECTOR = "array<double>"


def _encoded(spark: SparkSession, folder: str, make_model: Callable, side: str, batch_size: int) -> DataFrame:
    scanned = images.scan_images(spark, folder).select("name", images.rgb_pixels().alias("rgb"))
    vec = stages.map_values(make_model, "rgb", VECTOR, batch_size)
    return scanned.select(F.concat(F.lit(f"{side}/"), "name").alias("key"), F.lit(side).alias("side"), vec.alias("embedding"))


def score_folders(
    spark: SparkSession, real: str, fake: str, make_model: Callable, batch_size: int = 8,
    subsets: int = 100, subset_size: int = 50, seed=0,
) -> DataFrame:
    """``n_real, n_fake, fid, kid_mean, kid_std`` of two image folders.

    ``make_model`` gives a function from a list of pixel arrays (red, green, blue) to a list of vectors.
    """
    both = _encoded(spark, real, make_model, "real", batch_size).union(_encoded(spark, fake, make_model, "fake", batch_size))
    vectors = materialize(both, "features")
    kid = scores.kid(vectors, subsets=subsets, subset_size=subset_size, seed=seed)
    # One row each.
    return moments.fid(vectors).withColumn("_one", F.lit(1)).join(
        kid.select("kid_mean", "kid_std", F.lit(1).alias("_one")), "_one"
    ).drop("_one")


def clip_score_folder(
    spark: SparkSession, folder: str, prompts: DataFrame, make_image_model: Callable, make_text_model: Callable, batch_size: int = 8
) -> DataFrame:
    """``n, clip_mean, clip_std``: images by name against ``prompts`` (``pos, prompt``) in order; the longer side is cut."""
    pixels = images.scan_images(spark, folder).select("name", images.rgb_pixels().alias("rgb"))
    image = stages.map_values(make_image_model, "rgb", VECTOR, batch_size)
    text = stages.map_values(make_text_model, "prompt", VECTOR, batch_size)
    pairs = ordering.zip_by_rank(
        pixels.select("name", image.alias("image")), ["name"], prompts.select("pos", text.alias("text")), ["pos"]
    )
    met = pairs.filter(F.col("name").isNotNull() & F.col("pos").isNotNull())
    return scores.clip_score(met.select(scores.cosine("image", "text").alias("similarity")))


def npy(array: np.ndarray) -> bytes:
    """An array with its shape and type."""
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def encode_latent_shards(
    spark: SparkSession, pattern: str, out: str, make_model: Callable, scale: float, batch_size: int = 8
) -> DataFrame:
    """Image shards to latent shards of the same names; gives the count of samples per shard.

    ``make_model`` gives a function from a list of image bytes to a list of arrays. Samples are numbered
    ``latent-%09d`` in the order of shard and key, and hold the scaled array and the caption.
    """

    def make():
        model = make_model()
        return lambda values: [npy(np.asarray(x, np.float32) * np.float32(scale)) for x in model(values)]

    samples = shards.image_samples(shards.read_shards(spark, pattern))
    latent = stages.map_values(make, "image", "binary", batch_size)
    # Images stay in the task that read them; latents and captions are what is written and exchanged.
    made = ordering.with_spot(materialize(samples.select("shard", "key", "caption", latent.alias("latent")), "latents"))
    numbered = ordering.rank_by_spot(made, ["shard", "key"], lambda keys: ordering.global_rank(keys, ["shard", "key", *ordering.SPOT]))
    members = F.create_map(F.lit("npy"), F.col("latent"), F.lit("txt"), F.encode("caption", "UTF-8"))
    shards.write_shards(numbered.select("shard", ordering.sample_key("rank", "latent").alias("key"), members.alias("members")), out)
    return shards.read_shards(spark, out, members=False).groupBy("shard").agg(F.count("*").alias("samples"))


def prepare_shards(
    meta: DataFrame, fetched: DataFrame, body: str, decode: Callable, out: str, shard_size: int = 1000
) -> DataFrame:
    """Metadata (with ``idx``) and payloads to image shards; gives the funnel, undecodable payloads among its reasons.

    ``decode`` turns payload bytes into image bytes, or fails, or gives None to drop the row. Ranks, and so
    shard names, count the rows that passed it.
    """
    safe = filters.safe_captions(meta)
    joined = payload.attach_payload(safe, fetched)
    # The payload is not kept beside what was made of it.
    tried = materialize(joined.withColumn("result", stages.try_map(decode, body, "binary")).drop(body), "decoded")
    good, bad = stages.split_bad(ordering.with_spot(tried), "result", "image")
    ranked = ordering.rank_by_spot(good, ["idx"], ordering.kept_rank)
    members = F.create_map(F.lit("jpg"), F.col("image"), F.lit("txt"), F.encode("caption", "UTF-8"))
    shards.write_shards(
        ranked.select(ordering.shard_id("kept_rank", shard_size).alias("shard"), ordering.sample_key("idx").alias("key"), members.alias("members")),
        out,
    )
    funnel = payload.filter_funnel(meta, fetched)
    lost = bad.agg(F.count("*").alias("n")).select(F.lit(filters.UNDECODABLE).alias("reason"), "n")
    moved = lost.unionByName(lost.select(F.lit(filters.KEPT).alias("reason"), (-F.col("n")).alias("n")))
    return funnel.unionByName(moved).groupBy("reason").agg(F.sum("n").alias("n")).filter("n > 0")
