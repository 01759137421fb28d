"""Scores of paired and unpaired vector sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from captionloom.functions.hashing import digest
from captionloom.functions.vectors import as_double, cosine
from captionloom.session import materialize

#: Fixed values of SplitMix64.
STEP = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def clip_pairs(images: DataFrame, texts: DataFrame, key: str, image: str = "image", text: str = "text") -> DataFrame:
    """Cosine of the image and the text vector of each key."""
    joined = images.join(texts, key)
    return joined.withColumn("similarity", cosine(image, text)).drop(image, text)


def clip_score(pairs: DataFrame, *groups: str) -> DataFrame:
    """Mean and sample deviation of the similarities, over all or per group."""
    return pairs.groupBy(*groups).agg(
        F.count("similarity").alias("n"),
        F.avg("similarity").alias("clip_mean"),
        F.stddev_samp("similarity").alias("clip_std"),
    )


def _mixed(h: np.ndarray, subset: int) -> np.ndarray:
    """The draw of rows with hash ``h`` for a subset: the step and the mix of the public SplitMix64 generator."""
    z = h + np.uint64((subset + 1) * STEP % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX[0])
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX[1])
    return z ^ (z >> np.uint64(31))


def draw_subsets(df: DataFrame, key: str, side: str, subsets: int, size: int, seed) -> DataFrame:
    """``side, subset, key``: per side and subset the ``size`` rows of smallest draw.

    A row is hashed once: the first 64 bits of md5 of ``seed|key``. Its draw for a subset is that number, mixed with the
    subset's (``_mixed``); of equal draws the smaller key counts. Rows have a side. One pass: each task keeps no more than the ``size``
    smallest draws a side and subset, and those of all tasks are ranked together.
    """
    kind = df.schema[key].dataType.simpleString()

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, int], pa.Table] = {}
        for batch in batches:
            h = batch.column("_h").to_numpy().view(np.uint64)
            sides = batch.column(side)
            for name in sides.unique().to_pylist():
                rows = np.flatnonzero(np.asarray(pc.equal(sides, name)))
                for subset in range(subsets):
                    # The sign bit turned, so that signed order is that of the draws.
                    draw = (_mixed(h[rows], subset) ^ np.uint64(1 << 63)).view(np.int64)
                    held = kept.get((name, subset))
                    low = np.arange(len(rows))
                    if held is not None and len(held) >= size:
                        low = np.flatnonzero(draw <= held.column("draw")[size - 1].as_py())
                    if not len(low):
                        continue
                    found = pa.table({"key": batch.column(key).take(pa.array(rows[low])), "draw": draw[low]})
                    both = found if held is None else pa.concat_tables([held, found])
                    kept[name, subset] = both.sort_by([("draw", "ascending"), ("key", "ascending")]).slice(0, size).combine_chunks()
        for (name, subset), rows in kept.items():
            columns = [pa.array([name] * len(rows)), pa.array([subset] * len(rows), pa.int32()), rows["key"], rows["draw"]]
            yield from pa.table(columns, [side, "subset", key, "_draw"]).to_batches()

    hashed = df.select(side, key, F.conv(F.substring(digest(seed, F.col(key)), 1, 16), 16, -10).cast("bigint").alias("_h"))
    lowest = hashed.mapInArrow(smallest, f"`{side}` string, subset int, `{key}` {kind}, _draw bigint")
    place = F.row_number().over(W.partitionBy(side, "subset").orderBy("_draw", key))
    chosen = materialize(lowest.withColumn("_r", place).filter(F.col("_r") <= size).drop("_r", "_draw"), "subsets")
    # At most ``size`` rows a side and subset.
    least = {r[0]: r[1] for r in chosen.filter("subset = 0").groupBy(side).count().collect()}
    if len(least) < 2 or min(least.values()) < size:
        raise ValueError(f"both sides need at least {size} rows: {least}")
    return chosen


def kernel_scores(
    df: DataFrame,
    key: str = "key",
    side: str = "side",
    vec: str = "embedding",
    real: str = "real",
    fake: str = "fake",
    subsets: int = 100,
    subset_size: int = 50,
    seed=0,
) -> DataFrame:
    """``subset, mmd2``: unbiased squared MMD with kernel (x.y/d + 1)^3 for every subset.

    A subset has ``subset_size`` rows of each side by definition, so its Gram matrix is
    made in one task; no pairs are sent anywhere.
    """
    both = df.filter(F.col(side).isin(real, fake))
    chosen = draw_subsets(both.select(key, side), key, side, subsets, subset_size, seed)
    # At most 2 * subsets * subset_size rows, set by the parameters.
    rows = both.select(key, side, vec).join(F.broadcast(chosen), [key, side])

    def mmd2(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([side, key])
        x = np.stack(group.loc[group[side] == real, vec].to_list()).astype(np.float64)
        y = np.stack(group.loc[group[side] == fake, vec].to_list()).astype(np.float64)
        d = x.shape[1]
        within = 0.0
        for z in (x, y):
            k = (z @ z.T / d + 1) ** 3
            within += (k.sum() - np.trace(k)) / (len(z) * (len(z) - 1))
        between = ((x @ y.T / d + 1) ** 3).mean()
        return pd.DataFrame([(int(group["subset"].iloc[0]), within - 2 * between)], columns=["subset", "mmd2"])

    return rows.groupBy("subset").applyInPandas(mmd2, "subset int, mmd2 double")


def kid(df: DataFrame, **params) -> DataFrame:
    """Mean and population deviation of the subset scores."""
    return kernel_scores(df, **params).agg(
        F.count("*").alias("subsets"), F.avg("mmd2").alias("kid_mean"), F.stddev_pop("mmd2").alias("kid_std")
    )


def masked_mean(
    rows: DataFrame, table: DataFrame, key: str, tokens: str = "tokens", mask: str = "mask",
    token_id: str = "id", vec: str = "embedding",
) -> DataFrame:
    """Mean of the token vectors where the mask is 1, per key; zeros where no token counts.

    The vector table is joined by token id. Spark broadcasts it if its size on disk allows, and else
    splits the ids that are frequent.
    """
    first = table.select(F.size(vec).alias("d")).limit(1).collect()
    dim = first[0]["d"] if first else 0
    live = F.filter(F.arrays_zip(F.col(tokens).alias("t"), F.col(mask).alias("m")), lambda p: p["m"] == 1)
    spread = rows.select(key, F.explode_outer(F.transform(live, lambda p: p["t"])).alias(token_id))
    vectors = table.select(token_id, as_double(vec).alias("_v"))
    joined = spread.join(vectors, token_id, "left")
    # A padded key has no vector; a vector of zeros adds nothing and keeps the key.
    zero = F.array_repeat(F.lit(0.0), dim)
    filled = joined.select(key, array_to_vector(F.coalesce("_v", zero)).alias("_v"))
    return filled.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("pooled"))
