"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, components.

Vectors with equal components are one class. A class falls into one bucket per table; vectors of
one bucket are compared by cosine in double precision. The number of signs grows with the log of the
number of classes, so that buckets keep their size, and the number of tables is what a pair at the
threshold needs to meet with probability ``recall``; the rule is the same at every size. Buckets
beyond ``TILE_ROWS`` are split into tiles, and all their tile pairs compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionloom.llm.graph import components
from captionloom.llm.simhash import forest
from captionloom.session import materialize

COSINE = 0.9
RECALL = 0.995
BUCKET_ROWS = 256
TILE_ROWS = 1024
SEED = 7


def plan(classes: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Signs per table and number of tables for so many classes."""
    bits = max(6, min(30, math.ceil(math.log2(max(1, classes) / BUCKET_ROWS)))) if classes > BUCKET_ROWS else 6
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    """Unit vectors in double precision. Scaling by a power of two first changes no digit."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _codes(unit: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    signs = (unit @ _planes(unit.shape[1], bits, tables, seed) >= 0).reshape(len(unit), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(axis=2)


def classes_of(vectors: DataFrame) -> DataFrame:
    """Distinct usable vectors: ``cid``, ``embedding``, ``members``, ``first_id`` (smallest vec_id), written."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    grouped = vectors.filter(usable).groupBy("embedding").agg(
        F.count("*").alias("members"), F.min("vec_id").alias("first_id")
    )
    return materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")


def compare_buckets(classes: DataFrame, cosine: float, bits: int, tables: int, seed: int = SEED) -> DataFrame:
    """``cid, links, other``: per class and tile pair the members linked, and a spanning forest.

    A pair is counted in the first table that brings it together, so nothing is counted twice and no
    pair has to leave the task.
    """

    @F.arrow_udf("array<int>")
    def code(dims: pa.Array, vectors: pa.Array) -> pa.Array:
        dims, out = dims.to_numpy(), np.zeros((len(vectors), tables), np.int64)
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            out[rows] = _codes(_matrix(vectors.take(pa.array(rows)), len(rows)), bits, tables, seed)
        return pa.array(list(out.astype(np.int32)), pa.list_(pa.int32()))

    coded = classes.withColumn("dim", F.size("embedding")).withColumn("codes", code("dim", "embedding"))
    coded = materialize(coded, "coded")
    keyed = coded.select("cid", "members", "dim", "embedding", F.posexplode("codes").alias("tab", "code"))
    key = ["dim", "tab", "code"]
    sizes = keyed.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > TILE_ROWS)
    large = materialize(sizes.select(*key, F.ceil(F.col("n") / TILE_ROWS).alias("tiles")), "large")
    tiled = keyed.join(large, key, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("cid"), "tiles"))
    tiled = tiled.withColumn("mate", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    paired = tiled.select(
        *key, "cid", "members", "embedding", "tile", F.least("tile", "mate").alias("lo"), F.greatest("tile", "mate").alias("hi")
    )

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("cid")
        cid, members = group["cid"].to_numpy(), group["members"].to_numpy()
        tab, lo, hi = (group[c][0].as_py() for c in ("tab", "lo", "hi"))
        unit = _matrix(group["embedding"].combine_chunks(), len(cid))
        codes = _codes(unit, bits, tables, seed)[:, :tab]
        tile = group["tile"].to_numpy()
        counts = np.zeros(len(cid), np.int64)

        def found():
            for at in range(0, len(cid), 256):
                dots = unit[at : at + 256] @ unit.T
                ok = (dots >= cosine) if lo == hi else (dots >= cosine) & (tile[at : at + 256, None] != tile[None])
                x, y = np.nonzero(ok)
                x += at
                x, y = x[x < y], y[x < y]
                if tab:
                    fresh = ~(codes[x] == codes[y]).any(axis=1)
                    x, y = x[fresh], y[fresh]
                np.add.at(counts, x, members[y])
                np.add.at(counts, y, members[x])
                yield x, y

        root = forest(len(cid), found())
        some = np.flatnonzero(counts)
        return pa.table({"cid": cid[some], "links": counts[some], "other": cid[root[some]]})

    return paired.groupBy(*key, "lo", "hi").applyInArrow(compare, "cid long, links long, other long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (``vec_id``, ``embedding``).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor
    do vectors of different length. A row with a null id counts as a link and never names a
    component unless it is alone.
    """
    vectors = vectors.select("vec_id", "embedding")
    classes = classes_of(vectors)
    bits, tables = plan(classes.count(), cosine, recall)
    found = materialize(compare_buckets(classes, cosine, bits, tables), "links")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("cid").alias("a"), F.col("other").alias("b")))
    slim = classes.select("cid", "first_id", "members")
    linked = slim.join(comps.withColumnRenamed("node", "cid"), "cid")
    firsts = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = linked.join(materialize(firsts, "firsts"), "component").select("cid", "component_id")
    known = classes.join(counts, "cid", "left").join(named, "cid", "left").select(
        "embedding",
        (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("links"),
        F.coalesce("component_id", "first_id").alias("component_id"),
    )
    out = vectors.join(materialize(known, "known"), "embedding", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
