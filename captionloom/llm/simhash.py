"""SimHash near-duplicates: exact comparison of tiles of fingerprints.

The population counts of a fingerprint's two halves name its cell, those of its four quarters where
a cell would be large; there are at most 17^4 cells whatever the input. Two fingerprints at Hamming
distance r have counts that differ by r in sum at most, so only cells whose counts are that
close are compared: tile by tile, exclusive-or and bit counts in numpy, with the same test on the
counts of eight segments for blocks of a tile. The work still grows with the square of the number
of different fingerprints; the counts take away the larger part of it, not the square.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionloom.llm.common import arrow_rows
from captionloom.llm.graph import components
from captionloom.session import materialize

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints in a tile: work of a tile pair is its square, memory stays in megabytes.
TILE_ROWS = 4096
#: Tiles in a cell of half-word counts; beyond, quarters are told apart.
CELL_TILES = 16
SHINGLE_BLOCK = 1 << 16
BLOCK = 128


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint; 0 for null and for texts without words."""
    if not text:
        return 0
    joined = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(joined)]))
    n = max(1, len(starts) - shingle + 1)
    ends = ends[min(shingle, len(ends)) - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLE_BLOCK):
        pairs = zip(starts[at : at + SHINGLE_BLOCK].tolist(), ends[at : at + SHINGLE_BLOCK].tolist())
        hashes = np.fromiter((digest(joined[s:e], seed) for s, e in pairs), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Adds the fingerprint of ``text`` as a signed long with the same bits."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        made = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        return pa.array(made.view(np.int64))

    return docs.withColumn(out, of(F.col(text)))


def _segments(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view(np.uint8).reshape(-1, 8)).astype(np.int16)


def _linked(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``a`` and ``b`` at most ``radius`` bits apart, block by block.

    Blocks hold rows with similar segment counts; a block pair whose counts are further apart
    than the radius is skipped.
    """
    sides = []
    for fps in (a, b):
        counts = _segments(fps)
        order = np.lexsort(counts.T)
        counts = counts[order]
        cuts = np.arange(0, len(fps), BLOCK)
        sides.append((order, fps[order], np.minimum.reduceat(counts, cuts), np.maximum.reduceat(counts, cuts)))
    (order_a, a, low_a, high_a), (order_b, b, low_b, high_b) = sides
    for i in range(len(low_a)):
        gap = np.maximum(low_b - high_a[i], low_a[i] - high_b).clip(0).sum(axis=1)
        near = gap <= radius
        if near.all():
            cols, spots = b, order_b
        elif near.any():
            keep = np.repeat(near, BLOCK)[: len(b)]
            cols, spots = b[keep], order_b[keep]
        else:
            continue
        rows = a[i * BLOCK : (i + 1) * BLOCK]
        hits = np.flatnonzero(np.bitwise_count(rows[:, None] ^ cols[None, :]) <= radius)
        if len(hits):
            x, y = np.divmod(hits, len(cols))
            yield order_a[i * BLOCK + x], spots[y]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index reachable for each of ``n``, over the pairs: links in, a spanning forest out."""
    root = np.arange(n)
    for x, y in pairs:
        while True:
            low = np.minimum(root[x], root[y])
            if np.array_equal(root[x], low) and np.array_equal(root[y], low):
                break
            np.minimum.at(root, root[x], low)
            np.minimum.at(root, root[y], low)
            root = root[root]
    while not np.array_equal(root, root[root]):
        root = root[root]
    return root


def _cells(counts: dict[int, int], tile_rows: int) -> list[tuple]:
    """``key, cell, high, low, least, most, tiles`` of each key of quarter counts: the cell that it falls into.

    A cell is all keys with the same half-word counts (``high``, ``low``), or one key where that would
    hold more than ``CELL_TILES`` tiles; ``least`` and ``most`` bound its quarter counts.
    """
    halves: dict[tuple[int, int], list[int]] = {}
    for key in sorted(counts):
        quarters = [key // 17**k % 17 for k in (3, 2, 1, 0)]
        halves.setdefault((quarters[0] + quarters[1], quarters[2] + quarters[3]), []).append(key)
    out = []
    for (high, low), keys in halves.items():
        whole = sum(counts[k] for k in keys) <= CELL_TILES * tile_rows
        for group in [keys] if whole else [[k] for k in keys]:
            quarters = [[k // 17**e % 17 for e in (3, 2, 1, 0)] for k in group]
            least, most = [min(q) for q in zip(*quarters)], [max(q) for q in zip(*quarters)]
            tiles = -(-sum(counts[k] for k in group) // tile_rows)
            out += [(k, group[0], high, low, least, most, tiles) for k in group]
    return out


def _near_cells(cells: DataFrame, radius: int) -> DataFrame:
    """Pairs of cells (``cell``, ``cell_b`` and their ``tiles``) whose population counts allow a link."""
    steps = [(x, y) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if abs(x) + abs(y) <= radius]
    step = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps]))
    left = cells.withColumn("step", step).withColumns(
        {"high_b": F.col("high") + F.col("step.x"), "low_b": F.col("low") + F.col("step.y")}
    )
    right = cells.select(*[F.col(c).alias(f"{c}_b") for c in cells.columns])
    gaps = [F.greatest(F.col("least_b")[k] - F.col("most")[k], F.col("least")[k] - F.col("most_b")[k], F.lit(0)) for k in range(4)]
    near = left.join(right, ["high_b", "low_b"]).filter((F.col("cell") <= F.col("cell_b")) & (sum(gaps) <= radius))
    return near.select("cell", "tiles", "cell_b", "tiles_b")


def links(fps: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links ``a, b`` that span all groups of the distinct fingerprints in ``fps``.

    A tile pair gives a spanning forest of the links in it, not all pairs, so its output is no
    larger than its input.
    """
    quarters = [F.bit_count(F.shiftrightunsigned("fp", 48 - 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    key = reduce(lambda k, q: k * 17 + q, quarters).cast("int")
    keyed = fps.select("fp", key.alias("key"))
    # 17^4 keys at most: a proven bound for the driver and for the broadcast.
    counts = {r["key"]: r["n"] for r in keyed.groupBy("key").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    spark = fps.sparkSession
    schema = "key int, cell int, high int, low int, least array<int>, most array<int>, tiles long"
    cells = materialize(spark.createDataFrame(_cells(counts, tile_rows), schema), "cells")
    numbered = keyed.join(F.broadcast(cells.select("key", "cell", "tiles")), "key")
    numbered = numbered.withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles"))
    tiles = materialize(numbered.groupBy("cell", "tile").agg(F.collect_list("fp").alias("fps")), "tiles")
    zero = F.lit(0).cast("long")
    pairs = (
        _near_cells(cells.drop("key").distinct(), radius)
        .withColumn("tile", F.explode(F.sequence(zero, F.col("tiles") - 1)))
        .withColumn("tile_b", F.explode(F.sequence(zero, F.col("tiles_b") - 1)))
        .filter("cell < cell_b OR tile <= tile_b")
        .select("cell", "tile", "cell_b", "tile_b")
    )
    right = tiles.select(F.col("cell").alias("cell_b"), F.col("tile").alias("tile_b"), F.col("fps").alias("fps_b"))
    both = pairs.join(tiles, ["cell", "tile"]).join(right, ["cell_b", "tile_b"])

    def compare(group: pa.Table) -> pa.Table:
        a = group["fps"].combine_chunks().flatten().to_numpy().view(np.uint64)
        b = group["fps_b"].combine_chunks().flatten().to_numpy().view(np.uint64)
        root = forest(len(a) + len(b), ((x, y + len(a)) for x, y in _linked(a, b, radius)))
        nodes = np.concatenate([a, b]).view(np.int64)
        moved = np.flatnonzero(root != np.arange(len(root)))
        made = pa.table({"a": nodes[moved], "b": nodes[root[moved]]})
        return made.filter(pa.array(nodes[moved] != nodes[root[moved]]))

    keys = ["cell_b", "tile_b", "cell", "tile"]
    return both.groupBy(*keys).applyInArrow(compare, "a long, b long")


def groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    Null and empty texts have fingerprint 0 and are linked like any other. Rows with equal
    fingerprints are one node. Null ids never name a component unless no other id is in it.
    """
    prints = written_prints(docs, ["doc_id"])
    firsts = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "firsts")
    member = firsts.join(groups_of(prints, radius), "fp")
    named = materialize(member.groupBy("group").agg(F.min("first_id").alias("component_id")), "named")
    known = materialize(member.join(named, "group").select("fp", "component_id"), "components")
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def written_prints(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``fp`` of every row of ``docs``, written: the texts are read once."""
    with arrow_rows(docs.sparkSession):
        return materialize(fingerprints(docs.select(*keys, "text")).select(*keys, "fp"), "prints")


def groups_of(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, group`` of each distinct ``fp`` in ``prints``: the smallest fingerprint reachable, written."""
    nodes = materialize(prints.select("fp").distinct(), "nodes")
    found = components(links(nodes, radius)).select(F.col("node").alias("fp"), F.col("component").alias("group"))
    return materialize(nodes.join(found, "fp", "left").select("fp", F.coalesce("group", "fp").alias("group")), "groups")


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits)``, component_id``."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")
