"""Shards of near equal bytes by Karmarkar-Karp differencing of indivisible groups.

Every group begins as a partial partition with its bytes in one part. The two partial partitions
with the largest spread are combined, the parts of one in the opposite order of the other's, until one is
left. At scale the groups are dealt over buckets; each bucket is differenced in a task of its own,
and the partial partitions of the buckets are combined in the same way, level by level.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from captionloom.llm.common import PLACE, with_place
from captionloom.session import materialize

SHARDS = 24
EXTRA_BYTES = 8
#: Groups differenced in one task; partial partitions combined in one task.
BUCKET_GROUPS = 20_000
FAN_IN = 1_000
#: Rows of a shard numbered in one task.
SLOT_ROWS = 5_000


def difference(partitions: list[list[tuple[int, object]]], parts: int) -> list[tuple[int, object]]:
    """The parts (bytes, members) left when all ``partitions`` are combined.

    A partition is a list of at most ``parts`` (bytes, members); members are nested pairs, opened
    by ``members``. Parts that hold nothing are left out of the lists.
    """
    heap = []
    for i, p in enumerate(partitions):
        p = sorted(p, key=lambda x: -x[0])
        heap.append((-(p[0][0] - (p[-1][0] if len(p) == parts else 0)), i, p))
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = parts - len(a)
        joined = a + b[:free]
        # The largest of b meet the empty or smallest parts of a.
        for k, (size, who) in enumerate(b[free:]):
            at = len(a) - 1 - k
            joined[at] = (joined[at][0] + size, (joined[at][1], who))
        joined.sort(key=lambda x: -x[0])
        spread = joined[0][0] - (joined[-1][0] if len(joined) == parts else 0)
        heapq.heappush(heap, (-spread, made, joined))
        made += 1
    return heap[0][2] if heap else []


def members(tree: object) -> list[int]:
    """Leaves of nested pairs."""
    out, stack = [], [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack.extend(node)
        else:
            out.append(node)
    return out


def _differ(parts: int):
    """Groups (``node``, ``bytes``, ``part``) of one parent to their part in it."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("bytes", "descending"), ("node", "ascending"), ("part", "ascending")])
        nodes, old, sizes = (group[c].to_pylist() for c in ("node", "part", "bytes"))
        by_node: dict[str, list[tuple[int, object]]] = {}
        for i, (node, size) in enumerate(zip(nodes, sizes)):
            by_node.setdefault(node, []).append((size, i))
        new = [0] * len(nodes)
        for part, (_, tree) in enumerate(difference(list(by_node.values()), parts)):
            for i in members(tree):
                new[i] = part
        return pa.table(
            {
                "node": nodes,
                "part": pa.array(old, pa.int32()),
                "bytes": pa.array(sizes, pa.int64()),
                "parent": group["parent"],
                "new_part": pa.array(new, pa.int32()),
            }
        )

    return run


def assign_groups(groups: DataFrame, parts: int = SHARDS, bucket_groups: int = BUCKET_GROUPS, fan_in: int = FAN_IN) -> DataFrame:
    """``node, shard`` of each of ``groups`` (``node`` string, ``bytes``): the whole group in one shard."""
    schema = "node string, part int, bytes long, parent string, new_part int"
    level = groups.select("node", F.lit(0).alias("part"), "bytes", F.lit(True).alias("whole"))
    width, maps = bucket_groups, []
    while True:
        known = level.agg(F.countDistinct("node").alias("nodes") if maps else F.count("*").alias("nodes"), F.sum("bytes").alias("bytes")).first()
        parents = max(1, -(-known["nodes"] // width))
        # A group above the mean part of a bucket would leave its bucket uneven; it goes up as it is.
        # There are fewer than ``parts`` such groups to a bucket.
        mean = (known["bytes"] or 0) / (parts * parents) if parents > 1 else float("inf")
        up = F.col("whole") & (F.col("bytes") > mean)
        bucket = F.concat(F.lit(f"{len(maps)}:"), F.pmod(F.xxhash64("node"), F.lit(parents)).cast("string"))
        low = level.filter(~up).select("node", "part", "bytes", bucket.alias("parent"))
        high = level.filter(up).select("node", "part", "bytes", F.col("node").alias("parent"), F.col("part").alias("new_part"))
        done = materialize(low.groupBy("parent").applyInArrow(_differ(parts), schema).union(high), "differ")
        maps.append(done.select("node", "part", "parent", "new_part"))
        if parents == 1:
            break
        level = done.groupBy(F.col("parent").alias("node"), F.col("new_part").alias("part")).agg(
            F.sum("bytes").alias("bytes"), F.max(F.col("node") == F.col("parent")).alias("whole")
        )
        width = max(fan_in, 4 * parts)
    first, *later = maps
    out = first.select("node", F.col("parent").alias("at"), F.col("new_part").alias("shard"))
    for up in later:
        step = up.select(F.col("node").alias("at"), F.col("part").alias("shard"), "parent", "new_part")
        out = out.join(step, ["at", "shard"]).select("node", F.col("parent").alias("at"), F.col("new_part").alias("shard"))
    return out.select("node", "shard")


def assign_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``) with place, ``size, text_crc32, shard, slot``.

    Rows with equal texts (null is one text of no bytes) go together. Slots count from 0 in each
    shard without gaps. Texts are read once and never exchanged.
    """
    text = F.col("text")
    slim = with_place(docs).select(
        *PLACE,
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + EXTRA_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("node"),
    )
    slim = materialize(slim, "sizes")
    groups = slim.groupBy("node").agg(F.sum("size").alias("bytes"))
    homes = materialize(assign_groups(groups, shards), "homes")
    blocks = max(1, -(-slim.count() // SLOT_ROWS))
    block = F.pmod(F.xxhash64(*PLACE), F.lit(blocks)).alias("block")
    placed = materialize(slim.join(homes, "node").select("*", block), "placed")
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(W.partitionBy("shard", "block").orderBy("doc_id", *PLACE))
    ranked = placed.withColumn("rank", rank).join(materialize(starts, "starts"), ["shard", "block"])
    return ranked.select(
        *PLACE, "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot")
    )


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The contract's columns: law ``bytes``, sizes near equal; ``grown_shard`` belongs to another law."""
    return assign_rows(docs, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def with_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (columns of these names are replaced)."""
    docs = docs.drop("shard", "slot")
    placed = with_place(docs)
    homes = materialize(assign_rows(placed, shards).select(*PLACE, "shard", "slot"), "slots")
    # Merged at every size: a list of rows grows with the input and is never broadcast.
    return placed.join(homes.hint("merge"), PLACE).drop(*PLACE)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes ``docs`` as one Parquet folder per shard, rows of a file in slot order."""
    out = with_shards(docs, shards)
    out.repartition("shard", F.floor(F.col("slot") / SLOT_ROWS)).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)
