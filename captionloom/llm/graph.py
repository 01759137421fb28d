"""Connected components of an edge table, kept on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionloom.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the ends of ``edges`` (``a``, ``b``, long): the smallest node reachable.

    Each round hooks every tree onto the smallest grandparent seen over an edge and halves the
    paths, so rounds grow with the logarithm of the longest chain. A round is written to the
    shared folder, where a lost executor takes nothing with it. Joins read written tables on both
    sides, so that Spark can split a node that holds many edges; sums and minima combine first.
    """
    ends = edges.filter("a <> b").select("a", "b")
    both = materialize(ends.union(ends.select("b", "a")).distinct(), "edges")
    parents = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("up")), "parents"
    )
    total = None
    while True:
        seen = parents.agg(F.sum(F.col("up").cast("decimal(38,0)"))).first()[0]
        if seen is None or seen == total:
            return parents.withColumnRenamed("up", "component")
        total = seen
        tops = parents.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = parents.join(tops, "up").select("node", "up", "top")
        near = both.join(jumped.select(F.col("node").alias("b"), "top"), "b").groupBy(F.col("a").alias("node"))
        hooks = jumped.join(near.agg(F.min("top").alias("near")), "node")
        offers = hooks.select(
            F.inline(
                F.array(
                    F.struct(F.col("node"), F.least("near", "top").alias("up")),
                    F.struct(F.col("up").alias("node"), F.col("near").alias("up")),
                )
            )
        )
        parents = materialize(offers.groupBy("node").agg(F.min("up").alias("up")), "parents")
