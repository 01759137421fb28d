"""Mixing sources to target weights by Pareto order sampling.

A document's expected copies are its source's factor times its weight, two at most; the factor is set
so that the expected words meet the source's target. The whole part is allocated for certain. For the
rest, documents are ranked by the odds of a random number over the odds of their inclusion, and taken
in that order until the target is met. The order is cut by sums over two levels of 4,096 key ranges, so
no source is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from captionloom.llm.common import PLACE, n_tokens, with_place
from captionloom.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
SEED = 5


def source_key() -> Column:
    """The source as a string that is never null and orders by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))


def targets(sizes: DataFrame) -> DataFrame:
    """``src, source_size, target`` of each of the sources in ``sizes`` (``src, source_size``).

    Shares by weight of all words; a source stops at ``MOST_COPIES`` times its size, and the excess goes to
    the others by weight. That is a common level, found over sources sorted by how soon they stop.
    """
    by_name = W.orderBy("src")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    cap = F.col("source_size") * MOST_COPIES
    rows = sizes.withColumn("w", weight.cast("double")).withColumn("cap", cap.cast("double"))
    every = W.partitionBy()
    rows = rows.withColumn("pool", F.sum("source_size").over(every) * SHARE).withColumn("all_w", F.sum("w").over(every))
    soon = W.orderBy(F.col("cap") / F.col("w"), "src")
    before = soon.rowsBetween(W.unboundedPreceding, -1)
    full, used = (F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("cap", "w"))
    rows = rows.withColumn("level", (F.col("pool") - full) / (F.col("all_w") - used))
    # The level of the first source that does not stop holds for all after it.
    open_level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("src"), F.col("level").alias("level"))))
    rows = rows.withColumn("open", open_level.over(every)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("open"), F.lit(float("inf"))) * F.col("w"))
    return rows.select("src", "source_size", target.alias("target"))


def tier_of(size: Column) -> Column:
    """Length class: the whole part of the size's binary logarithm."""
    return F.length(F.bin(F.greatest(size, F.lit(1)))) - 1


def tier_weight(tier: Column) -> Column:
    """Longer documents are somewhat likelier to be taken."""
    return 1 + tier / 20


def factors(cells: DataFrame) -> DataFrame:
    """``src, factor``, given ``cells`` (``src, tier, words, target``): a source's few length classes.

    Classes stop at ``MOST_COPIES``; those of the largest weight stop first.
    """
    heavy = W.partitionBy("src").orderBy(F.desc("tier"))
    before = heavy.rowsBetween(W.unboundedPreceding, -1)
    mass = F.col("words") * tier_weight(F.col("tier"))
    stopped = F.coalesce(F.sum("words").over(before), F.lit(0)) * MOST_COPIES
    left = F.sum(mass).over(heavy.rowsBetween(0, W.unboundedFollowing))
    rows = cells.withColumn("factor", F.try_divide(F.col("target") - stopped, left))
    fits = F.col("factor") * tier_weight(F.col("tier")) <= MOST_COPIES
    return rows.groupBy("src").agg(F.max(F.when(fits, F.struct("tier", "factor")))["factor"].alias("factor"))


def _cut(rows: DataFrame, bounds: DataFrame, level: Column) -> DataFrame:
    """Of each source, the key range (one more ``level``) in which the rest of its target ends.

    ``rows`` are ``src, size`` and the key's levels, ``bounds`` ``src, rest``. A source all of whose words fit
    has no such range.
    """
    sums = rows.groupBy("src", level.alias("range")).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("src").orderBy("range").rowsBetween(W.unboundedPreceding, 0))
    cuts = sums.withColumn("upto", upto).join(bounds, "src").filter(F.col("upto") > F.col("rest"))
    first = cuts.groupBy("src").agg(F.min(F.struct("range", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"))).alias("c"))
    return first.select("src", F.col("c.range").alias("range"), F.col("c.rest").alias("rest"))


def allocate(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` with place, ``doc_id, size, source_size, target, copies, taken``.

    Words are counted and hashed in one pass; later passes read a narrow table. The random number of a
    row is a hash of its id and text, so reruns agree. Null text has no words; a null source is a source.
    """
    text = F.col("text")
    mark = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text)
    draw = (F.conv(F.substring(F.md5(mark.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    slim = with_place(docs).select(*PLACE, "doc_id", source_key().alias("src"), n_tokens(text).alias("size"), draw.alias("draw"))
    slim = materialize(slim, "sizes")
    cells = slim.groupBy("src", tier_of(F.col("size")).alias("tier")).agg(F.sum("size").alias("words"))
    cells = materialize(cells, "cells")
    aims = materialize(targets(cells.groupBy("src").agg(F.sum("words").alias("source_size"))), "targets")
    scale = factors(cells.join(aims.select("src", "target"), "src"))
    aims = materialize(aims.join(scale, "src", "left"), "factors")

    expected = F.coalesce(F.least(F.lit(float(MOST_COPIES)), F.col("factor") * tier_weight(tier_of(F.col("size")))), F.lit(0.0))
    odds = F.col("draw") / (1 - F.col("draw")) * (1 - F.col("part")) / F.col("part")
    key = F.when(F.col("part") > 0, F.floor(odds / (1 + odds) * F.lit(2.0**40)).cast("long"))
    ranked = slim.join(aims, "src").withColumn("expected", expected)
    ranked = ranked.withColumn("sure", F.floor("expected").cast("int")).withColumn("part", F.col("expected") - F.col("sure"))
    ranked = ranked.withColumn("key", key)

    open_rows = ranked.filter("key IS NOT NULL")
    certain = ranked.groupBy("src").agg(F.sum(F.col("size") * F.col("sure")).alias("words"), F.first("target").alias("target"))
    bounds = materialize(certain.select("src", (F.col("target") - F.col("words")).alias("rest")), "rests")
    high, low = F.shiftright("key", 28), F.shiftright("key", 16)
    one = materialize(_cut(open_rows, bounds, high), "cut")
    inside = open_rows.join(one.select("src", F.col("range").alias("high")), "src").filter(high == F.col("high"))
    two = materialize(_cut(inside, one.select("src", "rest"), low), "cut")
    near = open_rows.join(two.select("src", F.col("range").alias("low"), "rest"), "src").filter(low == F.col("low"))
    order = W.partitionBy("src").orderBy("key", "draw", *PLACE)
    upto = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))
    # The last document taken is the one that brings the sum nearest to the target.
    taken = near.withColumn("upto", upto).filter(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    spot = F.struct("key", "draw", *PLACE)
    edge = taken.groupBy("src").agg(F.max(spot).alias("last"))
    edges = two.select("src", F.col("range").alias("low")).join(edge, "src", "left")
    edges = materialize(edges, "edges")

    final = ranked.join(edges, "src", "left")
    inside = F.when(low < F.col("low"), True).when(low > F.col("low"), False).otherwise(spot <= F.col("last"))
    extra = F.when(F.col("key").isNull(), False).when(F.col("low").isNull(), True).otherwise(F.coalesce(inside, F.lit(False)))
    copies = F.col("sure") + extra.cast("int")
    return final.select(
        *PLACE,
        "doc_id",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (F.col("size") * copies).cast("long").alias("taken"),
    )


def report(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row."""
    return allocate(docs, seed).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with each row as often as it was allocated copies."""
    placed = with_place(docs)
    chosen = allocate(placed, seed).filter("copies > 0").select(*PLACE, F.col("copies").alias("__copies"))
    # Merged at every size: a list of rows grows with the input and is never broadcast.
    out = placed.join(materialize(chosen, "copies").hint("merge"), PLACE)
    each = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return each.drop("__copy", "__copies", *PLACE)
