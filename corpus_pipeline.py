"""Documents to a training set: five stages, each written as Parquet and read again by the next.

Language (rejected documents go), near-duplicates (one document of each group stays), benchmark passages
(contaminated documents go), source weights (documents leave or come twice), shards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionloom.llm import decontaminate, langid, mixing, sharding, simhash
from captionloom.llm.common import PLACE, table, with_place
from captionloom.session import fresh_dir, materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found; those without letters, or between two languages, go."""
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked fingerprints the document with the smallest id, null last."""
    placed = with_place(docs)
    prints = simhash.written_prints(placed, [*PLACE, "doc_id"])
    groups = simhash.groups_of(prints)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", *PLACE)
    first = F.min(F.struct(order.alias("order"), *PLACE)).alias("first")
    # Equal fingerprints are put together first, so that a large group is many small sums.
    firsts = materialize(prints.groupBy("fp").agg(first), "firsts")
    kept = firsts.join(groups, "fp").groupBy("group").agg(F.min("first").alias("first"))
    places = materialize(kept.select(*[F.col(f"first.{c}").alias(c) for c in PLACE]), "kept")
    # Merged at every size: a list of kept rows grows with the input and is never broadcast.
    return placed.join(places.hint("merge"), PLACE, "left_semi").drop(*PLACE)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no passage of the benchmark, passages without an id among them."""
    items = table(spark, sf_dir, "benchmark")
    # Nobody is told which item it was: a passage counts whether or not it has a name.
    items = items.withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("")))
    return decontaminate.decontaminate(docs, items)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, none to two times."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their place in it."""
    return sharding.with_shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", clean_of_benchmark),
    ("mixing", mix),
    ("sharding", shard),
]

#: Language identification is a trained model: SQL cannot say it. The tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
