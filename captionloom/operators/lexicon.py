"""Word and character tables of a caption corpus."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Mark of a word start, share of characters kept.
WORD_START = "▁"
COVERAGE = 0.9995


@F.pandas_udf(T.StringType())
def _nfkc(words: pd.Series) -> pd.Series:
    return words.map(lambda w: unicodedata.normalize("NFKC", w))


def word_counts(corpus: DataFrame, caption: str = "caption", max_bytes: int | None = None) -> DataFrame:
    """``word, n`` over space-separated words. Counts are combined map-side.

    ``max_bytes`` leaves out longer lines, for who wants that.
    """
    lines = corpus.filter(F.octet_length(caption) <= max_bytes) if max_bytes else corpus
    words = lines.select(F.explode(F.split(caption, " ")).alias("word")).filter("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def training_words(corpus: DataFrame, caption: str = "caption", max_bytes: int | None = None) -> DataFrame:
    """``word, n`` with compatibility forms composed and the word start marked. All texts count.

    Normalising happens once per distinct word; what falls together is added up.
    """
    counted = word_counts(corpus, caption, max_bytes).select(_nfkc("word").alias("w"), "n")
    parts = counted.select(F.explode(F.split("w", r"[\s\x{A0}]+")).alias("w"), "n").filter("w <> ''")
    return parts.groupBy(F.concat(F.lit(WORD_START), "w").alias("word")).agg(F.sum("n").alias("n"))


def char_counts(words: DataFrame) -> DataFrame:
    """``char, n`` weighted by word frequency."""
    chars = words.select(F.explode(F.split("word", "")).alias("char"), "n").filter("char <> ''")
    return chars.groupBy("char").agg(F.sum("n").alias("n"))


def char_coverage(words: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``char, n, share_before, kept``: the most frequent characters up to the wanted share.

    One row per distinct character, so the running sum is over the alphabet, not the corpus.
    """
    counts = char_counts(words)
    ordered = W.orderBy(F.desc("n"), "char")
    before = F.coalesce(F.sum("n").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(W.partitionBy())
    shared = counts.withColumn("share_before", before / total)
    return shared.withColumn("kept", F.col("share_before") < coverage)
