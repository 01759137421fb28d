"""Row policies: which metadata rows are kept, and why the others are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionloom.functions.text import clamp_text, clean_caption, first_truthy

# Flags that mark a row as unsafe, compared in lower case.
UNSAFE_FLAGS = ("nsfw", "unsafe", "porn", "sexual", "1")

# Reasons of the funnel, in the order in which rows are tested.
UNSAFE, NO_URL, NO_CAPTION, NO_PAYLOAD, UNDECODABLE, KEPT = (
    "unsafe", "no_url", "no_caption", "no_payload", "undecodable", "kept",
)


def safety_flag(df: DataFrame) -> Column:
    """The flag of a row: column ``NSFW`` if the table has it, else ``nsfw``.

    Presence decides, not content: a null ``NSFW`` does not fall through to ``nsfw``.
    """
    for name in ("NSFW", "nsfw"):
        if name in df.columns:
            return F.lower(F.coalesce(F.col(name).cast("string"), F.lit("none")))
    return F.lit("")


def is_safe(df: DataFrame) -> Column:
    return ~safety_flag(df).isin(*UNSAFE_FLAGS)


def with_reason(df: DataFrame) -> DataFrame:
    """Adds ``url``, ``caption`` and ``reason``: the first test a row fails, else ``kept``.

    Nothing is dropped here, so one pass serves both the filter and its account.
    """
    tagged = df.withColumns(
        {
            "_safe": is_safe(df),
            "_url": first_truthy(df, "URL", "url"),
            "_caption": clean_caption(first_truthy(df, "TEXT", "text", "caption")),
        }
    )
    keep = [c for c in df.columns if c not in ("URL", "url", "TEXT", "text", "caption", "NSFW", "nsfw")]
    reason = (
        F.when(~F.col("_safe"), UNSAFE)
        .when(F.coalesce(F.col("_url"), F.lit("")) == "", NO_URL)
        .when(F.col("_caption") == "", NO_CAPTION)
        .otherwise(KEPT)
    )
    return tagged.select(
        *keep, F.col("_url").alias("url"), F.col("_caption").alias("caption"), reason.alias("reason")
    )


def safe_captions(df: DataFrame, max_len: int = 512) -> DataFrame:
    """Safe rows with a URL and a caption; the caption clamped.

    Same rows as ``with_reason`` marks ``kept``. The flag and URL tests are written before the
    cleaning, so that only rows which pass them are cleaned.
    """
    keep = [c for c in df.columns if c not in ("URL", "url", "TEXT", "text", "caption", "NSFW", "nsfw")]
    url = first_truthy(df, "URL", "url")
    cheap = df.filter(is_safe(df) & url.isNotNull())
    cleaned = cheap.select(
        *keep, url.alias("url"), clean_caption(first_truthy(df, "TEXT", "text", "caption")).alias("caption")
    )
    return cleaned.filter(F.col("caption") != "").withColumn("caption", clamp_text("caption", max_len))


def limit_input(df: DataFrame, n: int | None, idx: str = "idx") -> DataFrame:
    """Rows with input index below ``n``; 0 or None keeps all. Ordered, unlike a bare limit."""
    return df.filter(F.col(idx) < n) if n else df


def drop_empty_caption(df: DataFrame, caption: str = "caption") -> DataFrame:
    return df.filter(F.coalesce(F.col(caption), F.lit("")) != "")
