"""Applying a vocabulary: text to ids and back, and how the vocabulary is used."""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from captionloom.functions.tokens import (
    BOS_ID, CONTEXT_LENGTH, EOS_ID, NULL_ID, PAD_ID, SPECIAL_PIECES, UNK_ID, attention_mask, null_tokens, pad_truncate,
)
from captionloom.operators.lexicon import WORD_START, training_words

MAX_VOCAB = 1_000_000
_NULL_TEXT = "<null>"
_MEMO_WORDS = 500_000
#: Characters of text whose ids are made before they are handed on.
_PART_CHARS = 2_000_000


def vocab_rows(vocab: DataFrame) -> list[tuple[int, str, float]]:
    """The vocabulary on the driver; refused beyond a size that is safe to send to every task."""
    rows = vocab.select("id", "piece", "score").orderBy("id").limit(MAX_VOCAB + 1).collect()
    if len(rows) > MAX_VOCAB:
        raise ValueError(f"vocabulary has more than {MAX_VOCAB} pieces")
    return [tuple(r) for r in rows]


def _merge_word(word: str, pieces: dict[str, tuple[int, float]]) -> list[int]:
    """Ids of one stretch: always merge the adjacent pair with the best score, leftmost first."""
    parts: list[str | None] = list(word)
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if i >= 0 and j < len(parts):
            joined = parts[i] + parts[j]
            if joined in pieces:
                heapq.heappush(heap, (-pieces[joined][1], i, joined))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != joined:
            continue
        parts[i], parts[j] = joined, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    ids: list[int] = []
    for part in parts:
        if part is not None:
            new = pieces[part][0] if part in pieces else UNK_ID
            if new != UNK_ID or not ids or ids[-1] != UNK_ID:
                ids.append(new)
    return ids


def _encoder(rows: list[tuple[int, str, float]]) -> Callable[[str], list[int]]:
    pieces = {p: (i, s) for i, p, s in rows if i >= len(SPECIAL_PIECES)}
    memo: dict[str, list[int]] = {}

    def encode_word(word: str) -> list[int]:
        known = memo.get(word)
        if known is None:
            known = []
            for n, stretch in enumerate(word.split(_NULL_TEXT)):
                known = known + ([NULL_ID] if n else []) + (_merge_word(stretch, pieces) if stretch else [])
            if len(memo) >= _MEMO_WORDS:
                memo.clear()
            memo[word] = known
        return known

    return encode_word


def bpe_encode(text: Column | str, vocab: DataFrame) -> Column:
    """All ids of a text, lower-cased; no start or end id.

    A narrow Arrow stage: words of a text are looked up in a memo of words already merged, so
    that repeated words cost a dictionary access and nothing is shuffled.
    """
    rows = vocab_rows(vocab)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode_word = _encoder(rows)

        def one(line: str) -> list[int]:
            words = unicodedata.normalize("NFKC", line).split()
            return [i for w in words for i in encode_word(WORD_START + w)]

        # Ids are four bytes each at once, not a Python list per text of the batch.
        kind = pa.list_(pa.int32())
        for batch in batches:
            sizes = np.cumsum(pc.utf8_length(batch).to_numpy(zero_copy_only=False)) // _PART_CHARS
            starts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(batch)]
            parts = [pa.array([one(line.as_py()) for line in batch.slice(a, b - a)], kind) for a, b in zip(starts, starts[1:])]
            yield pa.concat_arrays(parts)

    return encode(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))))


def token_rows(df: DataFrame, vocab: DataFrame, caption: str = "caption", length: int = CONTEXT_LENGTH) -> DataFrame:
    """Adds ``tokens`` and ``mask`` of fixed length and ``n_tokens`` before the cut."""
    coded = df.withColumn("_ids", bpe_encode(caption, vocab))
    return coded.select(
        *df.columns,
        pad_truncate("_ids", length).alias("tokens"),
        attention_mask(pad_truncate("_ids", length)).alias("mask"),
        F.size("_ids").alias("n_tokens"),
    )


def bpe_decode(ids: Column | str, vocab: DataFrame) -> Column:
    """Text of the ids. The pieces are one constant array, so decoding is a lookup per id."""
    rows = vocab_rows(vocab)
    listed = [""] * (max(i for i, _, _ in rows) + 1)
    for i, piece, _ in rows:
        listed[i] = piece
    listed[UNK_ID] = " ⁇ "
    listed[PAD_ID] = listed[BOS_ID] = listed[EOS_ID] = ""
    pieces = F.split(F.lit("\n".join(listed)), "\n", -1)
    ids = F.col(ids) if isinstance(ids, str) else ids
    text = F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "", "")
    return F.regexp_replace(F.replace(text, F.lit(WORD_START), F.lit(" ")), "^ ", "")


def vocab_usage(corpus: DataFrame, vocab: DataFrame, caption: str = "caption") -> DataFrame:
    """``id, piece, n, share``: how often each piece is used in a corpus.

    Words are counted first, and each distinct word is encoded once.
    """
    rows = vocab_rows(vocab)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode_word = _encoder(rows)
        for words in batches:
            yield words.map(encode_word)

    words = training_words(corpus, caption)
    used = words.select(F.explode(encode("word")).alias("id"), "n").groupBy("id").agg(F.sum("n").alias("n"))
    # One row per piece from here on: the total over all of them is a small window.
    shared = used.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))
    return shared.join(F.broadcast(vocab.select("id", "piece")), "id").select("id", "piece", "n", "share")


def token_report(rows: DataFrame, length: int = CONTEXT_LENGTH) -> DataFrame:
    """Rows, mean length, share of rows cut off and share of unknown ids, in one pass."""
    unknown = F.size(F.filter("tokens", lambda t: t == UNK_ID))
    return rows.agg(
        F.count("*").alias("rows"),
        F.avg("n_tokens").alias("mean_tokens"),
        F.avg((F.col("n_tokens") > length).cast("double")).alias("truncated_share"),
        (F.sum(unknown) / F.sum(F.aggregate("mask", F.lit(0), lambda a, m: a + m))).alias("unknown_share"),
    )


def with_null_rows(rows: DataFrame, key: str = "key", length: int = CONTEXT_LENGTH) -> DataFrame:
    """Every prompt twice: with the null prompt (``is_uncond``) and as it is, for guidance. The prompts are made once."""
    keep = [c for c in rows.columns if c not in ("tokens", "mask")]
    empty = null_tokens(length)
    forms = F.array(
        F.struct(empty.alias("tokens"), attention_mask(empty).alias("mask"), F.lit(True).alias("is_uncond")),
        F.struct("tokens", "mask", F.lit(False).alias("is_uncond")),
    )
    return rows.select(*keep, F.inline(forms))
