"""Fixed-length token rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ids of the special pieces and the context length.
PAD_ID = 0
BOS_ID = 1
EOS_ID = 2
UNK_ID = 3
NULL_ID = 4
SPECIAL_PIECES = {"<pad>": 0, "<s>": 1, "</s>": 2, "<unk>": 3, "<null>": 4}
CONTEXT_LENGTH = 77


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pad_truncate(ids: Column | str, length: int = CONTEXT_LENGTH, pad_id: int = PAD_ID) -> Column:
    """Exactly ``length`` ids: cut on the right, or filled with the pad id."""
    filled = F.concat(_col(ids).cast("array<int>"), F.array_repeat(F.lit(pad_id), length))
    return F.slice(filled, 1, length)


def attention_mask(tokens: Column | str, pad_id: int = PAD_ID) -> Column:
    return F.transform(_col(tokens), lambda t: (t != pad_id).cast("int"))


def null_tokens(length: int = CONTEXT_LENGTH) -> Column:
    """The token row of the empty prompt: the null id, then padding."""
    return F.concat(F.array(F.lit(NULL_ID)), F.array_repeat(F.lit(PAD_ID), length - 1))


def check_length(tokens: Column | str, length: int = CONTEXT_LENGTH) -> Column:
    """The tokens unchanged; the job fails where a row is longer than the context."""
    col = _col(tokens)
    fits = F.size(col) <= length
    return F.when(fits, col).otherwise(
        F.raise_error(F.format_string("token row of %d exceeds context length %d", F.size(col), F.lit(length)))
        .cast("array<int>")
    )
