"""Caption cleaning as column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The shape of an HTML character reference (HTML Living Standard, as in
# Python's html.unescape), of a tag, and Python's notion of whitespace spelled out for Java.
CHARREF = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
TAG = r"<[^>]+>"
# Single characters below 256 are one table for Java, and the rest is behind one range: most characters need two tests.
_SPACES = r" \t\n\x0B\f\r\x1C\x1D\x1E\x1F\x85\xA0[\u1680-\u3000&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]"
# Any run of whitespace but a lone plain space, which would be replaced by itself.
WHITESPACE = rf"[{_SPACES}](?:(?<! )[{_SPACES}]*+|[{_SPACES}]++)"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _decode(refs: pd.Series) -> pd.Series:
    return refs.map(lambda found: [html.unescape(r) for r in found])


# Repeatable, but declared otherwise: else a later test on the cleaned text would be moved below
# the projection, and every text cleaned twice.
_decode_references = _decode.asNondeterministic()


def unescape_html(col: Column) -> Column:
    """Resolve HTML character references once.

    The JVM cuts the references out and puts the text together again, so that Python sees
    only the references themselves: an empty array for most rows, never the whole text.
    """
    refs = F.regexp_extract_all(col, F.lit(CHARREF), F.lit(0))
    gaps = F.split(col, CHARREF, -1)
    decoded = _decode_references(refs)
    woven = F.zip_with(gaps, decoded, lambda gap, ref: F.concat(gap, F.coalesce(ref, F.lit(""))))
    return F.when(F.contains(col, F.lit("&")), F.array_join(woven, "")).otherwise(col)


def clean_markup(col: Column) -> Column:
    """Tags to spaces, whitespace runs to one space, trimmed, lower case."""
    spaced = F.regexp_replace(F.regexp_replace(col, TAG, " "), WHITESPACE, " ")
    return F.lower(F.trim(spaced))


def clean_caption(col: Column | str) -> Column:
    """Null to empty, references resolved, then tags, spaces and case normalised."""
    col = F.col(col) if isinstance(col, str) else col
    return clean_markup(unescape_html(F.coalesce(col.cast("string"), F.lit(""))))


def clean_rows(df: DataFrame, text: Column | str, *keep: str) -> DataFrame:
    """Columns ``keep`` and ``caption``: the cleaned text, of rows where something is left of it.

    The test is a filter inside the row's array. As a filter of the table it would be moved below the projection once Spark has
    taken the Python part out, and every text would be cleaned for the test and again for the result.
    """
    return df.select(*keep, F.explode(F.filter(F.array(clean_caption(text)), lambda c: c != "")).alias("caption"))


def first_truthy(df: DataFrame, *names: str) -> Column:
    """First non-empty of the named columns, in order; absent columns are passed over.

    An empty string falls through to the next name, a blank one does not. Null if all fail.
    """
    present = [F.col(n).cast("string") for n in names if n in df.columns]
    if not present:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in present])


def clamp_text(col: Column | str, max_len: int = 512) -> Column:
    """The first ``max_len`` code points, not trimmed again."""
    col = F.col(col) if isinstance(col, str) else col
    return F.substring(col, 1, max_len)
