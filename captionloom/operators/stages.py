"""Stages the caller plugs in: batched models and per-row functions that may fail."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def map_batches(
    make_model: Callable, column: Column | str, return_type: T.DataType, batch_size: int = 8, shape: list[int] | None = None
) -> Column:
    """A model over array rows in batches. ``make_model`` runs once per Python worker."""
    stage = predict_batch_udf(
        make_model, return_type=return_type, batch_size=batch_size, input_tensor_shapes=[shape] if shape else None
    )
    return stage(F.col(column) if isinstance(column, str) else column)


def map_values(make_model: Callable, column: Column | str, return_type: str, batch_size: int = 8) -> Column:
    """A model over values of any type, image bytes for one, in lists of ``batch_size``.

    ``make_model`` runs once per task; it gives a function from a list of values to a list of results.
    """

    @F.pandas_udf(return_type)
    def stage(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for batch in batches:
            out: list = []
            for at in range(0, len(batch), batch_size):
                out += list(model(batch.iloc[at : at + batch_size].to_list()))
            yield pd.Series(out, index=batch.index, dtype=object)

    return stage(F.col(column) if isinstance(column, str) else column)


def try_map(fn: Callable, column: Column | str, return_type: str) -> Column:
    """``fn`` per value as a struct of ``value`` and ``error``; one bad row fails only itself."""

    @F.pandas_udf(f"value {return_type}, error string")
    def stage(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            try:
                out.append((fn(v), None))
            except Exception as e:  # any failure of the caller's code marks the row
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["value", "error"])

    return stage(F.col(column) if isinstance(column, str) else column)


def split_bad(df: DataFrame, result: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Good rows with ``value``, and the quarantine of rows with ``error``.

    A null value without an error is a row the stage chose to drop; it counts as dropped.
    """
    keep = [c for c in df.columns if c != result]
    good = df.filter(F.col(f"{result}.error").isNull() & F.col(f"{result}.value").isNotNull())
    bad = df.filter(F.col(f"{result}.error").isNotNull() | F.col(f"{result}.value").isNull())
    reason = F.coalesce(F.col(f"{result}.error"), F.lit("dropped"))
    return (
        good.select(*keep, F.col(f"{result}.value").alias(value)),
        bad.select(*keep, reason.alias("error")),
    )


def error_counts(df: DataFrame, result: str) -> DataFrame:
    """How many rows passed, were dropped, and failed by kind of error."""
    kind = (
        F.when(F.col(f"{result}.error").isNotNull(), F.substring_index(f"{result}.error", ":", 1))
        .when(F.col(f"{result}.value").isNull(), "dropped")
        .otherwise("ok")
    )
    return df.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))
