"""Ordered work on metric series, split so that no series has to fit one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from captionloom.operators.ordering import range_chunks


def log_latest(log: DataFrame, keys: list[str], timestamp: str = "timestamp") -> DataFrame:
    """The latest record of each key, where a resumed run logged a step again.

    The maximum of a struct, combined map-side: repeats of one key are never gathered.
    """
    rest = [c for c in log.columns if c not in (*keys, timestamp)]
    latest = F.max(F.struct(F.col(timestamp).alias("_ts"), *rest)).alias("_latest")
    return log.groupBy(*keys).agg(latest).select(
        *keys, F.col("_latest._ts").alias(timestamp), *[F.col(f"_latest.{c}").alias(c) for c in rest]
    )


def previous_in_series(
    df: DataFrame, series: str, order: list[str], columns: dict[str, str]
) -> DataFrame:
    """Adds the value of the preceding row in the series: ``columns`` maps source to new name.

    The lag runs on the sorted chunks as they are made, without another exchange; the first row of a
    series in a chunk takes it from the last row before it.
    """
    needed = list(dict.fromkeys([*order, *columns]))

    def stage(chunks: DataFrame) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
        types = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
        more = ", ".join(f"`_p{i}` {types[c]}" for i, c in enumerate(columns))

        def lag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, last = None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = batch.column(series)
                same = pc.equal(keys[1:], keys[:-1]).fill_null(False) if len(keys) > 1 else pa.array([], pa.bool_())
                begins = last is not None and keys[0].as_py() == name
                fresh = pa.concat_arrays([pa.array([not begins]), pc.invert(same)])
                added = []
                for c in columns:
                    values = batch.column(c)
                    head = pa.array([last[c] if begins else None], values.type)
                    shifted = pa.concat_arrays([head, values[:-1]])
                    added.append(pc.if_else(fresh, pa.scalar(None, values.type), shifted))
                name, last = keys[-1].as_py(), {c: batch.column(c)[-1].as_py() for c in needed}
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *added, fresh], names=[*batch.schema.names, *[f"_p{i}" for i in range(len(added))], "_first"]
                )

        return chunks.mapInArrow(lag, f"{fields}, {more}, _first boolean")

    lagged = range_chunks(df, [series, *order], stage)
    # One row per chunk and series from here on.
    last = lagged.groupBy(series, "_chunk").agg(F.max(F.struct(*needed)).alias("_last"))
    handed = last.select(series, "_chunk", F.lag("_last").over(W.partitionBy(series).orderBy("_chunk")).alias("_in"))
    joined = lagged.join(handed, [series, "_chunk"], "left")
    filled = {
        new: F.when(F.col("_first"), F.col(f"_in.{old}")).otherwise(F.col(f"_p{i}"))
        for i, (old, new) in enumerate(columns.items())
    }
    return joined.withColumns(filled).drop("_chunk", "_place", "_first", "_in", *[f"_p{i}" for i in range(len(columns))])


def throughput(log: DataFrame, series: str, step: str = "step", timestamp: str = "timestamp") -> DataFrame:
    """Steps per second between consecutive logged steps of a series."""
    seen = previous_in_series(log, series, [step], {step: "prev_step", timestamp: "prev_timestamp"})
    seconds = F.unix_micros(timestamp) - F.unix_micros("prev_timestamp")
    rate = (F.col(step) - F.col("prev_step")) * 1e6 / seconds
    return seen.withColumn("steps_per_sec", F.when(seconds > 0, rate)).drop("prev_timestamp")


def metric_buckets(log: DataFrame, series: str, interval: int, step: str = "step", value: str = "value") -> DataFrame:
    """Per range of ``interval`` steps: count, mean, last value, and intervals missing before."""
    bucket = F.floor(F.col(step) / interval).cast("bigint")
    made = log.groupBy(series, bucket.alias("bucket")).agg(
        F.count("*").alias("n"),
        F.avg(value).alias("mean_value"),
        F.max(F.struct(step, value)).alias("_last"),
    )
    made = made.select(series, "bucket", "n", "mean_value", F.col(f"_last.{value}").alias("last_value"))
    seen = previous_in_series(made, series, ["bucket"], {"bucket": "_prev"})
    gap = F.coalesce(F.col("bucket") - F.col("_prev") - 1, F.lit(0).cast("bigint"))
    return seen.withColumn("missing_before", gap).drop("_prev")


EMA_BLOCK = 128


def _running(x: np.ndarray, before: float, d: float) -> np.ndarray:
    """s <- d s + (1-d) x along ``x`` from ``before``, a block of rows to a matrix product."""
    steps = np.arange(EMA_BLOCK)
    weights = np.tril((1.0 - d) * d ** np.clip(steps[:, None] - steps[None, :], 0, None))
    fades = d ** (steps + 1.0)
    out = np.empty(len(x))
    for at in range(0, len(x), EMA_BLOCK):
        part = x[at : at + EMA_BLOCK]
        m = len(part)
        out[at : at + m] = weights[:m, :m] @ part + fades[:m] * before
        before = out[at + m - 1]
    return out


def ema_local(
    df: DataFrame, series: str, order: list[str], value: str, decay: float, store: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """The table in chunks, each averaged as if from zero (``_local``), with the count of values so far (``_n``)."""
    d = float(decay)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, s, n = None, 0.0, 0
        for batch in batches:
            values = batch.column(value)
            known = np.asarray(values.is_valid().to_numpy(zero_copy_only=False), bool)
            x = pc.fill_null(pc.cast(values, pa.float64()), 0.0).to_numpy(zero_copy_only=False)
            names, chunks = batch.column(series), batch.column("_chunk").to_numpy(zero_copy_only=False)
            codes = names.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            local, count = np.zeros(len(x)), np.zeros(len(x), np.int64)
            cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(chunks) != 0)) + 1
            for first, end in zip([0, *cuts], [*cuts, len(x)]):
                if first == end:
                    continue
                key = (names[int(first)].as_py(), int(chunks[first]))
                if key != here:
                    here, s, n = key, 0.0, 0
                live = np.flatnonzero(known[first:end]) + first
                local[live] = _running(x[live], s, d)
                count[live] = n + 1 + np.arange(len(live))
                if len(live):
                    s, n = local[live[-1]], n + len(live)
            mask = ~known
            added = [pa.array(local, pa.float64(), mask=mask), pa.array(count, pa.int64(), mask=mask)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added], names=[*batch.schema.names, "_local", "_n"]
            )

    def stage(chunks: DataFrame) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
        return chunks.mapInArrow(scan, f"{fields}, _local double, _n bigint")

    return range_chunks(df, [series, *order], stage, store=store)


def ema_ends(local: DataFrame, series: str, value: str) -> DataFrame:
    """What each chunk adds to a series, one row each: ``n`` values, their average ``local`` from zero, the first value."""
    live = local.filter(F.col("_n").isNotNull())
    ends = live.groupBy(series, "_chunk").agg(
        F.max(F.struct("_n", "_local")).alias("_end"), F.min(F.struct("_n", F.col(value).cast("double").alias("x"))).alias("_head")
    )
    return ends.select(
        series, "_chunk", F.col("_end._n").alias("n"), F.col("_end._local").alias("local"), F.col("_head.x").alias("head")
    )


def ema_series(df: DataFrame, series: str, order: list[str], value: str, decay: float = 0.999) -> DataFrame:
    """Adds ``ema``: s <- d s + (1-d) x along each series, seeded with its first value.

    The recurrence is linear, so each chunk is run from zero, and what came before it
    is added as carry * d^position. Carries are folded over the chunk ends, a few rows
    per series. A null value has no average and leaves the state as it is.
    """
    d = float(decay)
    local = ema_local(df, series, order, value, d)
    # At most one entry per chunk and series, folded once from the first to the last.
    end = F.struct("_chunk", "n", "local", "head")
    listed = ema_ends(local, series, value).groupBy(series).agg(F.sort_array(F.collect_list(end)).alias("_ends"))

    def carry(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i, name in enumerate(batch.column(0)):
                ends = batch.column(1)[i].as_py()
                carries, _ = fold_ends(ends, None, d)
                chunks = [end["_chunk"] for end in ends]
                names = pa.array([name.as_py()] * len(chunks), batch.column(0).type)
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(chunks, pa.int64()), pa.array(carries, pa.float64())], [series, "_chunk", "_carry"]
                )

    kind = df.schema[series].dataType.simpleString()
    carries = listed.mapInArrow(carry, f"`{series}` {kind}, _chunk bigint, _carry double")
    joined = local.join(carries, [series, "_chunk"], "left")
    ema = F.col("_local") + F.col("_carry") * F.pow(F.lit(d), F.col("_n"))
    return joined.withColumn("ema", ema).drop("_chunk", "_place", "_local", "_n", "_carry")


def fold_ends(ends: list[dict], state: float | None, d: float) -> tuple[list[float], float | None]:
    """The average before each of the chunks, in order, and the one after the last; the first value seeds it."""
    carries = []
    for end in ends:
        state = end["head"] if state is None else state
        carries.append(state)
        state = state * d ** end["n"] + end["local"]
    return carries, state
