"""Streaming counterparts: new files in, tables, shards and running metrics out.

Every job takes a checkpoint folder, and writes what a micro-batch produced under the batch's
number, so that a batch run again after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from captionloom.functions.text import clamp_text
from captionloom.functions.tokens import CONTEXT_LENGTH, attention_mask, pad_truncate
from captionloom.operators.encode import bpe_encode
from captionloom.operators.filters import KEPT, with_reason
from captionloom.operators.ordering import SPOT, global_rank, rank_by_spot, sample_key, shard_id, with_spot
from captionloom.operators.series import ema_ends, ema_local, fold_ends
from captionloom.session import drop_path, fresh_dir, make_path
from captionloom.sources.shards import write_shards
from captionloom.sources.vocab import vocab_fingerprint


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """A stateless transform of new rows, appended to Parquet exactly once."""
    rows = transform(stream)
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def pin(spark: SparkSession, checkpoint: str, name: str, value: str) -> None:
    """Writes a value beside a checkpoint once, and refuses to go on from the checkpoint with another one."""
    path = f"{checkpoint.rstrip('/')}-{name}"
    try:
        found = [r["value"] for r in spark.read.text(path).collect()]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = []
    if not found:  # never written, or not to the end
        spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    elif found != [value]:
        raise ValueError(f"{checkpoint} was begun with {name} {found[0]}, not {value}")


def ingest_tokens(
    stream: DataFrame,
    vocab: DataFrame,
    out: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] = with_reason,
    caption: str = "caption",
    length: int = CONTEXT_LENGTH,
    max_len: int = 512,
) -> StreamingQuery:
    """New metadata rows to token rows, those that are dropped to a quarantine, both in one pass over a micro-batch.

    ``prepare`` adds a ``reason`` to each row, ``kept`` or why not. Kept rows get ``tokens``, ``mask``, ``n_tokens`` and the
    fingerprint of the vocabulary; the others keep their reason. The fingerprint is pinned beside the checkpoint: rows of
    one folder are all made with one vocabulary, also after a restart. A batch that runs again replaces both its parts.
    """
    spark = stream.sparkSession
    stamp = vocab_fingerprint(vocab)
    pin(spark, checkpoint, "vocab_sha1", stamp)
    kept = F.col("reason") == KEPT
    ids = bpe_encode(F.when(kept, clamp_text(caption, max_len)), vocab)

    def write(batch: DataFrame, batch_id: int) -> None:
        coded = prepare(batch).withColumn("_ids", ids)
        only = lambda c: F.when(kept, c)
        rows = coded.withColumns(
            {
                "tokens": only(pad_truncate("_ids", length)),
                "mask": only(attention_mask(pad_truncate("_ids", length))),
                "n_tokens": only(F.size("_ids")),
                "vocab_sha1": only(F.lit(stamp)),
                "sink": F.when(kept, "rows").otherwise("quarantine"),
            }
        ).drop("_ids")
        rows.write.mode("overwrite").partitionBy("sink").parquet(f"{out}/batch_id={batch_id}")

    return _each_batch(stream, write, checkpoint)


def token_sink(spark: SparkSession, out: str) -> DataFrame:
    """The token rows that ``ingest_tokens`` has written so far."""
    return spark.read.parquet(out).filter("sink = 'rows'").drop("sink", "reason")


def quarantine_sink(spark: SparkSession, out: str) -> DataFrame:
    """The rows that it has dropped, with their reason."""
    return spark.read.parquet(out).filter("sink = 'quarantine'").drop("sink", "tokens", "mask", "n_tokens", "vocab_sha1")


def _each_batch(stream: DataFrame, fn, checkpoint: str, mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    return writer.outputMode(mode).trigger(availableNow=True).start()


def write_batch(df: DataFrame, out: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")


@contextmanager
def _staged(batch: DataFrame) -> Iterator[DataFrame]:
    """A micro-batch written down for the steps that read it more than once, and taken away after them."""
    spark = batch.sparkSession
    path = fresh_dir(spark, "microbatch")
    batch.write.parquet(path)
    try:
        yield spark.read.schema(batch.schema).parquet(path)
    finally:
        drop_path(spark, path)


def shard_stream(stream: DataFrame, key: str, members, out: str, checkpoint: str, shard_size: int = 1000) -> StreamingQuery:
    """Each micro-batch as tar shards named by batch and shard number.

    ``members`` is the map column of a sample's files. Rows are written down once to be ranked by key; ``shards.shard_sink``
    does without that, and names tars by task.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with _staged(batch.select(F.col(key).alias("idx"), members.alias("members"))) as rows:
            ranked = rank_by_spot(with_spot(rows), ["idx"], lambda keys: global_rank(keys, ["idx", *SPOT], "kept_rank"))
            shard = F.concat(F.lit(f"{batch_id:06d}-"), shard_id("kept_rank", shard_size))
            write_shards(ranked.select(shard.alias("shard"), sample_key("idx").alias("key"), "members"), out, replace=True)

    return _each_batch(stream, write, checkpoint)


def metric_windows(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    duration: str = "1 day",
    slide: str | None = None,
    lateness: str = "1 hour",
    timestamp: str = "timestamp",
    series: str = "series",
    value: str = "value",
) -> StreamingQuery:
    """Count and mean per series and time window; rows later than the watermark are dropped.

    Windows changed by a micro-batch are written with its number: ``latest_windows`` reads
    the table so far, open windows included, without a sink that gathers it on the driver.
    """
    at = F.col(timestamp).cast("timestamp")
    timed = stream.withColumn(timestamp, at).withWatermark(timestamp, lateness)
    span = F.window(timestamp, duration, slide) if slide else F.window(timestamp, duration)
    windows = timed.groupBy(span.alias("w"), F.col(series)).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean_value")
    )
    flat = windows.select(series, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_value")
    return _each_batch(flat, lambda batch, i: write_batch(batch, out, i), checkpoint, "update")


def _newest(rows: DataFrame, series: str) -> DataFrame:
    last = rows.groupBy(series, "start", "end").agg(F.max(F.struct("batch_id", "n", "mean_value")).alias("_last"))
    return last.select(series, "start", "end", "_last.n", "_last.mean_value", "_last.batch_id")


def _compacted(spark: SparkSession, out: str) -> int:
    """The last micro-batch that a finished snapshot of ``out`` holds; -1 without one."""
    try:
        return spark.read.parquet(f"{out}-snapshot/done").agg(F.max("through")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1


def _window_rows(spark: SparkSession, out: str) -> tuple[DataFrame, int]:
    """The snapshot, if there is one, and what was written after it."""
    through = _compacted(spark, out)
    rows = spark.read.parquet(out).withColumn("batch_id", F.col("batch_id").cast("long")).filter(F.col("batch_id") > through)
    if through >= 0:
        rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{out}-snapshot/through={through}"))
    return rows, through


def latest_windows(spark: SparkSession, out: str, series: str = "series") -> DataFrame:
    """The last state written of each window: reads the last snapshot and the micro-batches after it."""
    return _newest(_window_rows(spark, out)[0], series).drop("batch_id")


def compact_windows(spark: SparkSession, out: str, series: str = "series") -> None:
    """Puts all micro-batches but the last, which may be written again, into a snapshot of one row a window.

    A snapshot counts once its mark is written; only then the micro-batches in it and the snapshot before it are
    dropped, so a run that was stopped can be repeated. One caller at a time; the stream may go on.
    """
    rows, before = _window_rows(spark, out)
    written = [r[0] for r in spark.read.parquet(out).select(F.col("batch_id").cast("long")).distinct().collect()]
    through = max(written) - 1
    if through > before:
        closed = _newest(rows.filter(F.col("batch_id") <= through), series)
        closed.write.mode("overwrite").parquet(f"{out}-snapshot/through={through}")
        mark = spark.createDataFrame([(through,)], "through long")
        mark.coalesce(1).write.mode("append").parquet(f"{out}-snapshot/done")
        if before >= 0:
            drop_path(spark, f"{out}-snapshot/through={before}")
    for batch_id in written:
        if batch_id <= through:
            drop_path(spark, f"{out}/batch_id={batch_id}")


def ema_local_stream(
    stream: DataFrame, series: str, order: list[str], value: str, out: str, checkpoint: str, decay: float = 0.999
) -> StreamingQuery:
    """First half of ``ema_stream``: a micro-batch in chunks averaged from zero, and what each chunk adds to its series.

    A series with a large part of the batch lies in many chunks. A batch that runs again replaces both its tables.
    """
    spark = stream.sparkSession
    pin(spark, checkpoint, "decay", repr(float(decay)))
    make_path(spark, f"{out}/ends")

    def chunked(batch: DataFrame, batch_id: int) -> None:
        def store(chunks: DataFrame) -> DataFrame:
            write_batch(chunks.drop("_place"), f"{out}/rows", batch_id)
            return spark.read.schema(chunks.drop("_place").schema).parquet(f"{out}/rows/batch_id={batch_id}")

        spark = batch.sparkSession
        with _staged(batch) as rows:
            local = ema_local(rows, series, order, value, decay, store)
            # A few rows a series, so few files.
            write_batch(ema_ends(local, series, value).coalesce(1), f"{out}/ends", batch_id)

    return _each_batch(stream, chunked, checkpoint)


def ema_carry_stream(spark: SparkSession, series: str, kind: str, out: str, checkpoint: str, decay: float = 0.999) -> StreamingQuery:
    """Second half: Spark's keyed state holds a series' average, and each chunk gets the one from before it.

    The state of a series is its average and the last micro-batch folded into it; only series that the new chunks belong to
    are touched. Chunks of a micro-batch that was folded before are passed over.
    """
    d = float(decay)
    columns = f"`{series}` {kind}, _chunk bigint, n bigint, local double, head double, batch_id bigint"
    ends = spark.readStream.schema(columns).parquet(f"{out}/ends")

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ema, last = state.get if state.exists else (None, -1)
        found = pd.concat(list(parts))
        found = found[found["batch_id"] > last].sort_values(["batch_id", "_chunk"])
        if len(found):
            carries, ema = fold_ends(found[["n", "local", "head"]].to_dict("records"), ema, d)
            state.update((float(ema), int(found["batch_id"].iloc[-1])))
            yield found[[series, "_chunk", "batch_id"]].assign(_carry=carries)

    carries = ends.groupBy(series).applyInPandasWithState(
        fold, f"`{series}` {kind}, _chunk bigint, batch_id bigint, _carry double", "ema double, last bigint", "append", "NoTimeout"
    )
    return ingest(carries, lambda rows: rows, f"{out}/carries", checkpoint)


def ema_stream(
    stream: DataFrame, series: str, order: list[str], value: str, out: str, checkpoint: str, decay: float = 0.999
) -> StreamingQuery:
    """Running average per series over micro-batches, rows in order inside a batch; ``ema_rows`` reads it.

    The recurrence is linear: one query writes a micro-batch's chunks as averages from zero, the next folds a few numbers per
    chunk through Spark's keyed state. The second begins when the first has come to its end, so that it never sees a
    micro-batch which may be written again. The decay is pinned beside the checkpoint.
    """
    ema_local_stream(stream, series, order, value, out, f"{checkpoint}/local", decay).awaitTermination()
    kind = stream.schema[series].dataType.simpleString()
    return ema_carry_stream(stream.sparkSession, series, kind, out, f"{checkpoint}/carry", decay)


def ema_rows(spark: SparkSession, out: str, series: str, decay: float = 0.999) -> DataFrame:
    """All rows that ``ema_stream`` has read so far, with ``ema``; null for null values and rows without a series."""
    rows, carries = spark.read.parquet(f"{out}/rows"), spark.read.parquet(f"{out}/carries")
    ema = F.col("_local") + F.col("_carry") * F.pow(F.lit(float(decay)), F.col("_n"))
    joined = rows.join(carries, [series, "batch_id", "_chunk"], "left").withColumn("ema", ema)
    return joined.drop("batch_id", "_chunk", "_local", "_n", "_carry")


def funnel_stream(stream: DataFrame, funnel: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Kept and dropped rows per reason and micro-batch; totals are sums over batches."""
    return _each_batch(stream, lambda batch, i: write_batch(funnel(batch), out, i), checkpoint)


def funnel_totals(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("reason").agg(F.sum("n").alias("n"))
