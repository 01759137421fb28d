"""Global order without a single-task sort.

A rank is found in two passes: rows are put into ordered buckets, the buckets are counted, and
a row's rank is the count of all earlier buckets plus its place in its own. Only the bucket
table, a few rows per bucket, is ever scanned in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from captionloom.functions.hashing import digest
from captionloom.session import materialize


#: Rows of a sorted chunk, at most: what one task sorts.
CHUNK_ROWS = 2_000_000


def _offsets(counts: DataFrame, bucket: str, n: str = "_n") -> DataFrame:
    """Rows before each bucket. ``counts`` has one row per bucket."""
    before = W.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return counts.select(bucket, F.coalesce(F.sum(n).over(before), F.lit(0).cast("bigint")).alias("_start"))


def with_row_index(scan: DataFrame, name: str = "idx") -> DataFrame:
    """Position of each row in the input (files by name, then rows in file order), from 0.

    ``scan`` must read Parquet files directly: the row index inside a file comes from the
    reader, so that only the per-file start has to be added and no row is shuffled.
    """
    tagged = scan.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_pos")
    )
    # One row per file, written out: Spark broadcasts it if its size on disk allows.
    starts = materialize(_offsets(tagged.groupBy("_file").agg(F.count("*").alias("_n")), "_file"), "starts")
    return tagged.join(starts, "_file").withColumn(name, F.col("_start") + F.col("_pos")).drop(
        "_file", "_pos", "_start"
    )


def lines_with_index(spark: SparkSession, path: str, name: str = "idx") -> DataFrame:
    """``value`` and the position of each line of text files (files by name, then lines), from 0.

    A line's place is its file, the block that its split began with, and its place in the split. The lines are
    written out once with these, so that counting and numbering see the same splits. Blank lines count; parse
    ``value`` afterwards, as with ``from_json``.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_spot"),
    )
    lines = materialize(lines, "lines")
    # One row per block of a file from here on.
    blocks = lines.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_spot").alias("_first"))
    before = W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = lines.join(materialize(starts, "starts"), ["_file", "_block"])
    return numbered.select("value", (F.col("_start") + F.col("_spot") - F.col("_first")).alias(name))


def rank_in_buckets(df: DataFrame, bucket: Column, order: list, name: str = "rank") -> DataFrame:
    """Global rank from 0, given a bucket number that rises with the order.

    Rows are exchanged once, by bucket. What was placed is written out, so that the input is
    not computed again for the counts; counting then reads the bucket column alone.
    """
    placed = df.withColumn("_bucket", bucket)
    place = F.row_number().over(W.partitionBy("_bucket").orderBy(*order))
    placed = materialize(placed.withColumn("_place", place), "ranks")
    starts = _offsets(placed.groupBy("_bucket").agg(F.count("*").alias("_n")), "_bucket")
    ranked = placed.join(starts, "_bucket")
    return ranked.select(*df.columns, (F.col("_start") + F.col("_place") - 1).cast("bigint").alias(name))


def kept_rank(df: DataFrame, idx: str = "idx", name: str = "kept_rank", block_rows: int = 65_536) -> DataFrame:
    """Rank of each remaining row in input order. A block of input rows is one bucket."""
    return rank_in_buckets(df, F.floor(F.col(idx) / block_rows), [F.col(idx)], name)


def shard_id(rank: str = "kept_rank", shard_size: int = 1000) -> Column:
    """Six-digit name of the shard a rank falls into."""
    return F.format_string("%06d", F.floor(F.col(rank) / shard_size).cast("bigint"))


def sample_key(idx: str = "idx", prefix: str = "sample") -> Column:
    """Nine-digit key of the input row; dropped rows leave gaps."""
    return F.format_string(f"{prefix}-%09d", F.col(idx).cast("bigint"))


def shuffle_rank(df: DataFrame, key: str, seed, epoch=0, name: str = "shuffle_rank") -> DataFrame:
    """A full, repeatable shuffle: rank by hash of (seed, epoch, key).

    Range partitions of the hash, as many as the rows of the table ask for.
    """
    hashed = df.withColumn("_hash", digest(seed, epoch, F.col(key)))
    return global_rank(hashed, ["_hash", key], name).drop("_hash")


def buffer_shuffle(df: DataFrame, seed, epoch=0, size: int = 2048, place: str | None = None) -> DataFrame:
    """Rows mixed on their way through a buffer of ``size`` rows in each task: no exchange, no sort, batch or stream.

    The first ``size`` rows of a partition fill the buffer. Each later one draws a slot by a hash of seed, epoch, partition and
    row number, sends out the row that it finds there, and stays in its place. What is left at the end goes out
    by a hash of its slot; in a stream that is the end of a micro-batch. ``place`` names a column for the position in the new order. The order is the same
    after a retry where the partition's own order is.
    """
    if size < 1:
        raise ValueError(f"a buffer of {size} rows")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def numbered(rows: pa.Table, start: int) -> list[pa.RecordBatch]:
        if place:
            rows = rows.append_column(place, pa.array(range(start, start + len(rows)), pa.int64()))
        return rows.combine_chunks().to_batches()

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = f"{seed}|{epoch}|{TaskContext.get().partitionId()}"
        held, seen, sent = None, 0, 0
        for batch in batches:
            fresh = pa.Table.from_batches([batch])
            pool = fresh if held is None else pa.concat_tables([held, fresh])
            kept = list(range(min(len(pool), size)))
            out = []
            for row in range(len(kept), len(pool)):
                number = seen + row - (len(pool) - len(fresh))
                slot = int(md5(f"{key}|{number}".encode()).hexdigest()[:8], 16) % size
                out.append(kept[slot])
                kept[slot] = row
            yield from numbered(pool.take(pa.array(out, pa.int64())), sent)
            held, seen, sent = pool.take(pa.array(kept, pa.int64())).combine_chunks(), seen + len(fresh), sent + len(out)
        if held is not None:
            rest = sorted(range(len(held)), key=lambda slot: md5(f"{key}|rest|{slot}".encode()).hexdigest())
            yield from numbered(held.take(pa.array(rest, pa.int64())), sent)

    return df.mapInArrow(mix, kinds + (f", `{place}` bigint" if place else ""))


def batches(df: DataFrame, rank: str, columns: list[str], batch_size: int) -> DataFrame:
    """Consecutive ranks gathered ``batch_size`` to a row, in order; the last may be short."""
    batch = F.floor(F.col(rank) / batch_size).cast("bigint")
    rows = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("_rank"), *columns)))
    grouped = df.groupBy(batch.alias("batch_id")).agg(rows.alias("_rows"))
    return grouped.select(
        "batch_id",
        F.size("_rows").alias("batch_rows"),
        *[F.col(f"_rows.{c}").alias(c) for c in columns],
    )


def chunks_for(spark: SparkSession, rows: int) -> int:
    """Into how many chunks a table of so many rows is sorted.

    On average a chunk has half of ``spark.captionloom.chunkRows`` (default ``CHUNK_ROWS``), so that one that the split points make
    twice as large still keeps to it. A smaller table is spread over the cores, down to a sixteenth of that.
    """
    most = int(spark.conf.get("spark.captionloom.chunkRows", str(CHUNK_ROWS)))
    if most < 2:
        raise ValueError(f"chunks of {most} rows")
    for_cores = min(spark.sparkContext.defaultParallelism, -(-rows * 16 // most))
    return max(1, -(-rows * 2 // most), for_cores)


def range_chunks(
    df: DataFrame,
    order: list[str],
    stage: Callable[[DataFrame], DataFrame] | None = None,
    parts: int | None = None,
    store: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The table in sorted chunks: adds ``_chunk``, rising with ``order``, and ``_place`` in it.

    The table is written out once, so that looking for split points and cutting see the same rows and compute nothing twice; its
    rows, counted from the files' footers, say how many chunks there are (``chunks_for``), unless ``parts`` does. Split points
    come from Spark's sample of every file, which gives chunks of about equal size. The last
    order column should be unique, so that ties of the others, however many, are split as
    well. ``stage`` is run on the sorted chunks, one chunk a partition, in the same pass.
    Written out once more, because the chunks must be the same for every later use: by ``store``, which gives
    the written table back, or to the shared folder.
    """
    if parts is None:
        df = materialize(df, "unordered")
        parts = chunks_for(df.sparkSession, df.count())
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    spot = F.monotonically_increasing_id()
    numbered = ordered.withColumn("_spot", spot).select(
        *df.columns,
        F.shiftright("_spot", 33).alias("_chunk"),
        F.col("_spot").bitwiseAND(F.lit(2**33 - 1)).alias("_place"),
    )
    made = stage(numbered) if stage else numbered
    return store(made) if store else materialize(made, "chunks")


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Rank from 0 by any sortable columns, the last of them unique.

    The starts have one row per chunk; written out, they are broadcast by Spark if their size on disk allows.
    """
    chunks = range_chunks(df, order)
    starts = materialize(_offsets(chunks.groupBy("_chunk").agg(F.count("*").alias("_n")), "_chunk"), "starts")
    ranked = chunks.join(starts, "_chunk")
    return ranked.select(*df.columns, (F.col("_start") + F.col("_place")).alias(name))


SPOT = ["_spot_file", "_spot_row"]


def with_spot(written: DataFrame) -> DataFrame:
    """Adds ``SPOT``, a row's file and place in it, to a table read straight from Parquet files."""
    return written.select("*", F.xxhash64("_metadata.file_path").alias(SPOT[0]), F.col("_metadata.row_index").alias(SPOT[1]))


def rank_by_spot(df: DataFrame, order: list[str], rank: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rank`` of the ``order`` columns alone, joined to the rows by ``SPOT``: what is wide is neither sorted nor written.

    Rows that are alike in ``order`` get ranks of their own.
    """
    ranks = rank(df.select(*order, *SPOT))
    return df.join(ranks.drop(*order), SPOT).drop(*SPOT)


def zip_by_rank(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str]) -> DataFrame:
    """Pairs the i-th row of one side with the i-th of the other, each in its own order.

    A full join: rows of the longer side come out with nulls, to be reported or filtered.
    """
    a = global_rank(left, left_order, "rank")
    b = global_rank(right, right_order, "rank")
    return a.join(b, "rank", "full")
