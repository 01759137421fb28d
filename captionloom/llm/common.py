"""What several operators share: tables, row places, word bytes, match positions."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from captionloom.session import materialize

#: Bytes of words (digits, letters and all of UTF-8 beyond ASCII) with A-Z lowered; the rest becomes a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: What stands between words of lowered text, as a regular expression.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of plain white space splitting.
TOKEN = r"[^\x20\x09-\x0D]+"
PLACE = ["__place_file", "__place_row"]
BLOCK = 256
#: Texts in an Arrow batch.
TEXT_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_place(df: DataFrame) -> DataFrame:
    """Adds ``PLACE``, which names each row for good: its file and its position in it.

    A table that is not read straight from Parquet files is written to the shared folder first.
    """
    names = df.columns
    if set(PLACE) <= set(names):
        return df
    if "_metadata" not in names:
        place = [F.xxhash64("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1])]
        try:
            return df.select("*", *place)
        except AnalysisException:
            pass
    safe = materialize(df.toDF(*[f"c{i}" for i in range(len(names))]), "placed")
    return with_place(safe).toDF(*names, *PLACE)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """Jobs begun inside hand Python at most so many rows at a time, so that batches of long texts stay small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lower_ascii(text: Column) -> Column:
    """Lower case whose ASCII letters come from A-Z alone.

    The two other characters that lower to ASCII letters (U+212A, U+0130) are put out of the way.
    """
    safe = F.replace(F.replace(text, F.lit("\u212a"), F.lit("\ue12a")), F.lit("\u0130"), F.lit("\ue130"))
    return F.lower(safe)


def n_tokens(text: Column) -> Column:
    """Number of white-space separated words; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))), F.lit(0)).cast("long")


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: an array of one gives it a name.

    Without it the optimizer may move a computed column into a lambda, to be computed for every element.
    """
    return F.transform(F.array(value), use)[0]


def _add(a: Column, b: Column) -> Column:
    return a + b


def _starts(lengths: Column, use) -> Column:
    """``use`` of a function from an index to the sum of the ``lengths`` before it.

    Sums of blocks, and of the blocks before a block, are made first, so that a text with very many
    matches stays near linear.
    """
    zero = F.lit(0)

    def with_blocks(sums: Column) -> Column:
        before = F.transform(sums, lambda _, b: F.aggregate(F.slice(sums, 1, b), zero, _add))
        return let(before, lambda offsets: use(lambda i: offsets[_block(i)] + _inside(i)))

    def _block(i: Column) -> Column:
        return F.floor(i / BLOCK).cast("int")

    def _inside(i: Column) -> Column:
        return F.aggregate(F.slice(lengths, _block(i) * BLOCK + 1, i % BLOCK), zero, _add)

    blocks = F.sequence(zero, F.floor(F.greatest(F.size(lengths) - 1, zero) / BLOCK).cast("int"))
    sums = F.transform(blocks, lambda b: F.aggregate(F.slice(lengths, b * BLOCK + 1, BLOCK), zero, _add))
    return let(sums, with_blocks)


def find_matches(text: Column, gate: str, pattern: str, group: int | None = None) -> Column:
    """The matches of ``pattern`` in a text, leftmost first; texts without ``gate`` are not searched further.

    A match is (start, end, value, before, after, part): code points, end exclusive; up to 80
    characters on either side, up to the next match; the capture ``group`` asked for.
    """

    def spans(f: Column) -> Column:
        m, p = f["m"], f["p"]

        def made(start) -> Column:
            return F.transform(
                m,
                lambda x, i: let(
                    start(i) + F.length(p[i]),
                    lambda at: F.struct(
                        at.alias("start"),
                        (at + F.length(x)).alias("end"),
                        x.alias("value"),
                        F.right(p[i], F.lit(80)).alias("before"),
                        F.left(p[i + 1], F.lit(80)).alias("after"),
                        (f["g"][i] if group is not None else F.lit(None).cast("string")).alias("part"),
                    ),
                ),
            )

        lengths = F.transform(m, lambda x, i: F.length(p[i]) + F.length(x))
        return let(lengths, lambda sizes: _starts(sizes, made))

    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern).alias("p")]
    if group is not None:
        parts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"))
    empty = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string,part:string>>")
    return F.when(text.rlike(gate), let(F.struct(*parts), spans)).otherwise(empty)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
