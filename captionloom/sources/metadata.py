"""Caption metadata, URL manifests, prompt lists and caption corpora."""

from __future__ import annotations

from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captionloom.functions.text import clean_caption, first_truthy
from captionloom.operators.skew import skew_join


def _read_one(spark: SparkSession, path: str, schema: T.StructType | None, multi_line: bool = True) -> DataFrame:
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix in (".json", ".jsonl"):
        # Spark skips blank lines itself; every scalar is kept as the text it was written as.
        reader = spark.read.option("mode", "FAILFAST").option("primitivesAsString", "true")
        return (reader.schema(schema) if schema else reader).json(path)
    if suffix in (".csv", ".tsv"):
        reader = (
            spark.read.option("header", "true")
            .option("sep", "\t" if suffix == ".tsv" else ",")
            .option("quote", '"')
            .option("escape", '"')
            .option("multiLine", str(multi_line))
        )
        return (reader.schema(schema) if schema else reader).csv(path)
    if suffix == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported metadata format: {suffix or path}")


def read_metadata(
    spark: SparkSession, *paths: str, schema: T.StructType | None = None, multi_line: bool = True
) -> DataFrame:
    """Metadata by file suffix: JSON Lines, CSV/TSV with a header, or Parquet.

    Several files are put together by column name, absent columns filled with null. Pass
    ``schema`` for JSON or CSV at scale: it saves the pass that infers the columns.
    ``NSFW`` next to ``nsfw`` in one file needs ``spark.sql.caseSensitive=true``. A CSV file whose fields
    hold line breaks is read by one task; ``multi_line=False`` splits files that have none.
    """
    if not paths:
        raise ValueError("no metadata path given")
    parts = [_read_one(spark, p, schema, multi_line) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_json_lines_flagged(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines as ``URL, TEXT, NSFW, safe_flag``, telling an absent key from a null one.

    Rows are parsed one by one, so that a file which mixes ``NSFW`` and ``nsfw`` keys is
    read without inferring a schema first.
    """
    is_object = F.json_object_keys("value").isNotNull()
    refused = F.raise_error(F.concat(F.lit("not a JSON object: "), F.col("value")))
    lines = spark.read.text(path).filter(F.trim("value") != "")
    lines = lines.select(F.when(is_object, F.col("value")).otherwise(refused).alias("value"))
    keys = F.json_object_keys("value")
    field = lambda name: F.get_json_object("value", f"$.{name}")
    flag = (
        F.when(F.array_contains(keys, "NSFW"), F.coalesce(field("NSFW"), F.lit("none")))
        .when(F.array_contains(keys, "nsfw"), F.coalesce(field("nsfw"), F.lit("none")))
        .otherwise(F.lit(""))
    )
    blank = F.lit("")
    # Every column goes through the parsed line, so that no choice of columns lets a bad line pass.
    return lines.select(
        F.coalesce(F.nullif(field("URL"), blank), F.nullif(field("url"), blank)).alias("URL"),
        F.coalesce(
            F.nullif(field("TEXT"), blank), F.nullif(field("text"), blank), F.nullif(field("caption"), blank)
        ).alias("TEXT"),
        flag.alias("NSFW"),
    )


def manifest_entry(url: Column) -> Column:
    """The file name of a URL: all after its last slash."""
    return F.substring_index(url, "/", -1)


def url_manifest(lines: DataFrame, column: str = "value") -> DataFrame:
    """URL lines to ``url, filename, same_name``; blank and ``#`` lines are left out.

    ``same_name`` counts the URLs that would be saved under one file name (a download
    would overwrite). It is an aggregate joined back, not a window: a name shared by
    a large part of the list is counted map-side, and split by Spark in the join.
    """
    url = F.trim(F.col(column))
    urls = lines.select(url.alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#"))
    named = urls.withColumn("filename", manifest_entry(F.col("url")))
    clashes = named.groupBy("filename").agg(F.count("*").alias("same_name")).filter("same_name > 1")
    return skew_join(named, clashes, "filename", "left").select(
        "url", "filename", F.coalesce("same_name", F.lit(1).cast("bigint")).alias("same_name")
    )


def read_url_manifest(spark: SparkSession, path: str) -> DataFrame:
    return url_manifest(spark.read.text(path))


def prompt_table(
    prompts: DataFrame, order: str, text: str, inline: str | None = None, limit: int | None = None
) -> DataFrame:
    """Trimmed, non-blank prompts in order, an inline prompt last, the first ``limit`` kept."""
    listed = prompts.select(F.col(order).cast("bigint").alias("pos"), F.trim(text).alias("prompt"))
    listed = listed.filter(F.col("prompt") != "")
    if inline and inline.strip():
        end = listed.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("pos"), F.lit(inline.strip()).alias("prompt"))
        listed = listed.unionByName(end)
    return listed.orderBy("pos").limit(limit) if limit else listed


def read_prompts(
    spark: SparkSession, path: str | None = None, inline: str | None = None, limit: int | None = None
) -> DataFrame:
    """A prompt file (one prompt a line) as ``pos, prompt``; fails where nothing is given.

    A prompt file is a hand-written list, so that one file is read as one value, which keeps
    its line order without a global row number.
    """
    if path:
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\r|\n")))
    else:
        lines = spark.createDataFrame([], "pos int, col string")
    table = prompt_table(lines, "pos", "col", inline, limit)
    if table.isEmpty():
        raise ValueError("no prompts given")
    return table


def captions(metadata: DataFrame) -> DataFrame:
    """The caption corpus: every non-empty cleaned caption, unsafe rows included."""
    text = first_truthy(metadata, "TEXT", "text", "caption")
    return metadata.select(clean_caption(text).alias("caption")).filter(F.col("caption") != "")


def write_captions(metadata: DataFrame, path: str) -> None:
    captions(metadata).write.text(path)


def standardize(df: DataFrame) -> DataFrame:
    """Any metadata table as ``URL, TEXT, NSFW``, aliases resolved by its own columns."""
    from captionloom.operators.filters import safety_flag

    return df.select(
        first_truthy(df, "URL", "url").alias("URL"),
        first_truthy(df, "TEXT", "text", "caption").alias("TEXT"),
        safety_flag(df).alias("NSFW"),
    )


def read_standard(
    spark: SparkSession, *paths: str, schema: T.StructType | None = None, multi_line: bool = True
) -> DataFrame:
    """Several files as one ``URL, TEXT, NSFW`` table.

    Aliases are resolved per file: after a plain union a row of a file without ``NSFW`` could
    not be told from one whose ``NSFW`` is null.
    """
    if not paths:
        raise ValueError("no metadata path given")
    return reduce(DataFrame.unionByName, [standardize(_read_one(spark, p, schema, multi_line)) for p in paths])
