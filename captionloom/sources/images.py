"""Image folders, and vectors kept compactly."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_images(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """``name, width, height, channels, data`` of decodable images; others are left out.

    Pixel bytes are row-major, blue first, as the image source gives them.
    """
    files = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).load(folder)
    # A file counts as so many MB when Spark deals files to tasks, which makes a task of some thirty small pictures.
    files = files.coalesce(max(4 * spark.sparkContext.defaultParallelism, -(-files.rdd.getNumPartitions() // 16)))
    scanned = files.select(
        F.substring_index("image.origin", "/", -1).alias("name"),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )
    if scanned.select("name").isEmpty():
        raise ValueError(f"No {pattern} images found in {folder}")
    return scanned


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _rgb(data: pd.Series, channels: pd.Series) -> pd.Series:
    def one(raw, n):
        flat = np.frombuffer(raw, np.uint8).reshape(-1, n)
        colour = np.repeat(flat, 3, axis=1) if n == 1 else flat[:, 2::-1]
        return colour.astype(np.int32).ravel()

    return pd.Series([one(raw, n) for raw, n in zip(data, channels)])


def rgb_pixels(data: Column | str = "data", channels: Column | str = "channels") -> Column:
    """Pixels as red, green, blue integers; grey is repeated and transparency dropped."""
    return _rgb(data, channels)


PACKED = "struct<dtype:string,shape:array<int>,data:binary>"
#: Names and widths of the number types that a packed array may hold.
DTYPES = {"float16": np.float16, "float32": np.float32}


def pack(vec: Column | str, shape: tuple[int, ...] | None = None, dtype: str = "float16") -> Column:
    """An array of numbers as its bytes (little-endian, row-major) with type and shape; null stays null.

    Without ``shape`` the array is one row of its own length. An array that does not fill the shape is an error, and so is a
    null inside it. Values beyond the type's range become infinite, as everywhere with 16-bit floats.
    """
    kind = np.dtype(DTYPES[dtype]).newbyteorder("<")

    @F.arrow_udf(PACKED)
    def packed(arrays: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cells = arrays.flatten()
        if cells.null_count:
            raise ValueError("an array with a null inside cannot be packed")
        known = arrays.is_valid().to_numpy(zero_copy_only=False)
        if shape is not None and (lengths[known] != math.prod(shape)).any():
            raise ValueError(f"arrays of {sorted(set(lengths[known].tolist()))} values do not fill the shape {shape}")
        with np.errstate(over="ignore"):
            raw = cells.to_numpy(zero_copy_only=False).astype(kind).tobytes()
        ends = np.concatenate(([0], np.cumsum(lengths))) * kind.itemsize
        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(arrays), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
        shapes = pa.array([list(shape) if shape is not None else [int(n)] for n in lengths], pa.list_(pa.int32()))
        types = pa.array([dtype] * len(arrays), pa.string())
        fields = [types, shapes, data.cast(pa.binary())]
        return pa.StructArray.from_arrays(fields, ["dtype", "shape", "data"], mask=pa.array(~known))

    return packed(vec)


def unpack(packed: Column | str, shape: tuple[int, ...] | None = None) -> Column:
    """The numbers of ``pack`` as 32-bit floats in a flat array, exactly; null stays null.

    Another shape than the one asked for, an unknown type, or bytes that do not fill the shape are errors.
    """

    @F.arrow_udf("array<float>")
    def flat(rows: pa.Array) -> pa.Array:
        known = rows.is_valid().to_numpy(zero_copy_only=False)
        parts, lengths = [], np.zeros(len(rows), np.int64)
        for i in np.flatnonzero(known).tolist():
            row = rows[i].as_py()
            if row["dtype"] not in DTYPES:
                raise ValueError(f"unknown number type {row['dtype']}")
            part = np.frombuffer(row["data"], np.dtype(DTYPES[row["dtype"]]).newbyteorder("<"))
            if len(part) != math.prod(row["shape"]) or (shape is not None and tuple(row["shape"]) != tuple(shape)):
                raise ValueError(f"{len(part)} values in the shape {row['shape']}, asked for {shape}")
            parts.append(part.astype(np.float32))
            lengths[i] = len(part)
        ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        cells = np.concatenate([np.zeros(0, np.float32), *parts])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(cells), mask=pa.array(~known))

    return flat(packed)


def write_vectors(
    df: DataFrame, path: str, vec: str = "latent", shape: tuple[int, ...] | None = None, dtype: str = "float16"
) -> None:
    """Vectors as Parquet, two bytes a value with ``float16``, each with its type and shape."""
    df.withColumn(vec, pack(vec, shape, dtype)).write.parquet(path)


def read_vectors(spark: SparkSession, path: str, vec: str = "latent", shape: tuple[int, ...] | None = None) -> DataFrame:
    """What ``write_vectors`` wrote, as arrays of 32-bit floats."""
    return spark.read.parquet(path).withColumn(vec, unpack(vec, shape))
