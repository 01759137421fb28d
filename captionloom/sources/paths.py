"""Files on whatever file system the shared folder is on, driver or executor side."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def expand_braces(pattern: str) -> list[str]:
    """``{000000..000999}`` ranges, zeros kept, to the list of paths."""
    found = re.search(r"\{(\d+)\.\.(\d+)\}", pattern)
    if not found:
        return [pattern]
    low, high = found.groups()
    width = len(low)
    head, tail = pattern[: found.start()], pattern[found.end() :]
    return [p for i in range(int(low), int(high) + 1) for p in expand_braces(f"{head}{i:0{width}d}{tail}")]


def list_files(path: str, suffix: str) -> list[str]:
    """The path itself if it is a file, else the files below it with the suffix, by name."""
    system, inner = open_fs(path.rstrip("/"))
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        return []
    prefix = path.rstrip("/")[: -len(inner)] if path.rstrip("/").endswith(inner) else ""
    inside = system.get_file_info(fs.FileSelector(inner, recursive=False))
    return sorted(prefix + f.path for f in inside if f.type == fs.FileType.File and f.base_name.endswith(suffix))


def folder_fingerprint(spark: SparkSession, folder: str, pattern: str = "*") -> str:
    """What a folder's listing says of its content: number, names, sizes and times of its files. No file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    one = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    # Exclusive-or and sum do not depend on the order of the files, and no list of them is gathered.
    totals = [F.count("*").alias("n"), F.sum("length").alias("size"), F.bit_xor(one).alias("mark")]
    row = files.agg(*totals).na.fill(0).first()
    return f"{row['n']}-{row['size']}-{row['mark'] % 2**64:016x}"
