"""Vocabulary files: pieces with scores, their description, and fingerprints."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from captionloom.functions.tokens import SPECIAL_PIECES
from captionloom.operators.encode import vocab_rows
from captionloom.sources.paths import open_fs


def vocab_text(vocab: DataFrame) -> str:
    """``piece<TAB>score`` lines in id order: whole scores without a fraction."""
    lines = [f"{p}\t{int(s) if s == int(s) else s}" for _, p, s in vocab_rows(vocab)]
    return "\n".join(lines) + "\n"


def vocab_fingerprint(vocab: DataFrame) -> str:
    """SHA-1 of the vocabulary as it would be written."""
    return hashlib.sha1(vocab_text(vocab).encode()).hexdigest()


def write_vocab(vocab: DataFrame, folder: str, model_type: str = "bpe") -> str:
    """``tokenizer.vocab`` and ``tokenizer_meta.json`` in ``folder``; returns the fingerprint.

    A vocabulary is bounded and its line order is its ids, so it is one small file.
    """
    system, root = open_fs(folder.rstrip("/"))
    system.create_dir(root, recursive=True)
    text = vocab_text(vocab).encode()
    meta = {"vocab_size": text.count(b"\n"), "model_type": model_type, "special_tokens": SPECIAL_PIECES}
    for name, data in (("tokenizer.vocab", text), ("tokenizer_meta.json", json.dumps(meta, indent=2).encode())):
        with system.open_output_stream(f"{root}/{name}") as out:
            out.write(data)
    return hashlib.sha1(text).hexdigest()


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """``id, piece, score`` of a vocabulary file; the id is the line number from 0.

    The file is read as one value, so line order holds without a sort.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("id", "line"))
    cut = F.split("line", "\t", 2)
    return lines.filter("line <> ''").select("id", cut[0].alias("piece"), cut[1].cast("double").alias("score"))


def read_vocab_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "vocab_size int, model_type string, special_tokens map<string,int>"
    ).json(path, multiLine=True)


def artifact_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha1`` of each file below a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha1("content").alias("sha1"))


def stamped(df: DataFrame, fingerprint: str | Column, name: str = "vocab_sha1") -> DataFrame:
    return df.withColumn(name, F.lit(fingerprint))


def stale_rows(rows: DataFrame, artifacts: DataFrame, name: str = "vocab_sha1") -> DataFrame:
    """Token rows made with an artifact that is not among the given ones, rows without a stamp among them."""
    return rows.join(artifacts.select(F.col("sha1").alias(name)).distinct(), name, "left_anti").select(*rows.columns)
