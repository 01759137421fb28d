"""Queries that write to the shared folder and read back: formats, shards, images, streams."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captionloom.functions.tokens import SPECIAL_PIECES, attention_mask, pad_truncate
from captionloom.operators import filters, ordering, payload, series, stages
from captionloom.plans import batching
from captionloom.plans import jobs as jobs_plan
from captionloom.plans import tokens as token_plans
from captionloom.plans import views
from captionloom.plans.features import ORACLES as FEATURE_SQL
from captionloom.plans.features import kid_sql
from captionloom.plans.prepare import ORACLES as PREPARE_SQL
from captionloom.plans.tokens import ORACLES as TOKEN_SQL
from captionloom.plans.views import METADATA_SQL, PAYLOAD_SQL, SAFE_SQL, clean_sql, u32_sql
from captionloom.session import fresh_dir, materialize
from captionloom.settings import DataSettings
from captionloom.sources import images, metric_log, shards
from captionloom.sources import metadata as meta_source
from captionloom.sources import vocab as vocab_source
from captionloom.sources.paths import open_fs
from captionloom.streaming import jobs

# Fixed value: factor that brings autoencoder latents to unit variance.
LATENT_SCALE = 0.18215


def metadata_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata written in four formats, read back as one table."""
    root = fresh_dir(spark, "formats")
    meta = views.metadata(spark, sf_dir)
    part = lambda k: meta.filter(F.col("idx") % 4 == k).drop("idx")
    part(0).write.json(f"{root}/a.jsonl")
    part(1).write.csv(f"{root}/b.csv", header=True, quote='"', escape='"')
    part(2).write.csv(f"{root}/c.TSV", header=True, sep="\t", quote='"', escape='"')
    part(3).withColumnsRenamed({"URL": "url", "TEXT": "caption", "NSFW": "nsfw"}).write.parquet(f"{root}/d.parquet")
    read = meta_source.read_standard(spark, *(f"{root}/{n}" for n in ("a.jsonl", "b.csv", "c.TSV", "d.parquet")))
    digest = F.md5(F.col("TEXT").cast("binary"))
    return read.groupBy(F.col("NSFW").alias("flag"), digest.alias("text_md5")).agg(
        F.count("*").alias("n"), F.count("URL").alias("with_url")
    )


def caption_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus file, a caption a line, as tokenizer training would read it."""
    path = fresh_dir(spark, "captions")
    meta_source.write_captions(views.metadata(spark, sf_dir), path)
    lines = spark.read.text(path)
    return lines.groupBy(F.md5(F.col("value").cast("binary")).alias("caption_md5")).agg(
        F.count("*").alias("n"), F.max(F.length("value")).cast("bigint").alias("chars")
    )


def shard_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata to shards: filter, payload, rank, write; and the shards read back."""
    path = fresh_dir(spark, "shards")
    raw = views.metadata(spark, sf_dir, indexed=True)
    fetched = views.payload(spark, sf_dir)
    # Ranks need only to know which payloads exist; the bytes join in afterwards.
    found = raw.join(fetched.select(F.col("url").alias("URL")), "URL", "left_semi")
    kept = filters.safe_captions(found)
    ranked = payload.attach_payload(ordering.kept_rank(kept), fetched)
    members = F.create_map(
        F.lit("jpg"), F.encode("html", "UTF-8"), F.lit("txt"), F.encode("caption", "UTF-8")
    )
    shards.write_shards(
        ranked.select(ordering.shard_id("kept_rank", 50).alias("shard"), ordering.sample_key("idx").alias("key"), members.alias("members")),
        path,
    )
    samples = shards.image_samples(shards.read_shards(spark, path))
    return samples.select("shard", "key", "caption", F.md5("image").alias("payload_md5"))


def shard_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in shards, every third shard then damaged: samples read and lost, by kind of shard."""
    path = fresh_dir(spark, "damaged")
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    number = F.pmod(F.col("doc_id"), F.lit(30))
    members = F.create_map(F.lit("txt"), F.encode("text", "UTF-8"))
    rows = docs.select(F.format_string("%06d", number).alias("shard"), ordering.sample_key("doc_id").alias("key"), members.alias("members"))
    shards.write_shards(rows, path)
    system, inner = open_fs(path)
    for k in range(0, 30, 3):
        with system.open_output_stream(f"{inner}/{k:06d}.tar") as out:
            out.write(b"no tar at all" * 100)
    good = shards.read_shards(spark, path, skip_bad=True)
    faults = shards.shard_faults(spark, path)
    lost = rows.groupBy("shard").agg(F.count("*").alias("written")).join(faults, "shard")
    read = good.groupBy("shard").agg(F.count("*").alias("read"))
    return lost.join(read, "shard", "left").select(
        "shard", "written", F.coalesce("read", F.lit(0)).alias("read"), (F.col("written") - F.col("samples")).alias("lost"),
        F.col("error").isNotNull().alias("damaged"),
    )


def _png(grey: np.ndarray) -> bytes:
    """A small RGB PNG of a square grey image."""
    side = grey.shape[0]
    lines = b"".join(b"\0" + np.repeat(row, 3).astype(np.uint8).tobytes() for row in grey)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", side, side, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def _save_pictures(vectors: DataFrame, folder: str) -> None:
    """The vectors as 8 x 8 pictures named by number."""
    system, inner = open_fs(folder)
    system.create_dir(inner, recursive=True)

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, inner = open_fs(folder)
        for batch in batches:
            for name, vec in zip(batch["vec_id"], batch["embedding"]):
                grey = np.floor((np.asarray(vec, np.float64) + 1.0) * 127.5).reshape(8, 8)
                with system.open_output_stream(f"{inner}/img-{name:09d}.png") as out:
                    out.write(_png(grey))
            yield batch[["vec_id"]]

    made = vectors.select("vec_id", "embedding").mapInPandas(save, "vec_id bigint")
    made.write.format("noop").mode("overwrite").save()


def image_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors saved as small pictures, next to one file that is none, and scanned."""
    folder = fresh_dir(spark, "images")
    _save_pictures(views.vectors(spark, sf_dir).filter("vec_id <> 0"), folder)
    system, inner = open_fs(folder)
    with system.open_output_stream(f"{inner}/img-{0:09d}.png") as out:
        out.write(b"not a picture")
    pixels = images.scan_images(spark, folder).withColumn("rgb", images.rgb_pixels())
    total = F.aggregate("rgb", F.lit(0).cast("bigint"), lambda a, x: a + x)
    sums = pixels.select(
        "name", *[F.col(c).cast("bigint").alias(c) for c in ("width", "height", "channels")], total.alias("pixel_sum")
    )
    # A sort first draws its split points: over the files themselves each would be read and decoded twice.
    return materialize(sums, "scanned").orderBy("name")


def _row_means():
    """A caller's image model: the mean of each of the eight rows, in red."""
    return lambda pixels: [(np.asarray(p, np.float64).reshape(8, 8, 3)[:, :, 0].mean(axis=1) / 255.0).tolist() for p in pixels]


def score_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders of pictures, scored against each other."""
    root = fresh_dir(spark, "folders")
    vectors = views.sided_vectors(spark, sf_dir).withColumnRenamed("key", "vec_id")
    for side in ("real", "fake"):
        _save_pictures(vectors.filter(F.col("side") == side), f"{root}/{side}")
    scored = jobs_plan.score_folders(spark, f"{root}/real", f"{root}/fake", _row_means, subsets=5, subset_size=20)
    return scored.select("n_real", "n_fake", *[F.round(c, 6).alias(c) for c in ("fid", "kid_mean", "kid_std")])


def clip_score_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures against the benchmark's lines as prompts, with a text model of eight letter counts."""
    folder = fresh_dir(spark, "pictures")
    _save_pictures(views.vectors(spark, sf_dir), folder)

    def counts():
        return lambda texts: [[float(t.count(c)) for c in "aehinost"] for t in texts]

    table = views.table(spark, sf_dir, "benchmark")
    prompts = meta_source.prompt_table(table, "item_id", "text")
    scored = jobs_plan.clip_score_folder(spark, folder, prompts, _row_means, counts)
    return scored.select("n", F.round("clip_mean", 6).alias("clip_mean"), F.round("clip_std", 6).alias("clip_std"))


def prepared_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preparation with a decode stage that fails on some payloads and drops others; funnel and shards agree."""
    path = fresh_dir(spark, "prepared")

    def decode(body: bytes) -> bytes | None:
        if len(body) % 7 == 0:
            raise ValueError("cut off")
        return None if len(body) % 5 == 0 else body[::-1]

    fetched = views.payload(spark, sf_dir).select("url", F.encode("html", "UTF-8").alias("body"))
    funnel = jobs_plan.prepare_shards(views.metadata(spark, sf_dir, indexed=True), fetched, "body", decode, path, 50)
    written = shards.read_shards(spark, path, members=False).agg(F.count("*").alias("n"))
    return funnel.unionByName(written.select(F.lit("written").alias("reason"), "n"))


def latent_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as image shards, encoded to latents of fixed shape, read back."""
    root = fresh_dir(spark, "latents")
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    members = F.create_map(F.lit("jpg"), F.encode("text", "UTF-8"), F.lit("txt"), F.encode("text", "UTF-8"))
    shard = F.format_string("%06d", F.floor(F.col("doc_id") / 100))
    shards.write_shards(docs.select(shard.alias("shard"), ordering.sample_key("doc_id").alias("key"), members.alias("members")), f"{root}/in")

    def make_model():
        return lambda values: [np.array([[[len(v), v.count(b"e")]]], np.float32) for v in values]

    jobs_plan.encode_latent_shards(spark, f"{root}/in", f"{root}/out", make_model, 0.5)
    back = shards.latent_samples(shards.read_shards(spark, f"{root}/out"))

    def shape(raw: bytes) -> str:
        array = np.load(io.BytesIO(raw))
        return f"{array.ndim}:{float(array.sum())}"

    return back.select("shard", "key", F.md5(F.col("caption").cast("binary")).alias("caption_md5"), stages.try_map(shape, "latent", "string")["value"].alias("latent"))


def latent_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with small latents through shards to batches; every tenth latent has two axes and is left out."""
    root = fresh_dir(spark, "batches")
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")

    def make():
        return lambda ids: [jobs_plan.npy(np.arange(i, i + 4, dtype=np.float32).reshape((2, 2) if i % 10 == 0 else (1, 2, 2))) for i in ids]

    members = F.create_map(F.lit("npy"), stages.map_values(make, "doc_id", "binary", 64), F.lit("txt"), F.encode("text", "UTF-8"))
    shard = F.format_string("%06d", F.floor(F.col("doc_id") / 100))
    rows = docs.select(shard.alias("shard"), ordering.sample_key("doc_id", "latent").alias("key"), members.alias("members"))
    shards.write_shards(rows, f"{root}/shards")
    pieces = [*SPECIAL_PIECES, "▁", *"abcdefghijklmnopqrstuvwxyz"]
    vocab = spark.createDataFrame([(i, p, 0.0) for i, p in enumerate(pieces)], "id int, piece string, score double")
    vocab_source.write_vocab(vocab, f"{root}/vocab")
    settings = DataSettings(f"{root}/shards", f"{root}/vocab/tokenizer.vocab", batch_size=16, latent_mode=True)
    made = batching.token_batches(spark, settings, token_plans.SEED, epoch=1, media=batching.npy_array)
    text = lambda c: F.array_join(F.flatten(F.transform(c, lambda r: F.transform(r, lambda x: x.cast("int").cast("string")))), " ")
    return made.select(
        "batch_id", F.col("batch_rows").cast("bigint").alias("batch_rows"), F.array_join("key", " ").alias("keys"),
        F.md5(text(F.col("tokens")).cast("binary")).alias("tokens_md5"), text(F.col("values")).alias("latents"),
    )


def stage_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's encoder over batches: eight block means, scaled as latents are."""

    def make_model():
        def predict(inputs: np.ndarray) -> np.ndarray:
            return inputs.astype(np.float64).reshape(len(inputs), 8, 8).mean(axis=2) * LATENT_SCALE

        return predict

    latent = stages.map_batches(make_model, "embedding", T.ArrayType(T.DoubleType()), batch_size=64, shape=[64])
    rows = views.vectors(spark, sf_dir).select("vec_id", latent.alias("latent"))
    return rows.select("vec_id", F.posexplode("latent").alias("i", "x")).select(
        "vec_id", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x")
    )


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of a stage that fails on some texts and drops others."""

    def size(text: str) -> int | None:
        if "@" in text:
            raise ValueError("address in text")
        return len(text.encode()) if "." in text else None

    rows = views.texts(spark, sf_dir).select("doc_id", stages.try_map(size, "text", "bigint").alias("r"))
    return stages.error_counts(rows, "r")


def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors packed at half precision in a shape, and read back: bytes and values, in units of 2^-24."""
    path = fresh_dir(spark, "vectors")
    images.write_vectors(views.vectors(spark, sf_dir).select("vec_id", F.col("embedding").alias("latent")), path, shape=(4, 4, 4))
    size = spark.read.parquet(path).select("vec_id", F.octet_length("latent.data").cast("bigint").alias("bytes"))
    units = F.transform("latent", lambda x: (x.cast("double") * 2**24).cast("bigint").cast("string"))
    back = images.read_vectors(spark, path, shape=(4, 4, 4)).select("vec_id", F.array_join(units, " ").alias("units"))
    return back.join(size, "vec_id")


def vocab_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learnt vocabulary written, fingerprinted and read back."""
    folder = fresh_dir(spark, "vocab")
    stamp = vocab_source.write_vocab(token_plans._vocab(spark, sf_dir), folder)
    files = vocab_source.artifact_fingerprint(spark, f"{folder}/tokenizer.vocab")
    sha1 = files.select("sha1").first()["sha1"]
    if sha1 != stamp:
        raise RuntimeError("vocabulary file differs from the vocabulary")
    back = vocab_source.read_vocab(spark, f"{folder}/tokenizer.vocab")
    return vocab_source.stamped(back, sha1)


# Which metric an event type stands for.
_METRIC_OF = {"click": "loss", "view": "lr", "error": "clip_mean", "purchase": "clip_std", "signup": "grad_norm"}


def metric_log_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as log records, appended in two runs with overlapping steps, read in long form."""
    path = fresh_dir(spark, "log")
    events = views.table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    named = [F.when(F.col("event_type") == e, F.col("value")).alias(m) for e, m in _METRIC_OF.items()]
    records = events.select((at / 1e6).alias("timestamp"), (F.col("event_id") % 2000).alias("step"), *named)
    metric_log.append_log(records.filter("step < 1500"), path)
    metric_log.append_log(records.filter("step >= 1500"), path)
    metrics = tuple(_METRIC_OF.values())
    schema = "timestamp double, step bigint, " + ", ".join(f"{m} double" for m in metrics)
    log = metric_log.long_form(metric_log.read_log(spark, path, schema), metrics)
    latest = series.log_latest(log, ["series", "step"])
    return latest.select("series", "step", F.unix_micros("timestamp").alias("ts_us"), "value")


def stream_metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records read from the log as a stream, and appended in long form by micro-batch."""
    root = fresh_dir(spark, "logstream")
    metrics = tuple(_METRIC_OF.values())
    schema = "timestamp double, step bigint, " + ", ".join(f"{m} double" for m in metrics)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    named = [F.when(F.col("event_type") == e, F.col("value")).alias(m) for e, m in _METRIC_OF.items()]
    events = views.table(spark, sf_dir, "events")
    metric_log.append_log(events.select((at / 1e6).alias("timestamp"), F.col("event_id").alias("step"), *named), f"{root}/log")
    stream = metric_log.stream_log(spark, f"{root}/log", schema)
    job = jobs.ingest(stream, lambda log: metric_log.long_form(log, metrics), f"{root}/rows", f"{root}/checkpoint")
    job.awaitTermination()
    rows = spark.read.parquet(f"{root}/rows")
    return rows.select("series", "step", F.unix_micros("timestamp").alias("ts_us"), "value")


def stale_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stamped with the fingerprint of their source's file, where only every second file is at hand."""
    root = fresh_dir(spark, "artifacts")
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "source")
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    names = docs.select("source").distinct().filter(number % 2 == 0)
    names.select("source", F.col("source").alias("name")).write.partitionBy("name").text(root)
    files = vocab_source.artifact_fingerprint(spark, f"{root}/*")
    stamped = vocab_source.stamped(docs, F.sha1(F.concat("source", F.lit("\n")).cast("binary")))
    return vocab_source.stale_rows(stamped, files)


def _stream(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """A table as a stream of its files. Given as a pattern, it may be one file or a folder of them."""
    static = views.table(spark, sf_dir, name)
    return jobs.file_stream(spark, f"{sf_dir.rstrip('/')}/{name}.parque[t]", static.schema).select(*columns)


def _metadata_of(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of documents with the static labels and URLs."""
    labels = views.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    pages = views.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    flag = F.when(F.col("toxic") == 1, "NSFW").when(F.col("toxic") == 0, "UNLIKELY")
    return docs.join(labels, "doc_id", "left").join(pages, "doc_id", "left").select(
        F.col("doc_id").alias("idx"), F.col("url").alias("URL"), F.col("text").alias("TEXT"), flag.alias("NSFW")
    )


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New documents filtered, cleaned and encoded as they come; the dropped ones with their reason."""
    root = fresh_dir(spark, "ingest")
    vocab = token_plans._vocab(spark, sf_dir)
    docs = _stream(spark, sf_dir, "documents", ["doc_id", "text"])
    prepare = lambda batch: filters.with_reason(_metadata_of(batch, spark, sf_dir))
    jobs.ingest_tokens(docs, vocab, f"{root}/out", f"{root}/checkpoint", prepare).awaitTermination()
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    rows = jobs.token_sink(spark, f"{root}/out").select(
        "idx", F.lit("kept").alias("reason"), text("tokens"), text("mask"), "n_tokens", "vocab_sha1"
    )
    return rows.unionByName(jobs.quarantine_sink(spark, f"{root}/out").select("idx", "reason"), allowMissingColumns=True)


def stream_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_dir(spark, "funnel")
    docs = _stream(spark, sf_dir, "documents", ["doc_id", "text"])
    funnel = lambda batch: payload.filter_funnel(_metadata_of(batch, spark, sf_dir), views.payload(spark, sf_dir))
    jobs.funnel_stream(docs, funnel, f"{root}/counts", f"{root}/checkpoint").awaitTermination()
    return jobs.funnel_totals(spark, f"{root}/counts")


def stream_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_dir(spark, "shardstream")
    docs = _stream(spark, sf_dir, "documents", ["doc_id", "text"])
    members = F.create_map(F.lit("txt"), F.encode("text", "UTF-8"))
    jobs.shard_stream(docs, "doc_id", members, f"{root}/tars", f"{root}/checkpoint", 100).awaitTermination()
    back = shards.read_shards(spark, f"{root}/tars")
    return back.select(F.substring_index("shard", "-", -1).alias("shard"), "key", F.md5(shards.member("txt")).alias("text_md5"))


def stream_tars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to tars as they come, and a second stream that follows the tars."""
    root = fresh_dir(spark, "tarstream")
    members = F.create_map(F.lit("txt"), F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    docs = _stream(spark, sf_dir, "documents", ["doc_id", "text"])
    samples = docs.select(ordering.sample_key("doc_id").alias("key"), members.alias("members"))
    shards.shard_sink(samples, f"{root}/tars", f"{root}/checkpoint-out", 500).awaitTermination()
    rows = shards.follow_shards(spark, f"{root}/tars").select("key", F.md5(shards.member("txt")).alias("text_md5"))
    jobs.ingest(rows, lambda new: new, f"{root}/seen", f"{root}/checkpoint-in").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/seen")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir, "events", ["event_id", "ts", "event_type", "value"])
    return events.select(
        F.col("event_type").alias("series"), F.col("event_id").alias("step"),
        F.col("ts").cast("timestamp").alias("timestamp"), "value",
    )


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour means per series."""
    root = fresh_dir(spark, "windows")
    job = jobs.metric_windows(_event_stream(spark, sf_dir), f"{root}/out", f"{root}/checkpoint", "6 hours")
    job.awaitTermination()
    return jobs.latest_windows(spark, f"{root}/out").select(
        "series", F.unix_seconds("start").alias("start_s"), "n", F.round("mean_value", 6).alias("mean_value")
    )


def stream_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_dir(spark, "ema")
    job = jobs.ema_stream(
        _event_stream(spark, sf_dir), "series", ["timestamp", "step"], "value",
        f"{root}/out", f"{root}/checkpoint",
    )
    job.awaitTermination()
    return jobs.ema_rows(spark, f"{root}/out", "series").select("series", "step", F.round("ema", 6).alias("ema"))


QUERIES = {
    f.__name__: f
    for f in (
        metadata_formats, caption_file, shard_roundtrip, shard_quarantine, image_scan,
        score_folders, clip_score_folder, prepared_funnel, latent_shards, latent_batches, stage_encode, quarantine, vector_store,
        vocab_files, metric_log_file, stream_metric_log, stale_tokens, stream_ingest, stream_funnel, stream_shards, stream_tars, stream_windows, stream_ema,
    )
}

_VECTOR_CELLS = """unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"""
_PICTURE = """list_transform(range(8), lambda k: list_avg(list_transform(list_slice(embedding, k * 8 + 1, k * 8 + 8),
           lambda x: floor((x::DOUBLE + 1.0) * 127.5) / 255.0)))"""
_PICTURE_CELLS = f"""unnest({_PICTURE}) AS x, unnest(range(8)) AS i FROM embeddings)"""
# Captions are cut before they are encoded: their last words are folded as well.
_INGEST_ENCODE = token_plans._ENCODE.replace(
    "FROM words, ways)", "FROM (SELECT word, n FROM words UNION ALL SELECT word, NULL FROM cut_words) x, ways)"
).replace("words AS (SELECT '▁' || word AS word, n FROM raw)", """words AS (SELECT '▁' || word AS word, n FROM raw),
cut_words AS (
  SELECT DISTINCT '▁' || w AS word FROM (SELECT unnest(string_split(caption, ' ')) AS w FROM clamped)
  WHERE w <> '' AND '▁' || w NOT IN (SELECT word FROM words))""")
_INGEST = f"""WITH RECURSIVE {METADATA_SQL}, {SAFE_SQL},
clamped AS (SELECT idx, substr(caption, 1, 512) AS caption FROM safe),
{_INGEST_ENCODE},
kept_ids AS (
  SELECT idx, flatten(list(ids ORDER BY k)) AS ids FROM (
    SELECT idx, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM (
      SELECT idx, list_filter(string_split(caption, ' '), lambda w: w <> '') AS ws FROM clamped)) d
  JOIN coded ON coded.word = '▁' || d.word GROUP BY idx),
kept_rows AS (SELECT idx, ids, list_resize(list_slice(ids, 1, 77), 77, 0) AS t FROM kept_ids)
SELECT metadata.idx,
       CASE WHEN lower(coalesce("NSFW", 'none')) IN ('nsfw', 'unsafe', 'porn', 'sexual', '1') THEN 'unsafe'
            WHEN coalesce("URL", '') = '' THEN 'no_url' WHEN ids IS NULL THEN 'no_caption' ELSE 'kept' END AS reason,
       array_to_string(t, ' ') AS tokens, array_to_string(list_transform(t, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END), ' ') AS mask,
       len(ids)::INT AS n_tokens, CASE WHEN ids IS NOT NULL THEN vocab_sha1 END AS vocab_sha1
FROM metadata LEFT JOIN kept_rows USING (idx), stamp"""

ORACLES = {
    "metadata_formats": f"""WITH {METADATA_SQL}
SELECT lower(coalesce("NSFW", CASE WHEN idx % 4 = 0 AND NOT EXISTS (
         SELECT 1 FROM metadata m WHERE m.idx % 4 = 0 AND m."NSFW" IS NOT NULL) THEN '' ELSE 'none' END)) AS flag,
       md5("TEXT") AS text_md5, count(*) AS n, count("URL") AS with_url FROM metadata GROUP BY 1, 2""",
    "caption_file": PREPARE_SQL["caption_corpus"],
    "shard_roundtrip": f"""WITH {METADATA_SQL}, {PAYLOAD_SQL}, {SAFE_SQL},
kept AS (SELECT idx, substr(caption, 1, 512) AS caption, md5(html) AS payload_md5,
                row_number() OVER (ORDER BY idx) - 1 AS r FROM safe JOIN payload USING (url))
SELECT printf('%06d', r // 50) AS shard, printf('sample-%09d', idx) AS key, caption, payload_md5 FROM kept""",
    "shard_quarantine": """SELECT printf('%06d', doc_id % 30) AS shard, count(*) AS written,
  CASE WHEN doc_id % 30 % 3 = 0 THEN 0 ELSE count(*) END AS read,
  CASE WHEN doc_id % 30 % 3 = 0 THEN count(*) ELSE 0 END AS lost, doc_id % 30 % 3 = 0 AS damaged
FROM documents GROUP BY doc_id % 30""",
    "score_folders": f"""SELECT f.*, kid_mean, kid_std FROM ({FEATURE_SQL["fid"].replace(_VECTOR_CELLS, _PICTURE_CELLS)}) f,
({kid_sql(f"SELECT side || printf('/img-%09d.png', vec_id) AS key, side, {_PICTURE} AS embedding FROM (SELECT *, CASE WHEN label < 5 THEN 'real' ELSE 'fake' END AS side FROM embeddings)", 8, 5, 20, 0, 6)})""",
    "clip_score_folder": """WITH pictures AS (
  SELECT vec_id, list_transform(range(8), lambda k: list_avg(list_transform(list_slice(embedding, k * 8 + 1, k * 8 + 8),
         lambda x: floor((x::DOUBLE + 1.0) * 127.5) / 255.0))) AS image, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings),
prompts AS (
  SELECT list_transform(string_split('aehinost', ''), lambda c: (length(t) - length(replace(t, c, '')))::DOUBLE) AS text,
         row_number() OVER (ORDER BY item_id) AS r FROM (SELECT item_id, trim(text) AS t FROM benchmark) WHERE t <> ''),
scored AS (
  SELECT list_sum(list_transform(list_zip(image, text), lambda p: p[1] * p[2]))
         / (sqrt(list_sum(list_transform(image, lambda x: x * x))) * sqrt(list_sum(list_transform(text, lambda x: x * x)))) AS s
  FROM pictures JOIN prompts USING (r))
SELECT count(s) AS n, round(avg(s), 6) AS clip_mean, round(stddev_samp(s), 6) AS clip_std FROM scored""",
    "prepared_funnel": f"""WITH {METADATA_SQL}, {PAYLOAD_SQL}, funnel AS ({PREPARE_SQL['filter_funnel'].split('payload AS', 1)[1].split(')', 1)[1].strip()}),
sized AS (
  SELECT strlen(html) AS b FROM metadata JOIN payload ON payload.url = metadata."URL"
  WHERE lower(coalesce("NSFW", 'none')) NOT IN ('nsfw', 'unsafe', 'porn', 'sexual', '1') AND {clean_sql('"TEXT"')} <> ''),
lost AS (SELECT count(*) AS n FROM sized WHERE b % 7 = 0 OR b % 5 = 0)
SELECT reason, CASE WHEN reason = 'kept' THEN n - (SELECT n FROM lost) ELSE n END AS n FROM funnel
UNION ALL SELECT 'undecodable', n FROM lost WHERE n > 0
UNION ALL SELECT 'written', (SELECT count(*) FROM sized) - n FROM lost""",
    "latent_shards": """SELECT printf('%06d', doc_id // 100) AS shard, printf('latent-%09d', row_number() OVER (ORDER BY doc_id) - 1) AS key,
  md5(text) AS caption_md5, '3:' || ((strlen(text) + length(text) - length(replace(text, 'e', ''))) * 0.5::FLOAT)::DOUBLE AS latent
FROM documents""",
    "latent_batches": f"""WITH cleaned AS (
  SELECT doc_id, printf('latent-%09d', doc_id) AS key, {clean_sql('text')} AS caption FROM documents WHERE doc_id % 10 <> 0),
chars AS (
  SELECT doc_id, key, list_transform(string_split('▁' || replace(caption, ' ', '▁'), ''), lambda c:
         CASE WHEN c = '▁' THEN 5 WHEN regexp_matches(c, '^[a-z]$') THEN unicode(c) - 91 ELSE 3 END) AS ids
  FROM cleaned WHERE caption <> ''),
cut AS (
  SELECT doc_id, key, list_resize(list_slice(list_filter(ids, lambda x, i: x <> 3 OR i = 1 OR ids[i - 1] <> 3), 1, 77), 77, 0) AS t FROM chars),
dropped AS (
  SELECT doc_id, key, CASE WHEN {u32_sql(f"'{token_plans.SEED}'", "'1'", 'key')} / 4294967296.0 < 0.1
         THEN list_resize([4], 77, 0) ELSE t END AS t FROM cut),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('{token_plans.SEED}|1|' || key), key) - 1 AS r FROM dropped)
SELECT r // 16 AS batch_id, count(*) AS batch_rows, string_agg(key, ' ' ORDER BY r) AS keys,
       md5(string_agg(array_to_string(t, ' '), ' ' ORDER BY r)) AS tokens_md5,
       string_agg(doc_id || ' ' || (doc_id + 1) || ' ' || (doc_id + 2) || ' ' || (doc_id + 3), ' ' ORDER BY r) AS latents
FROM ranked GROUP BY 1""",
    "image_scan": """SELECT printf('img-%09d.png', vec_id) AS name, 8::BIGINT AS width, 8::BIGINT AS height, 3::BIGINT AS channels,
  list_sum(list_transform(embedding, lambda x: 3 * floor((x::DOUBLE + 1.0) * 127.5)))::BIGINT AS pixel_sum
FROM embeddings WHERE vec_id <> 0""",
    "stage_encode": f"""WITH cells AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1) // 8 AS i FROM embeddings)
SELECT vec_id, i, round(avg(x) * {LATENT_SCALE}::DOUBLE, 6) AS x FROM cells GROUP BY 1, 2""",
    "quarantine": """SELECT CASE WHEN contains(text, '@') THEN 'ValueError' WHEN contains(text, '.') THEN 'ok'
  ELSE 'dropped' END AS outcome, count(*) AS n FROM documents GROUP BY 1""",
    # The nearest 16-bit float: eleven bits from the leading one on, ties to even; below 2^-14 the step stays.
    "vector_store": """SELECT vec_id, 2 * len(embedding)::BIGINT AS bytes, array_to_string(list_transform(embedding, lambda x:
  CASE WHEN x = 0 THEN 0 ELSE (round_even(x::DOUBLE / pow(2.0, greatest(floor(log2(abs(x::DOUBLE))), -14) - 10), 0)
    * pow(2.0, greatest(floor(log2(abs(x::DOUBLE))), -14) + 14))::BIGINT END), ' ') AS units FROM embeddings""",
    "vocab_files": TOKEN_SQL["vocab_files"],
    "metric_log_file": """WITH log AS (
  SELECT CASE event_type WHEN 'click' THEN 'loss' WHEN 'view' THEN 'lr' WHEN 'error' THEN 'clip_mean'
         WHEN 'purchase' THEN 'clip_std' WHEN 'signup' THEN 'grad_norm' END AS series,
         event_id % 2000 AS step, epoch_us(ts) AS ts_us, value FROM events)
SELECT series, step, max(ts_us) AS ts_us, max_by(value, ts_us) AS value FROM log GROUP BY 1, 2""",
    "stream_metric_log": """SELECT CASE event_type WHEN 'click' THEN 'loss' WHEN 'view' THEN 'lr' WHEN 'error' THEN 'clip_mean'
  WHEN 'purchase' THEN 'clip_std' WHEN 'signup' THEN 'grad_norm' END AS series, event_id AS step, epoch_us(ts) AS ts_us, value
FROM events""",
    "stale_tokens": """SELECT doc_id, source, sha1(source || chr(10)) AS vocab_sha1 FROM documents
WHERE regexp_extract(source, '[0-9]+')::INT % 2 = 1""",
    "stream_ingest": _INGEST,
    "stream_funnel": PREPARE_SQL["filter_funnel"],
    "stream_shards": """WITH ranked AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents)
SELECT printf('%06d', r // 100) AS shard, printf('sample-%09d', doc_id) AS key, md5(text) AS text_md5 FROM ranked""",
    "stream_tars": "SELECT printf('sample-%09d', doc_id) AS key, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "stream_windows": """SELECT event_type AS series, epoch(time_bucket(INTERVAL 6 HOURS, ts))::BIGINT AS start_s,
  count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2""",
    "stream_ema": FEATURE_SQL["ema_series"],
}
