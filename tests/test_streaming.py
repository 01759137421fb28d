"""Streams of several micro-batches equal the batch result."""

import pytest
from pyspark.sql import functions as F

from captionloom.operators import bpe, encode, filters, payload, series
from captionloom.sources import shards
from captionloom.sources import vocab as vocab_source
from captionloom.streaming import jobs
from tests.test_ordering import _log


@pytest.fixture(scope="module")
def log_files(spark, tmp_path_factory):
    """A log in four files, in time order."""
    path = str(tmp_path_factory.mktemp("log") / "files")
    for i in range(4):
        _log(spark, 2000).filter(F.floor(F.col("step") / 500) == i).coalesce(1).write.mode("append").parquet(path)
    return path


def stream_of(spark, path):
    return jobs.file_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1)


EMA = ("series", ["timestamp", "step"], "value")


def _ema_of(spark, out):
    return {(r.series, r.step): r.ema for r in jobs.ema_rows(spark, out, "series", 0.9).collect()}


def test_ema_over_batches(spark, log_files, tmp_path):
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    jobs.ema_stream(stream_of(spark, log_files), *EMA, out, ck, 0.9).awaitTermination()
    want = {(r.series, r.step): r.ema for r in series.ema_series(_log(spark, 2000), *EMA, 0.9).collect()}
    assert _ema_of(spark, out) == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError, match="decay"):
        jobs.ema_stream(stream_of(spark, log_files), *EMA, out, ck, 0.8)


def _last_commit(checkpoint):
    last = max((p for p in (checkpoint / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (checkpoint / "commits" / f".{last.name}.crc").unlink(missing_ok=True)


def test_ema_goes_on_after_a_kill(spark, tmp_path):
    """Each half is stopped once between its write and its commit, with nulls, a new series and an untouched one about."""
    path, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "ck"
    names = "series string, timestamp long, step long, value double"
    parts = [
        [("a", i, i, float(i % 7)) for i in range(300)] + [("idle", 0, 0, 5.0), (None, 1, 1, 2.0), ("a", 300, 300, None)],
        [("a", i, i, float(i % 5)) for i in range(301, 600)] + [("new", 301, 301, None), ("new", 302, 302, 4.0)],
        [("a", i, i, float(i % 3)) for i in range(600, 700)] + [("new", 600, 600, 1.0)],
    ]

    def add(rows):
        spark.createDataFrame(rows, names).coalesce(1).write.mode("append").parquet(path)

    add(parts[0])
    jobs.ema_stream(stream_of(spark, path), *EMA, out, str(ck), 0.9).awaitTermination()
    add(parts[1])
    jobs.ema_local_stream(stream_of(spark, path), *EMA, out, str(ck / "local"), 0.9).awaitTermination()
    _last_commit(ck / "local")
    jobs.ema_stream(stream_of(spark, path), *EMA, out, str(ck), 0.9).awaitTermination()
    _last_commit(ck / "carry")
    add(parts[2])
    jobs.ema_stream(stream_of(spark, path), *EMA, out, str(ck), 0.9).awaitTermination()
    rows = [r for part in parts for r in part]
    want = {(r.series, r.step): r.ema for r in series.ema_series(spark.createDataFrame(rows, names), *EMA, 0.9).collect()}
    got = _ema_of(spark, out)
    assert len(got) == len(rows) and got[None, 1] is None and got["new", 301] is None
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx({k: v for k, v in want.items() if v is not None}, abs=1e-9)


@pytest.mark.parametrize("slide", [None, "5 minutes"])
def test_windows_over_batches(spark, log_files, tmp_path, slide):
    stream = stream_of(spark, log_files)
    jobs.metric_windows(stream, str(tmp_path / "w"), str(tmp_path / "ck"), "10 minutes", slide).awaitTermination()
    got = {(r.series, r.start): (r.n, round(r.mean_value, 9)) for r in jobs.latest_windows(spark, str(tmp_path / "w")).collect()}
    span = F.window("timestamp", "10 minutes", slide) if slide else F.window("timestamp", "10 minutes")
    rows = _log(spark, 2000).groupBy("series", span.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("m")).collect()
    assert got == {(r.series, r.w.start): (r.n, round(r.m, 9)) for r in rows}


def test_compacted_windows_are_the_same(spark, log_files, tmp_path):
    out, ck = str(tmp_path / "w"), str(tmp_path / "ck")

    def state():
        return {(r.series, r.start): (r.n, r.mean_value) for r in jobs.latest_windows(spark, out).collect()}

    jobs.metric_windows(stream_of(spark, log_files), out, ck, "10 minutes").awaitTermination()
    before = state()
    batches = lambda: sorted(p.name for p in (tmp_path / "w").glob("batch_id=*"))
    last = max(int(name.split("=")[1]) for name in batches())
    # A snapshot without its mark has not happened.
    spark.read.parquet(out).limit(1).write.parquet(f"{out}-snapshot/through={last - 1}")
    assert state() == before
    jobs.compact_windows(spark, out)
    assert batches() == [f"batch_id={last}"] and state() == before
    jobs.compact_windows(spark, out)
    assert batches() == [f"batch_id={last}"] and state() == before
    grown = spark.read.parquet(out).drop("batch_id").limit(3).withColumn("n", F.col("n") + 5)
    grown.write.parquet(f"{out}/batch_id={last + 1}")
    changed = {(r.series, r.start): (r.n, r.mean_value) for r in grown.collect()}
    jobs.compact_windows(spark, out)
    assert batches() == [f"batch_id={last + 1}"] and state() == before | changed
    assert sorted(p.name for p in (tmp_path / "w-snapshot").glob("through=*")) == [f"through={last}"]


def test_late_rows_are_dropped(spark, tmp_path):
    path = str(tmp_path / "in")
    # A batch is filtered by the watermark the batch before it ran with, so one batch lies between.
    for hour in (0, 30, 31, 1):
        rows = spark.createDataFrame([("s", hour * 3600, 1.0)], "series string, t bigint, value double")
        rows.select("series", F.timestamp_seconds("t").alias("timestamp"), "value").coalesce(1).write.mode("append").parquet(path)
    jobs.metric_windows(stream_of(spark, path), str(tmp_path / "w"), str(tmp_path / "ck"), "1 hour").awaitTermination()
    starts = sorted(r.start.timestamp() // 3600 for r in jobs.latest_windows(spark, str(tmp_path / "w")).collect())
    assert starts == [0, 30, 31]


def test_shards_over_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    for i in range(2):
        spark.range(i * 25, i * 25 + 25).select("id", F.concat(F.lit("text "), "id").alias("text")).coalesce(1).write.mode("append").parquet(path)
    members = F.create_map(F.lit("txt"), F.encode("text", "UTF-8"))
    jobs.shard_stream(stream_of(spark, path), "id", members, str(tmp_path / "tars"), str(tmp_path / "ck"), 10).awaitTermination()
    names = sorted(p.name for p in (tmp_path / "tars").iterdir() if p.name != shards.LISTS)
    assert names == [f"{b:06d}-{s:06d}.tar" for b in range(2) for s in range(3)]
    back = shards.read_shards(spark, str(tmp_path / "tars")).select(F.decode(shards.member("txt"), "UTF-8").alias("t"))
    assert sorted(r.t for r in back.collect()) == sorted(f"text {i}" for i in range(50))


def test_funnel_and_ingest_over_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [("u", "A <b>x</b>", None), ("", "b", None), ("u", "c", "porn")]
    for _ in range(3):
        spark.createDataFrame(rows, "URL string, TEXT string, NSFW string").coalesce(1).write.mode("append").parquet(path)
    jobs.funnel_stream(stream_of(spark, path), payload.filter_funnel, str(tmp_path / "f"), str(tmp_path / "ck")).awaitTermination()
    got = {r.reason: r.n for r in jobs.funnel_totals(spark, str(tmp_path / "f")).collect()}
    assert got == {"kept": 3, "no_url": 3, "unsafe": 3}
    from captionloom.operators.filters import safe_captions

    for _ in range(2):  # the second run finds nothing new
        jobs.ingest(stream_of(spark, path), safe_captions, str(tmp_path / "rows"), str(tmp_path / "ck2")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "rows")).collect()] == [("u", "a x")] * 3


def test_token_ingest_over_restarts(spark, tmp_path):
    path, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")

    def more(first):
        for k in range(first, first + 2):
            rows = [("u", f"A <b>red</b> fox {k}", None), ("", "b", None), ("u", "c " * 600, "ok"), ("u", " ", None), ("u", "d", "porn")]
            spark.createDataFrame(rows, "URL string, TEXT string, NSFW string").coalesce(1).write.mode("append").parquet(path)

    more(0)
    words = spark.createDataFrame([("▁red", 5), ("▁fox", 4), ("▁a", 3), ("▁cat", 1)], "word string, n bigint")
    vocab = bpe.bpe_train(words, 22, coverage=1.0)
    ran = []

    def failing(batch):
        ran.append(1)
        if len(ran) == 2:
            raise RuntimeError("lost")
        return filters.with_reason(batch)

    with pytest.raises(Exception, match="lost"):
        jobs.ingest_tokens(stream_of(spark, path), vocab, out, checkpoint, failing).awaitTermination()
    for first in (2, 4):  # goes on where it stopped, then takes what is new
        jobs.ingest_tokens(stream_of(spark, path), vocab, out, checkpoint).awaitTermination()
        more(first)
    jobs.ingest_tokens(stream_of(spark, path), vocab, out, checkpoint).awaitTermination()
    got = jobs.token_sink(spark, out)
    safe = filters.safe_captions(spark.read.parquet(path))
    want = encode.token_rows(safe, vocab)
    columns = ["caption", "tokens", "mask", "n_tokens"]
    read = lambda rows: sorted(str(tuple(r)) for r in rows.select(F.left("caption", F.lit(512)).alias("caption"), *columns[1:]).collect())
    assert read(got) == read(want) and len(read(got)) == 12
    assert {r.vocab_sha1 for r in got.collect()} == {vocab_source.vocab_fingerprint(vocab)}
    dropped = jobs.quarantine_sink(spark, out).groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in dropped} == {"no_url": 6, "no_caption": 6, "unsafe": 6}
    other = bpe.bpe_train(words, 20, coverage=1.0)
    with pytest.raises(ValueError, match="was begun with"):
        jobs.ingest_tokens(stream_of(spark, path), other, out, checkpoint)

def _texts(spark, path):
    back = shards.read_shards(spark, path).select(F.decode(shards.member("txt"), "UTF-8").alias("t"))
    return sorted(r.t for r in back.collect())


def _sink(spark, path, tmp_path, size=10):
    rows = stream_of(spark, path).select(
        F.format_string("k%06d", "id").alias("key"), F.create_map(F.lit("txt"), F.encode("text", "UTF-8")).alias("members")
    )
    return shards.shard_sink(rows, str(tmp_path / "tars"), str(tmp_path / "ck"), size)


def _follow(spark, tmp_path):
    rows = shards.follow_shards(spark, str(tmp_path / "tars")).select("key", F.decode(shards.member("txt"), "UTF-8").alias("t"))
    jobs.ingest(rows, lambda x: x, str(tmp_path / "seen"), str(tmp_path / "ck-follow")).awaitTermination()
    return sorted(r.t for r in spark.read.parquet(str(tmp_path / "seen")).collect())


def _more(spark, path, first, n=25):
    rows = spark.range(first, first + n).select("id", F.concat(F.lit("text "), "id").alias("text"))
    rows.coalesce(1).write.mode("append").parquet(path)


def test_committed_shards_come_once(spark, tmp_path):
    path = str(tmp_path / "in")
    want = []
    for first in (0, 25, 50):
        _more(spark, path, first)
        want = sorted(want + [f"text {i}" for i in range(first, first + 25)])
        _sink(spark, path, tmp_path).awaitTermination()
        assert _texts(spark, str(tmp_path / "tars")) == want
        # The follower starts again each time, and goes on behind what it has seen.
        assert _follow(spark, tmp_path) == want
    # An uncommitted tar and a batch write beside the stream.
    (tmp_path / "tars" / "stray.tar").write_bytes(b"not a tar")
    batch = spark.createDataFrame([("extra", "k", {"txt": bytearray(b"late")})], "shard string, key string, members map<string,binary>")
    shards.write_shards(batch, str(tmp_path / "tars"))
    assert _follow(spark, tmp_path) == sorted([*want, "late"])
    names = sorted(p.name for p in (tmp_path / "tars").glob("0*.tar"))
    assert len(names) == 9 and not list((tmp_path / "tars").glob("_staging*"))


def test_an_epoch_that_runs_again_is_listed_once(spark, tmp_path):
    path = str(tmp_path / "in")
    _more(spark, path, 0)
    _sink(spark, path, tmp_path).awaitTermination()
    before = sorted(p.name for p in (tmp_path / "tars").iterdir())
    # Killed after the commit of the folder, before that of the checkpoint.
    for p in (tmp_path / "ck" / "commits").iterdir():
        p.unlink()
    _sink(spark, path, tmp_path).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "tars").iterdir()) == before
    assert _follow(spark, tmp_path) == sorted(f"text {i}" for i in range(25))


def test_follower_refuses_an_overwritten_folder(spark, tmp_path):
    path = str(tmp_path / "in")
    _more(spark, path, 0)
    _sink(spark, path, tmp_path).awaitTermination()
    fresh = spark.createDataFrame([("a", "k", {"txt": bytearray(b"x")})], "shard string, key string, members map<string,binary>")
    _follow(spark, tmp_path)
    shards.write_shards(fresh, str(tmp_path / "tars"), mode="overwrite")
    with pytest.raises(Exception, match="committed lists"):
        _follow(spark, tmp_path)


def test_following_a_folder_without_commits(spark, tmp_path):
    (tmp_path / "tars").mkdir()
    rows = shards.follow_shards(spark, str(tmp_path / "tars")).select("key")
    jobs.ingest(rows, lambda x: x, str(tmp_path / "seen"), str(tmp_path / "ck-follow")).awaitTermination()
    with pytest.raises(ValueError):
        shards.shard_sink(rows.withColumn("members", F.create_map(F.lit("a"), F.lit(b"b"))), str(tmp_path / "o"), str(tmp_path / "c"), 0).awaitTermination()
