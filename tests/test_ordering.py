import hashlib
import math

import pytest
from pyspark.sql import functions as F

from captionloom.functions.hashing import normal, u32, uniform
from captionloom.operators import ordering, payload, sampling, series, skew


def md5_u32(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def test_hash_is_plain_md5(spark):
    row = spark.range(5, 6).select(u32(17, F.col("id"), "t"), uniform(17, F.col("id")), normal(17, F.col("id"))).first()
    assert row[0] == md5_u32(17, 5, "t")
    assert row[1] == md5_u32(17, 5) / 2**32
    digest = hashlib.md5(b"17|5").hexdigest()
    u, v = ((int(digest[i : i + 8], 16) + 0.5) / 2**32 for i in (0, 8))
    assert row[2] == pytest.approx(math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v), abs=1e-12)


def test_row_index_over_many_files(spark, tmp_path):
    spark.range(0, 1000, 1, 7).withColumnRenamed("id", "k").write.parquet(str(tmp_path / "t"))
    rows = ordering.with_row_index(spark.read.parquet(str(tmp_path / "t")))
    assert rows.filter("idx = k").count() == 1000


def test_kept_rank_and_shards(spark):
    kept = spark.range(0, 3000, 1, 5).withColumnRenamed("id", "idx").filter("idx % 3 <> 1")
    ranked = ordering.kept_rank(kept, block_rows=100).orderBy("idx").collect()
    assert [r.kept_rank for r in ranked] == list(range(2000))
    names = ordering.kept_rank(kept, block_rows=64).select(ordering.shard_id("kept_rank", 150).alias("s")).groupBy("s").count()
    counts = {r.s: r["count"] for r in names.collect()}
    assert counts == {f"{i:06d}": 150 for i in range(13)} | {"000013": 50}
    keys = spark.range(3).filter("id <> 1").select(ordering.sample_key("id").alias("k")).orderBy("k").collect()
    assert [r.k for r in keys] == ["sample-000000000", "sample-000000002"]


@pytest.mark.parametrize("parts", [1, 16])
def test_shuffle_does_not_depend_on_partitions(spark, parts):
    rows = spark.range(0, 500, 1, parts).withColumnRenamed("id", "k")
    got = [r.k for r in ordering.shuffle_rank(rows, "k", 3, epoch=1).orderBy("shuffle_rank").collect()]
    assert got == sorted(range(500), key=lambda k: hashlib.md5(f"3|1|{k}".encode()).hexdigest())


def test_chunks_follow_the_rows(spark):
    before = spark.conf.get("spark.captionloom.chunkRows")
    cores = spark.sparkContext.defaultParallelism
    try:
        for most, rows, least in ((400, 5000, 25), (400, 0, 1), (400, 7, 1), (400, 100, min(cores, 4)), (100_000, 5000, 1)):
            spark.conf.set("spark.captionloom.chunkRows", str(most))
            assert ordering.chunks_for(spark, rows) == least
            # A third of the rows share a name.
            df = spark.range(rows).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("name"))
            chunks = ordering.range_chunks(df, ["name", "id"])
            sizes = [r["count"] for r in chunks.groupBy("_chunk").count().collect()]
            assert sum(sizes) == rows and max(sizes, default=0) <= most
            got = [r.id for r in chunks.orderBy("_chunk", "_place").collect()]
            assert got == [r.id for r in df.orderBy("name", "id").collect()]
    finally:
        spark.conf.set("spark.captionloom.chunkRows", before)


def test_global_rank_with_heavy_ties(spark):
    rows = spark.range(0, 5000, 1, 6).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("name"), "id")
    got = ordering.global_rank(rows, ["name", "id"])
    want = sorted((r.name, r.id) for r in rows.collect())
    assert [(r.name, r.id) for r in got.orderBy("rank").collect()] == want
    assert [r.rank for r in got.orderBy("rank").collect()] == list(range(5000))


def test_batches_are_in_order(spark):
    rows = spark.range(10).select(F.col("id").alias("rank"), (F.col("id") * 2).alias("x"))
    made = ordering.batches(rows, "rank", ["x"], 4).orderBy("batch_id").collect()
    assert [r.x for r in made] == [[0, 2, 4, 6], [8, 10, 12, 14], [16, 18]]
    assert [r.batch_rows for r in made] == [4, 4, 2]


def test_zip_reports_the_unmatched(spark):
    a = spark.createDataFrame([("b",), ("a",), ("c",)], "image string")
    b = spark.createDataFrame([(2, "q"), (1, "p")], "pos int, prompt string")
    got = sorted((r.rank, r.image, r.prompt) for r in ordering.zip_by_rank(a, ["image"], b, ["pos"]).collect())
    assert got == [(0, "a", "p"), (1, "b", "q"), (2, "c", None)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_plain_join(spark, how):
    hot = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("u"), F.col("id") % 90))
    left = spark.range(3000).select("id", hot.alias("url"))
    right = spark.range(60).select(F.concat(F.lit("u"), "id").alias("url"), F.col("id").alias("v")).union(
        spark.createDataFrame([("hot", -1)], "url string, v bigint")
    )
    plain = left.join(right, "url", how)
    joined = skew.skew_join(left, right, "url", how).select(*plain.columns)
    key = lambda rows: sorted(map(repr, (tuple(r) for r in rows)))
    assert key(joined.collect()) == key(plain.collect())


def test_hot_keys_are_split_as_the_join_runs(spark):
    names = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        # Half of the rows have one key, the others have 100 keys.
        name = F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.floor(F.col("id") / 2) % 100)
        left = spark.range(0, 400_000, 1, 16).select("id", name.alias("url"), F.md5(F.col("id").cast("string")).alias("pad"))
        right = left.groupBy("url").agg(F.count("*").alias("n"))
        joined = skew.skew_join(left, right, "url").withColumn("task", F.spark_partition_id())
        rows = [r["n"] for r in joined.groupBy("task").agg(F.count("*").alias("n"), F.max("pad"), F.max("id")).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert sum(rows) == 400_000 and max(rows) < 100_000


def test_funnel_total_is_input(spark):
    meta = spark.createDataFrame(
        [("u1", "a", None)] * 5 + [("u2", "b", None)] * 3 + [(None, "c", None), ("u1", "", None), ("u1", "x", "NSFW")],
        "URL string, TEXT string, NSFW string",
    )
    fetched = spark.createDataFrame([("u1", b"1")], "url string, body binary")
    got = {r.reason: r.n for r in payload.filter_funnel(meta, fetched).collect()}
    assert got == {"kept": 5, "no_payload": 3, "no_url": 1, "no_caption": 1, "unsafe": 1}


def test_dropout_rate_and_mask(spark):
    rows = spark.range(20000).select(F.col("id").alias("key"), F.array(F.lit(7), F.lit(8), F.lit(0), F.lit(0)).alias("tokens"))
    out = sampling.caption_dropout(rows, "key", 0.1, 5, epoch=1, length=4)
    n = out.filter(F.col("tokens")[0] == 4).count()
    assert abs(n - 2000) < 4 * math.sqrt(20000 * 0.1 * 0.9)
    kinds = {(tuple(r.tokens), tuple(r["mask"])) for r in out.distinct().collect()}
    assert kinds == {((7, 8, 0, 0), (1, 1, 0, 0)), ((4, 0, 0, 0), (1, 0, 0, 0))}
    again = sampling.caption_dropout(rows.repartition(3), "key", 0.1, 5, epoch=2, length=4)
    assert again.filter(F.col("tokens")[0] == 4).count() != n


def test_resampling_with_replacement(spark):
    rows = spark.range(100).select("id", F.format_string("%06d", F.floor(F.col("id") / 10)).alias("shard"))
    drawn = sampling.resample_shards(rows, "shard", seed=1, draws=30)
    assert drawn.count() == 300 and drawn.select("draw").distinct().count() == 30
    names = [f"{md5_u32(1, i, 'draw') % 10:06d}" for i in range(30)]
    got = {r.draw: r.shard for r in drawn.select("draw", "shard").distinct().collect()}
    assert got == dict(enumerate(names))


def _log(spark, n=6000):
    name = F.when(F.col("id") % 3 == 0, F.lit("other").cast("string")).otherwise("hot")
    value = F.sin(F.col("id") * 0.37) * 5 + 2
    return spark.range(0, n, 1, 9).select(
        name.alias("series"), F.col("id").alias("step"), F.timestamp_micros(F.col("id") * 1_500_000).alias("timestamp"), value.alias("value")
    )


def ema(values, d, s=None):
    out = []
    for x in values:
        s = x if s is None else d * s + (1 - d) * x
        out.append(s)
    return out


@pytest.mark.parametrize("decay", [0.0, 0.5, 0.999, 1.0])
def test_ema_equals_the_loop(spark, decay):
    log = _log(spark)
    got = series.ema_series(log, "series", ["timestamp", "step"], "value", decay).orderBy("series", "step").collect()
    for name in ("hot", "other"):
        rows = [r for r in got if r.series == name]
        assert [r.ema for r in rows] == pytest.approx(ema([r.value for r in rows], decay), abs=1e-9)
    small = spark.createDataFrame([("s", 1, 1.0), ("s", 2, 2.0), ("s", 3, 3.0)], "series string, step int, value double")
    out = series.ema_series(small, "series", ["step"], "value", 0.9).orderBy("step").collect()
    assert [round(r.ema, 9) for r in out] == [1.0, 1.1, 1.29]


def test_ema_skips_nulls_and_splits_series(spark):
    rows = [("a", i, None if i % 5 == 0 else float(i % 7)) for i in range(700)] + [("b", i, None) for i in range(3)] + [(None, 0, 1.0)]
    frame = spark.createDataFrame(rows, "series string, step int, value double")
    got = series.ema_series(frame, "series", ["step"], "value", 0.9).collect()
    by = {(r.series, r.step): r.ema for r in got}
    live = [(i, v) for s, i, v in rows if s == "a" and v is not None]
    assert [by["a", i] for i, _ in live] == pytest.approx(ema([v for _, v in live], 0.9), abs=1e-9)
    assert len(got) == len(rows) and all(by[s, i] is None for s, i, v in rows if v is None)


def test_previous_crosses_chunks(spark):
    log = _log(spark)
    got = series.throughput(log, "series").orderBy("series", "step").collect()
    for name in ("hot", "other"):
        steps = [r.step for r in got if r.series == name]
        assert [r.prev_step for r in got if r.series == name] == [None, *steps[:-1]]
    assert {round(r.steps_per_sec, 6) for r in got if r.prev_step is not None} == {round(1 / 1.5, 6)}


def test_log_latest_and_gaps(spark):
    log = spark.createDataFrame(
        [("a", 1, 10, 0.1), ("a", 1, 12, 0.2), ("a", 25, 13, 0.3), ("a", 47, 14, 0.4)], "series string, step bigint, timestamp bigint, value double"
    )
    latest = {r.step: r.value for r in series.log_latest(log, ["series", "step"]).collect()}
    assert latest == {1: 0.2, 25: 0.3, 47: 0.4}
    rows = series.metric_buckets(log, "series", 10).orderBy("bucket").collect()
    assert [(r.bucket, r.n, r.missing_before) for r in rows] == [(0, 2, 0), (2, 1, 1), (4, 1, 1)]


def test_lines_are_numbered_over_files_and_splits(spark, tmp_path):
    texts = [f"{'x' * (i % 50)} {i}" if i % 9 else "" for i in range(5000)]
    for k in range(3):
        (tmp_path / f"part-{k}.txt").write_text("\n".join(texts[k * 2000 : (k + 1) * 2000]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
        rows = ordering.lines_with_index(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.value for r in sorted(rows, key=lambda r: r.idx)] == texts and {r.idx for r in rows} == set(range(5000))


def _buffered(rows, part, size, seed=7, epoch=2):
    held, out = list(rows[:size]), []
    for i, row in enumerate(rows[size:], size):
        slot = md5_u32(seed, epoch, part, i) % size
        out.append(held[slot])
        held[slot] = row
    last = lambda slot: hashlib.md5(f"{seed}|{epoch}|{part}|rest|{slot}".encode()).hexdigest()
    return out + [held[slot] for slot in sorted(range(len(held)), key=last)]


@pytest.mark.parametrize("size", [1, 10, 100, 5000])
def test_buffer_shuffle_equals_a_plain_buffer(spark, size):
    """Partitions below, at and far above the buffer, one of them empty, over several Arrow batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "64")
    try:
        part = F.when(F.col("id") < 10, 0).when(F.col("id") < 110, 1).otherwise(3)
        frame = spark.range(1500).select("id", F.when(F.col("id") % 3 > 0, F.repeat(F.lit("x"), 3)).alias("t"), part.alias("part"))
        lanes = frame.repartitionById(4, "part").sortWithinPartitions("id")
        got = ordering.buffer_shuffle(lanes, 7, 2, size, "place").collect()
    finally:
        spark.conf.set(name, before)
    for part, rows in ((0, range(10)), (1, range(10, 110)), (3, range(110, 1500))):
        mixed = [r for r in got if r.part == part]
        assert [r.id for r in sorted(mixed, key=lambda r: r.place)] == _buffered(list(rows), part, size)
        assert all((r.t is None) == (r.id % 3 == 0) for r in mixed)
    assert ordering.buffer_shuffle(lanes.limit(0), 7).count() == 0


def test_buffer_shuffle_in_a_stream(spark, tmp_path):
    spark.range(300).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    mixed = ordering.buffer_shuffle(stream, 7, 2, 20, "place").writeStream.format("parquet").option("path", str(tmp_path / "out"))
    mixed.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("place").collect()
    assert [r.id for r in rows] == _buffered(list(range(300)), 0, 20)
    with pytest.raises(ValueError, match="buffer"):
        ordering.buffer_shuffle(stream, 7, size=0)


def test_rows_are_ranked_without_their_bytes(spark, tmp_path):
    rows = spark.createDataFrame([(i % 5, f"b{i}") for i in range(2000)], "k int, wide string")
    rows.write.parquet(str(tmp_path / "rows"))
    seen = []

    def rank(keys):
        seen.extend(keys.columns)
        return ordering.global_rank(keys, ["k", *ordering.SPOT])

    got = ordering.rank_by_spot(ordering.with_spot(spark.read.parquet(str(tmp_path / "rows"))), ["k"], rank)
    assert got.columns == ["k", "wide", "rank"] and seen == ["k", *ordering.SPOT]
    out = sorted(got.collect(), key=lambda r: r.rank)
    assert [r.rank for r in out] == list(range(2000))
    assert [r.k for r in out] == sorted(i % 5 for i in range(2000))
    assert sorted(r.wide for r in out) == sorted(f"b{i}" for i in range(2000))
