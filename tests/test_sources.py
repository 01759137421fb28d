import json
import tarfile

import pytest
from pyspark.sql import functions as F

from captionloom.operators import encode, stages
from captionloom.sources import images, metadata, metric_log, shards, vocab
from captionloom.sources.paths import expand_braces


def test_read_metadata_by_suffix(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"URL": "u1", "TEXT": "one", "NSFW": 1}\n\n{"URL": "u2", "caption": "two"}\n')
    (tmp_path / "b.csv").write_text('url,TEXT\nu3,"say ""hi""\nthere"\n')
    (tmp_path / "c.TSV").write_text("url\ttext\tnsfw\nu4\tfour\tporn\n")
    spark.createDataFrame([("u5", "five", True)], "URL string, TEXT string, NSFW boolean").write.parquet(str(tmp_path / "d.parquet"))
    paths = [str(tmp_path / n) for n in ("a.jsonl", "b.csv", "c.TSV", "d.parquet")]
    rows = sorted(tuple(r) for r in metadata.read_standard(spark, *paths).collect())
    assert rows == [
        ("u1", "one", "1"), ("u2", "two", "none"), ("u3", 'say "hi"\nthere', ""), ("u4", "four", "porn"), ("u5", "five", "true"),
    ]
    assert metadata.read_metadata(spark, *paths).count() == 5
    with pytest.raises(ValueError):
        metadata.read_metadata(spark, str(tmp_path / "e.xml"))


def test_json_lines_keep_absent_from_null(spark, tmp_path):
    lines = [{"NSFW": None, "nsfw": "porn"}, {"nsfw": "porn"}, {}, {"NSFW": "NSFW", "URL": "", "url": "u", "text": "t"}]
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    rows = metadata.read_json_lines_flagged(spark, str(tmp_path / "m.jsonl")).collect()
    assert [r.NSFW for r in rows] == ["none", "porn", "", "NSFW"]
    assert (rows[3].URL, rows[3].TEXT) == ("u", "t")


def test_bad_json_fails(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"URL": "u"}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        metadata.read_metadata(spark, str(tmp_path / "bad.jsonl")).collect()


def test_manifest(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# list\n\nhttp://h/a/x.parquet \nhttp://h/b/x.parquet\nhttp://h/y\n")
    rows = {r.url: (r.filename, r.same_name) for r in metadata.read_url_manifest(spark, str(tmp_path / "urls.txt")).collect()}
    assert rows == {"http://h/a/x.parquet": ("x.parquet", 2), "http://h/b/x.parquet": ("x.parquet", 2), "http://h/y": ("y", 1)}


def test_prompts(spark, tmp_path):
    (tmp_path / "p.txt").write_text("  one \n\ntwo\r\nthree\n")
    read = lambda **k: [r.prompt for r in metadata.read_prompts(spark, str(tmp_path / "p.txt"), **k).orderBy("pos").collect()]
    assert read() == ["one", "two", "three"]
    assert read(inline=" last ") == ["one", "two", "three", "last"]
    assert read(limit=2) == ["one", "two"]
    with pytest.raises(ValueError):
        metadata.read_prompts(spark)


def test_braces():
    assert expand_braces("d/{000009..000011}.tar") == ["d/000009.tar", "d/000010.tar", "d/000011.tar"]
    assert expand_braces("x.tar") == ["x.tar"]


def _samples(spark, n, size):
    rows = spark.range(n).select(
        F.format_string("%06d", F.floor(F.col("id") / size)).alias("shard"),
        F.format_string("sample-%09d", "id").alias("key"),
        F.create_map(F.lit("png"), F.encode(F.concat(F.lit("img"), "id"), "UTF-8"), F.lit("txt"), F.encode(F.lit("été"), "UTF-8")).alias("members"),
    )
    return rows


def test_shards_roundtrip(spark, tmp_path):
    path = str(tmp_path / "shards")
    shards.write_shards(_samples(spark, 95, 10), path)
    names = sorted(p.name for p in (tmp_path / "shards").iterdir() if p.name != shards.LISTS)
    assert names == [f"{i:06d}.tar" for i in range(10)]
    back = shards.read_shards(spark, path + "/{000000..000009}.tar")
    assert back.count() == 95 and back.groupBy("shard").count().filter("count > 10").isEmpty()
    rows = shards.image_samples(back).orderBy("key").collect()
    assert [(r.key, bytes(r.image), r.caption) for r in rows[:2]] == [
        ("sample-000000000", b"img0", "été"), ("sample-000000001", b"img1", "été"),
    ]
    import tarfile

    with tarfile.open(tmp_path / "shards" / "000003.tar") as tar:
        assert [m.name for m in tar][:2] == ["sample-000000030.png", "sample-000000030.txt"]


def test_samples_behind_damage_are_read(spark, tmp_path):
    path = str(tmp_path / "shards")
    two = F.create_map(F.lit("jpg"), F.encode(F.repeat("text", F.lit(90)), "UTF-8"), F.lit("txt"), F.encode("text", "UTF-8"))
    rows = spark.range(40).select(
        F.format_string("%06d", F.floor(F.col("id") / 10)).alias("shard"),
        F.format_string("sample-%09d", "id").alias("key"),
        F.concat(F.lit("text of "), F.col("id").cast("string")).alias("text"),
    )
    shards.write_shards(rows.select("shard", "key", two.alias("members")), path)
    whole = {r.key: dict(r.members) for r in shards.read_shards(spark, path).collect()}
    places = {}
    for k in range(4):
        with tarfile.open(tmp_path / "shards" / f"{k:06d}.tar") as tar:
            places |= {m.name: m.offset for m in tar}

    def hurt(k, name, start, junk):
        file = tmp_path / "shards" / f"{k:06d}.tar"
        data = bytearray(file.read_bytes())
        at = places[name] + start
        data[at : at + len(junk)] = junk
        file.write_bytes(bytes(data))

    # A header in the middle: that member is lost, and with it its sample. Then the very first one, and a stretch over two samples.
    hurt(1, "sample-000000014.txt", 100, b"junk" * 20)
    hurt(2, "sample-000000020.jpg", 0, b"\xff" * 512)
    hurt(3, "sample-000000035.txt", 0, b"\xee" * (places["sample-000000036.txt"] - places["sample-000000035.txt"] + 512))
    for members in (True, False):
        got = {r.key: dict(r.members) for r in shards.read_shards(spark, path, skip_bad=True, members=members).collect()}
        lost = {f"sample-{i:09d}" for i in (14, 20, 35, 36)}
        assert set(got) == set(whole) - lost
        assert not members or all(got[k] == whole[k] for k in got)
    faults = {r["shard"]: (r["samples"], r["error"]) for r in shards.shard_faults(spark, path).collect()}
    assert faults["000000"] == (10, None) and [faults[f"{k:06d}"][0] for k in (1, 2, 3)] == [9, 9, 8]
    at = places["sample-000000014.txt"]
    assert faults["000001"][1] == f"bytes {at} to {at + 1024} are missing or no part of a tar; sample sample-000000014 has lost members"
    assert "bytes 0 to" in faults["000002"][1] and "sample-000000020" in faults["000002"][1]
    with pytest.raises(Exception, match="no part of a tar"):
        shards.read_shards(spark, path).count()
    # Cut off between two members, and an empty file.
    (tmp_path / "shards" / "000000.tar").write_bytes((tmp_path / "shards" / "000000.tar").read_bytes()[: places["sample-000000005.jpg"]])
    (tmp_path / "shards" / "000001.tar").write_bytes(b"")
    faults = {r["shard"]: (r["samples"], r["error"]) for r in shards.shard_faults(spark, path).collect()}
    assert faults["000000"][0] == 5 and "missing" in faults["000000"][1] and faults["000001"][0] == 0 and faults["000001"][1]


def test_damaged_shard(spark, tmp_path):
    path = str(tmp_path / "shards")
    shards.write_shards(_samples(spark, 30, 10), path)
    first = tmp_path / "shards" / "000001.tar"
    first.write_bytes(first.read_bytes()[:700])
    with pytest.raises(Exception):
        shards.read_shards(spark, path).count()
    n = shards.read_shards(spark, path, skip_bad=True).count()
    assert 20 <= n < 30
    faults = {r["shard"]: (r["samples"], r["error"]) for r in shards.shard_faults(spark, path).collect()}
    assert sum(f[0] for f in faults.values()) == n and faults["000001"][1] and faults["000000"] == (10, None)
    with pytest.raises(Exception, match="1 of 4 missing"):
        shards.read_shards(spark, path + "/{000000..000003}.tar").count()
    with pytest.raises(Exception, match="no shards"):
        shards.read_shards(spark, str(tmp_path / "none")).count()


def test_overwrite_and_append_of_shards(spark, tmp_path):
    path = str(tmp_path / "shards")
    shards.write_shards(_samples(spark, 30, 10), path)
    with pytest.raises(Exception, match="there already"):
        shards.write_shards(_samples(spark, 5, 10), path)
    (tmp_path / "shards" / "stray.tar").write_bytes(b"left behind by a failed job")
    assert shards.read_shards(spark, path).count() == 30
    shards.write_shards(_samples(spark, 7, 10), path, mode="overwrite")
    assert shards.read_shards(spark, path, members=False).count() == 7
    assert sorted(p.name for p in (tmp_path / "shards").glob("0*.tar")) == ["000000.tar"]


def test_bad_json_is_refused_whatever_is_selected(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"URL": "u", "TEXT": "t"}\n\nnot json\n')
    rows = metadata.read_json_lines_flagged(spark, str(tmp_path / "m.jsonl"))
    for columns in (["URL"], ["NSFW"], ["URL", "TEXT", "NSFW"]):
        with pytest.raises(Exception, match="not a JSON object"):
            rows.select(*columns).collect()


def test_no_images(spark, tmp_path):
    with pytest.raises(ValueError):
        images.scan_images(spark, str(tmp_path))


def test_vocab_files(spark, tmp_path):
    rows = [(0, "<pad>", 0.0), (1, "<s>", 0.0), (2, "</s>", 0.0), (3, "<unk>", 0.0), (4, "<null>", 0.0), (5, "a", 0.0), (6, '"', -1.0)]
    table = spark.createDataFrame(rows, "id int, piece string, score double")
    sha1 = vocab.write_vocab(table, str(tmp_path))
    back = vocab.read_vocab(spark, str(tmp_path / "tokenizer.vocab"))
    assert [tuple(r) for r in back.orderBy("id").collect()] == rows
    meta = vocab.read_vocab_meta(spark, str(tmp_path / "tokenizer_meta.json")).first()
    assert (meta.vocab_size, meta.model_type, meta.special_tokens["<null>"]) == (7, "bpe", 4)
    files = vocab.artifact_fingerprint(spark, str(tmp_path / "tokenizer.vocab"))
    assert files.first().sha1 == sha1 == vocab.vocab_fingerprint(table)
    tokens = spark.createDataFrame([(1, sha1), (2, "old"), (3, None)], "k int, vocab_sha1 string")
    assert [r.k for r in vocab.stale_rows(tokens, files).orderBy("k").collect()] == [2, 3]


def test_metric_log(spark, tmp_path):
    path = str(tmp_path / "log")
    metric_log.append_log(spark.createDataFrame([(1.5, 10, 0.25, None)], "timestamp double, step bigint, loss double, lr double"), path)
    metric_log.append_log(spark.createDataFrame([(20, 0.5)], "step bigint, clip_mean double"), path)
    rows = metric_log.read_log(spark, path).orderBy("step").collect()
    assert (rows[0].timestamp, rows[0].loss, rows[0].lr) == (1.5, 0.25, None) and rows[1].timestamp > 1e9
    long = metric_log.long_form(metric_log.read_log(spark, path)).orderBy("step").collect()
    assert [(r.step, r.series, r.value) for r in long] == [(10, "loss", 0.25), (20, "clip_mean", 0.5)]


def test_quarantine(spark):
    def halve(x):
        if x % 3 == 0:
            raise KeyError("three")
        return None if x % 2 else x // 2

    rows = spark.range(6).withColumn("r", stages.try_map(halve, "id", "bigint"))
    good, bad = stages.split_bad(rows, "r", "half")
    assert sorted(tuple(r) for r in good.collect()) == [(2, 1), (4, 2)]
    assert sorted((r.id, r.error.split(":")[0]) for r in bad.collect()) == [(0, "KeyError"), (1, "dropped"), (3, "KeyError"), (5, "dropped")]


def test_vocab_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(encode, "MAX_VOCAB", 2)
    with pytest.raises(ValueError):
        encode.vocab_rows(spark.createDataFrame([(i, str(i), 0.0) for i in range(3)], "id int, piece string, score double"))


def test_small_tars_are_read_together_and_large_ones_alone(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    rows = spark.range(300).select(
        F.format_string("%03d", "id").alias("shard"), F.format_string("k%d", "id").alias("key"),
        F.create_map(F.lit("txt"), F.encode(F.col("id").cast("string"), "UTF-8")).alias("members"),
    )
    shards.write_shards(rows, f"{tmp_path}/many")
    read = shards.read_shards(spark, f"{tmp_path}/many")
    assert spark.sparkContext.defaultParallelism <= read.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert {(r.shard, r.key, bytes(r.members["txt"])) for r in read.collect()} == {(f"{i:03d}", f"k{i}", b"%d" % i) for i in range(300)}
    paths = [f"{tmp_path}/many/{i:03d}.tar" for i in range(300)]
    monkeypatch.setattr(shards, "TASK_BYTES", 1)
    assert [t.paths for t in shards._packed(paths, 8)] == [[p] for p in paths]


def test_small_pictures_are_scanned_together(spark, tmp_path):
    from captionloom.plans import storage

    raw = storage._png(storage.np.zeros((8, 8)))
    for i in range(1300):
        (tmp_path / f"img-{i:05d}.png").write_bytes(raw)
    scanned = images.scan_images(spark, str(tmp_path))
    assert scanned.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert scanned.filter("width = 8 AND height = 8").select("name").distinct().count() == 1300
