import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from captionloom.functions import hashing
from captionloom.functions import vectors as V
from captionloom.operators import moments, noise, scores
from captionloom.sources import images, paths


@pytest.fixture(scope="module")
def sets(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 6)) @ rng.normal(size=(6, 6)) + 1000.0
    y = rng.normal(size=(650, 6)) + 999.5
    rows = [(i, "real", v.tolist()) for i, v in enumerate(x)] + [(i + 700, "fake", v.tolist()) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "key bigint, side string, embedding array<double>").repartition(11), x, y


def test_moments_equal_numpy(spark, sets):
    df, x, y = sets
    rows = moments.feature_moments(df).orderBy("side", "i").collect()
    for side, data in (("real", x), ("fake", y)):
        part = [r for r in rows if r.side == side]
        assert {r.n for r in part} == {len(data)}
        np.testing.assert_allclose([r["mean"] for r in part], data.mean(axis=0), rtol=1e-12)
        np.testing.assert_allclose(np.array([r["cov"] for r in part]), np.cov(data.T), rtol=1e-8, atol=1e-9)


def test_kept_moments_equal_all_at_once(spark, sets, tmp_path):
    df, _, _ = sets
    store = str(tmp_path / "store")
    with pytest.raises(ValueError, match="holds no moments"):
        moments.kept_state(spark, store)
    parts = [df.filter(f"key % 3 = {i}") for i in range(3)]
    assert moments.add_to_kept(store, "a", "1", parts[0]) and not moments.add_to_kept(store, "a", "1", parts[1])
    assert moments.add_to_kept(store, "b", "1", parts[1]) and moments.add_to_kept(store, "none", "1", df.limit(0))
    # A run that was stopped before its list of sources was written has not happened.
    moments.moment_state(parts[0]).write.parquet(f"{store}/state/version=3")
    assert moments.add_to_kept(store, "c", "1", parts[2])
    with pytest.raises(ValueError, match="changed"):
        moments.add_to_kept(store, "b", "2", parts[1])
    got = moments.moments_of(moments.kept_state(spark, store)).orderBy("side", "i").collect()
    want = moments.feature_moments(df).orderBy("side", "i").collect()
    assert [(r.side, r.i, r.n) for r in got] == [(r.side, r.i, r.n) for r in want]
    np.testing.assert_allclose([r["mean"] for r in got], [r["mean"] for r in want], rtol=1e-12)
    np.testing.assert_allclose([r["cov"] for r in got], [r["cov"] for r in want], rtol=1e-8, atol=1e-9)


def test_folder_fingerprint_follows_the_listing(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    none = paths.folder_fingerprint(spark, str(folder))
    (folder / "a.png").write_bytes(b"one")
    one = paths.folder_fingerprint(spark, str(folder))
    assert none != one == paths.folder_fingerprint(spark, str(folder))
    (folder / "b.png").write_bytes(b"two")
    assert paths.folder_fingerprint(spark, str(folder)) != one == paths.folder_fingerprint(spark, str(folder), "a*")


def fid_twin(x, y):
    a, b = np.cov(x.T), np.cov(y.T)
    diff = x.mean(axis=0) - y.mean(axis=0)
    roots = np.sqrt(np.clip(np.linalg.eigvals(a @ b).real, 0, None)).sum()
    return diff @ diff + np.trace(a) + np.trace(b) - 2 * roots


def test_fid(spark, sets):
    df, x, y = sets
    row = moments.fid(df).first()
    assert (row.n_real, row.n_fake) == (700, 650)
    assert row.fid == pytest.approx(fid_twin(x, y), rel=1e-6)
    swapped = df.withColumn("side", F.when(F.col("side") == "real", "fake").otherwise("real"))
    assert moments.fid(swapped).first().fid == pytest.approx(row.fid, rel=1e-6)
    same = df.filter("side = 'real'")
    twice = same.unionByName(same.withColumn("side", F.lit("fake")))
    assert moments.fid(twice).first().fid == pytest.approx(0, abs=1e-6)


def test_fid_needs_both_sides(spark, sets):
    with pytest.raises(Exception, match="at least two vectors"):
        moments.fid(sets[0].filter("side = 'real'")).collect()


def test_kid_equals_pairwise(spark, sets):
    df, x, y = sets
    df = df.withColumn("embedding", F.transform("embedding", lambda v: (v - 1000.0) / 5))
    x, y = (x - 1000) / 5, (y - 1000) / 5
    got = {r.subset: r.mmd2 for r in scores.kernel_scores(df, subsets=4, subset_size=20, seed=9).collect()}
    for s in range(4):
        pick = lambda keys: sorted(keys, key=lambda k: (_draw(f"9|{k}", s), k))[:20]
        a, b = x[pick(range(700))], y[[k - 700 for k in pick(range(700, 1350))]]
        k = lambda p, q: (p @ q / 6 + 1) ** 3
        within = sum(k(z[i], z[j]) for z in (a, b) for i in range(20) for j in range(20) if i != j) / (20 * 19)
        between = sum(k(p, q) for p in a for q in b) / 400
        assert got[s] == pytest.approx(within - 2 * between, rel=1e-9)
    row = scores.kid(df, subsets=4, subset_size=20, seed=9).first()
    assert row.kid_mean == pytest.approx(np.mean(list(got.values())))
    assert row.kid_std == pytest.approx(np.std(list(got.values())))
    with pytest.raises(ValueError):
        scores.kid(df, subsets=2, subset_size=660)


@pytest.mark.parametrize("parts, batch", [(1, 10_000), (7, 16)])
def test_subsets_do_not_depend_on_tasks(spark, parts, batch):
    sides = {k: "real" if k < 100 or k > 950 else "fake" for k in range(1000)}
    rows = spark.createDataFrame([(f"k{k}", s) for k, s in sides.items()], "key string, side string").repartition(parts)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {tuple(r) for r in scores.draw_subsets(rows, "key", "side", 3, 40, 1).select("side", "subset", "key").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = set()
    for subset in range(3):
        for side in ("real", "fake"):
            order = sorted((_draw(f"1|k{k}", subset), f"k{k}") for k, s in sides.items() if s == side)
            want |= {(side, subset, key) for _, key in order[:40]}
    assert got == want


def _draw(text, subset):
    z = (int(hashlib.md5(text.encode()).hexdigest()[:16], 16) + (subset + 1) * 0x9E3779B97F4A7C15) % 2**64
    z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
    return z ^ (z >> 31)


def test_masked_mean_both_ways(spark):
    rows = spark.createDataFrame([(1, [5, 6, 0], [1, 1, 0]), (2, [0, 0, 0], [0, 0, 0]), (3, [6, 0, 0], [1, 0, 0])], "k int, tokens array<int>, mask array<int>")
    table = spark.createDataFrame([(5, [1.0, 2.0]), (6, [3.0, 6.0])], "id int, embedding array<double>")
    want = {1: [2.0, 4.0], 2: [0.0, 0.0], 3: [3.0, 6.0]}
    assert {r.k: r.pooled for r in scores.masked_mean(rows, table, "k").collect()} == want
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert {r.k: r.pooled for r in scores.masked_mean(rows, table, "k").collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_vector_columns(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [0, 255])], "a array<double>, z array<double>, p array<int>")
    got = row.select(
        V.l2_normalize("a").alias("u"), V.l2_normalize("z").alias("n"), V.cosine("a", "a").alias("c"), V.cosine("a", "z").alias("cz"),
        V.normalize_pixels("p").alias("x"), V.denormalize_pixels(F.array(F.lit(-3.0), F.lit(0.0), F.lit(1.0))).alias("y"),
        V.has_rank(F.array(F.lit(1), F.lit(1), F.lit(2)), 3, "a").alias("ok"), V.has_rank(F.array(F.lit(2)), 3, "a").alias("no"),
        V.has_rank(F.array(F.lit(1), F.lit(1), F.lit(3)), 3, "a").alias("bad"),
    ).first()
    assert got.u == pytest.approx([0.6, 0.8]) and got.n is None and got.c == pytest.approx(1) and got.cz is None
    assert got.x == [-1.0, 1.0] and got.y == [0.0, 0.5, 1.0] and (got.ok, got.no, got.bad) == (True, False, False)


def test_schedules(spark):
    linear = noise.noise_schedule(spark, "linear", 3).orderBy("t").collect()
    assert [r.beta for r in linear] == pytest.approx([0.0001, 0.01005, 0.02])
    assert linear[0].alpha_bar_prev == 1.0 and linear[0].posterior_variance == 0.0
    bars = np.cumprod([1 - r.beta for r in linear])
    assert [r.alpha_bar for r in linear] == pytest.approx(bars.tolist())
    cosine = noise.noise_schedule(spark, "cosine", 200).orderBy("t").collect()
    assert all(1e-8 <= r.beta <= 0.999 for r in cosine)
    assert all(a.alpha_bar > b.alpha_bar for a, b in zip(cosine, cosine[1:]))
    with pytest.raises(ValueError):
        noise.noise_schedule(spark, "sqrt", 10)
    assert noise.noise_schedule(spark, "linear", 1).first().beta == pytest.approx(0.0001)


def test_forward_noise_is_the_same_for_any_layout(spark):
    schedule = noise.noise_schedule(spark, "linear", 100)
    make = lambda parts: spark.range(0, 400, 1, parts).select(F.col("id").alias("k"), F.array(F.lit(1.0), F.lit(-1.0)).alias("x"))
    a, b = (sorted(map(tuple, noise.forward_noise(make(p), "k", "x", schedule, 100, 3).select("k", "t", "noised").collect())) for p in (1, 9))
    assert a == b
    drawn = make(4).select(hashing.normal(3, F.col("k"), "z").alias("e")).agg(F.avg("e").alias("m"), F.stddev("e").alias("s")).first()
    assert abs(drawn.m) < 0.2 and abs(drawn.s - 1) < 0.15


def test_moments_refuse_ragged_vectors(spark):
    for parts in (1, 3):
        rows = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0, 2.0, 3.0]), ("a", [1.0])], "side string, embedding array<double>")
        with pytest.raises(Exception, match="different lengths"):
            moments.feature_moments(rows.repartition(parts)).collect()


def test_moments_of_long_vectors(spark):
    x = np.random.default_rng(5).normal(size=(900, 512))
    df = spark.createDataFrame([("a", v.tolist()) for v in x], "side string, embedding array<double>").repartition(40)
    rows = moments.feature_moments(df).orderBy("i").collect()
    assert np.allclose(np.stack([r["cov"] for r in rows]), np.cov(x.T), atol=1e-9)


def test_packed_vectors_equal_numpy(spark, tmp_path):
    """Subnormals, ties, overflow, infinities, NaN, signed zero, null and other rows, as numpy rounds them."""
    odd = [1e-8, 6e-8, 2.0**-24 * 1.5, 2049.0, 2051.0, 65504.0, 65520.0, -1e30, float("inf"), float("nan"), -0.0, 0.1]
    rows = [(0, odd), (1, None), (2, [float(x) for x in np.random.default_rng(1).normal(size=12)])]
    frame = spark.createDataFrame(rows, "id long, latent array<double>").repartition(2)
    path = str(tmp_path / "half")
    images.write_vectors(frame, path, shape=(3, 4))
    stored = {r.id: r.latent for r in spark.read.parquet(path).collect()}
    assert stored[1] is None and len(stored[0].data) == 24 and list(stored[0].shape) == [3, 4]
    with np.errstate(over="ignore"):
        want = {i: np.array(v, np.float16) for i, v in rows if v}
    for i in (0, 2):
        assert bytes(stored[i].data) == want[i].tobytes()
    got = {r.id: r.latent for r in images.read_vectors(spark, path, shape=(3, 4)).collect()}
    assert got[1] is None
    for i in (0, 2):
        np.testing.assert_array_equal(np.array(got[i], np.float32), want[i].astype(np.float32))
    with pytest.raises(Exception, match="asked for"):
        images.read_vectors(spark, path, shape=(4, 3)).collect()
    with pytest.raises(Exception, match="do not fill"):
        frame.select(images.pack("latent", (5, 2))).collect()
    with pytest.raises(Exception, match="null inside"):
        spark.createDataFrame([([1.0, None],)], "v array<double>").select(images.pack("v")).collect()


def test_packed_vectors_of_any_length(spark, tmp_path):
    rows = [(0, [1.5]), (1, []), (2, [0.25, -3.0])]
    frame = spark.createDataFrame(rows, "id long, latent array<float>").coalesce(1)
    for dtype, width in (("float16", 2), ("float32", 4)):
        path = str(tmp_path / dtype)
        images.write_vectors(frame, path, dtype=dtype)
        assert {r.id: len(r.latent.data) for r in spark.read.parquet(path).collect()} == {i: width * len(v) for i, v in rows}
        assert {r.id: list(r.latent) for r in images.read_vectors(spark, path).collect()} == dict(rows)
        assert images.read_vectors(spark, path).limit(0).count() == 0
