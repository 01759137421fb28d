"""Queries over vectors and metric logs: scores, moments, noise, series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionloom.functions import vectors as V
from captionloom.functions.tokens import attention_mask, pad_truncate
from captionloom.operators import moments, noise, ordering, payload, scores, series
from captionloom.plans import views
from captionloom.plans.views import u32_sql
from captionloom.session import fresh_dir
from captionloom.sources import paths

SEED = 17
TIMESTEPS = 1000


def pixel_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 0..255 pixels, normalised, and brought back to [0, 1]."""
    pixels = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1.0) * 127.5))
    rows = views.vectors(spark, sf_dir).select("vec_id", V.normalize_pixels(pixels).alias("p"))
    return rows.select(
        "vec_id",
        V.vector_text("p").alias("normalized"),
        V.vector_text(V.denormalize_pixels(F.transform("p", lambda x: x * 2.0))).alias("clamped"),
    )


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifted vectors brought to unit length."""
    shifted = F.transform("embedding", lambda x, i: x.cast("double") + i / 64.0)
    rows = views.vectors(spark, sf_dir).select("vec_id", shifted.alias("v"))
    return rows.select(
        "vec_id", F.round(V.l2_norm("v"), 6).alias("norm"), V.vector_text(V.l2_normalize("v")).alias("unit")
    )


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = views.vectors(spark, sf_dir)
    pair = F.floor(F.col("vec_id") / 2).cast("bigint").alias("pair")
    images = vecs.filter("vec_id % 2 = 0").select(pair, F.col("label"), F.col("embedding").alias("image"))
    texts = vecs.filter("vec_id % 2 = 1").select(pair, F.col("embedding").alias("text"))
    return scores.clip_pairs(images, texts, "pair")


def clip_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("pair", F.round("similarity", 6).alias("similarity"))


def clip_score_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_label = scores.clip_score(_pairs(spark, sf_dir), "label")
    return by_label.select(
        F.col("label").cast("bigint").alias("label"),
        "n",
        F.round("clip_mean", 6).alias("clip_mean"),
        F.round("clip_std", 6).alias("clip_std"),
    )


def zip_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image names in text order against prompts in list order; the unmatched are shown."""
    names = views.vectors(spark, sf_dir).select(F.concat(F.lit("img-"), F.col("vec_id"), F.lit(".png")).alias("image"))
    prompts = views.table(spark, sf_dir, "benchmark").select("item_id")
    return ordering.zip_by_rank(names, ["image"], prompts, ["item_id"])


def feature_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = moments.feature_moments(views.sided_vectors(spark, sf_dir))
    return m.select("side", F.col("i").cast("bigint").alias("i"), "n", F.round("mean", 9).alias("mean"))


def feature_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = moments.feature_moments(views.sided_vectors(spark, sf_dir))
    cells = m.select("side", F.col("i").cast("bigint").alias("i"), F.posexplode("cov").alias("j", "c"))
    return cells.select("side", "i", F.col("j").cast("bigint").alias("j"), F.round("c", 9).alias("cov"))


def fid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = moments.fid(views.sided_vectors(spark, sf_dir))
    return found.select("n_real", "n_fake", F.round("fid", 6).alias("fid"))


def fid_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same distance from a kept state, to which the vectors come folder by folder, one of them twice."""
    root = fresh_dir(spark, "kept")
    views.sided_vectors(spark, sf_dir).withColumn("part", F.pmod("key", F.lit(3))).write.partitionBy("part").parquet(f"{root}/in")
    for part in (0, 1, 0, 2):
        folder = f"{root}/in/part={part}"
        stamp = paths.folder_fingerprint(spark, folder)
        moments.add_to_kept(f"{root}/moments", f"part {part}", stamp, spark.read.parquet(folder))
    found = moments.frechet_distance(moments.moments_of(moments.kept_state(spark, f"{root}/moments")))
    return found.select("n_real", "n_fake", F.round("fid", 6).alias("fid"))


def kid(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scores.kid(views.sided_vectors(spark, sf_dir), subsets=10, subset_size=50, seed=SEED)
    return scored.select("subsets", F.round("kid_mean", 9).alias("kid_mean"), F.round("kid_std", 9).alias("kid_std"))


def masked_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as token rows (a turn is a token, numbered from 1), pooled over the vectors of their turns."""
    turns = views.table(spark, sf_dir, "conversations")
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.col("turn").cast("int") + 1)).alias("ids"))
    rows = rows.select("conv_id", pad_truncate("ids", 77).alias("tokens"))
    rows = rows.withColumn("mask", attention_mask("tokens"))
    table = views.vectors(spark, sf_dir).select((F.col("vec_id").cast("int") + 1).alias("id"), "embedding")
    pooled = scores.masked_mean(rows, table, "conv_id")
    return pooled.select("conv_id", V.vector_text("pooled").alias("pooled"))


def noise_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear schedule at the timestep drawn for each vector."""
    rows = views.vectors(spark, sf_dir).select(
        "vec_id", noise.timestep_sample(TIMESTEPS, SEED, F.col("vec_id"), "t").alias("t")
    )
    placed = noise.gather_schedule(rows, noise.noise_schedule(spark, "linear", TIMESTEPS))
    return placed.select(
        "vec_id",
        F.col("t").cast("bigint").alias("t"),
        *[F.round(c, 9).alias(c) for c in ("beta", "alpha_bar", "alpha_bar_prev", "posterior_variance")],
    )


def _noised(spark: SparkSession, sf_dir: str) -> DataFrame:
    schedule = noise.noise_schedule(spark, "cosine", TIMESTEPS)
    rows = views.vectors(spark, sf_dir).select("vec_id", "embedding")
    return noise.forward_noise(rows, "vec_id", "embedding", schedule, TIMESTEPS, SEED, with_noise=True)


def forward_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noised(spark, sf_dir).select(
        "vec_id", F.col("t").cast("bigint").alias("t"), V.vector_text("noised").alias("noised")
    )


def mse_by_timestep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of taking the noised vector itself for the noise."""
    noised = _noised(spark, sf_dir)
    scored = noise.mse_by_timestep(
        noised.select("vec_id", "t", "noised"), noised.select("vec_id", "noise"), "vec_id", 100, "noised"
    )
    return scored.select("t_bucket", "rows", F.round("mse", 6).alias("mse"))


def latent_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latents of three axes with the caption of the same key; others are skipped."""
    shape = F.when(F.col("label") == 9, F.array(F.lit(8), F.lit(8))).otherwise(F.array(F.lit(4), F.lit(4), F.lit(4)))
    latents = views.vectors(spark, sf_dir).select(
        F.col("vec_id").alias("key"), F.col("embedding").alias("latent"), shape.alias("shape")
    )
    captions = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "n_chars")
    good = latents.filter(V.has_rank("shape", 3, "latent"))
    return payload.latent_to_caption(good, captions).select(
        "key", "n_chars", F.round(V.l2_norm("latent"), 6).alias("norm")
    )


def log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log with repeated steps (one step per user and series): the last of each."""
    log = views.metric_log(spark, sf_dir).withColumn("step", F.col("step") % 500)
    latest = series.log_latest(log, ["series", "step"])
    return latest.select("series", "step", F.unix_micros("timestamp").alias("ts_us"), "value")


def log_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = series.throughput(views.metric_log(spark, sf_dir), "series")
    return rated.select("series", "step", "prev_step", F.round("steps_per_sec", 6).alias("steps_per_sec"))


def metric_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = series.metric_buckets(views.metric_log(spark, sf_dir), "series", 10)
    return made.select("series", "bucket", "n", F.round("mean_value", 6).alias("mean_value"), "last_value", "missing_before")


def ema_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.metric_log(spark, sf_dir)
    smooth = series.ema_series(log, "series", ["timestamp", "step"], "value", decay=0.999)
    return smooth.select("series", "step", F.round("ema", 6).alias("ema"))


QUERIES = {
    f.__name__: f
    for f in (
        pixel_norm, unit_vectors, clip_pairs, clip_score_by_label, zip_prompts, feature_mean, feature_cov,
        fid, fid_kept, kid, masked_mean, noise_levels, forward_noise, mse_by_timestep, latent_captions,
        log_latest, log_throughput, metric_buckets, ema_series,
    )
}


def _vec_sql(expr: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda x: round(x * 1000000.0)::BIGINT), ' ')"


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_COS = (
    f"{_DOT.format(a='i.embedding', b='t.embedding')} / (sqrt({_DOT.format(a='i.embedding', b='i.embedding')})"
    f" * sqrt({_DOT.format(a='t.embedding', b='t.embedding')}))"
)
_PAIRS_SQL = f"""pairs AS (
  SELECT i.vec_id // 2 AS pair, i.label, {_COS} AS similarity
  FROM embeddings i JOIN embeddings t ON t.vec_id = i.vec_id + 1 WHERE i.vec_id % 2 = 0)"""

_CELLS_SQL = """cells AS (
  SELECT vec_id, CASE WHEN label < 5 THEN 'real' ELSE 'fake' END AS side,
         unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"""

_DIGEST = f"md5('{SEED}|' || vec_id || '|' || i)"
_NOISED_SQL = f"""curve AS (
  SELECT range AS t, pow(cos((range / {TIMESTEPS}.0 + 0.008) / 1.008 * (pi() * 0.5)), 2) AS f
  FROM range(0, {TIMESTEPS + 1})),
betas AS (SELECT a.t, greatest(least(1 - b.f / a.f, 0.999), 1e-8) AS beta FROM curve a JOIN curve b ON b.t = a.t + 1),
bars AS (SELECT t, exp(sum(ln(1 - beta)) OVER (ORDER BY t)) AS alpha_bar FROM betas),
cells AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i,
         {u32_sql(f"'{SEED}'", 'vec_id', "'t'")} % {TIMESTEPS} AS t FROM embeddings),
noise AS (
  SELECT vec_id, i, x, t,
    sqrt(-2 * ln((('0x' || substr({_DIGEST}, 1, 8))::BIGINT + 0.5) / 4294967296.0))
    * cos(2 * pi() * ((('0x' || substr({_DIGEST}, 9, 8))::BIGINT + 0.5) / 4294967296.0)) AS e FROM cells),
noised AS (
  SELECT vec_id, i, t, e, sqrt(alpha_bar) * x + sqrt(1 - alpha_bar) * e AS y FROM noise JOIN bars USING (t))"""

_HALF = "list_transform(embedding, lambda x: (floor((x::DOUBLE + 1.0) * 127.5) / 255.0 - 0.5) / 0.5)"


def kid_sql(vectors: str, dim: int, subsets: int, size: int, seed: int, digits: int = 9) -> str:
    """KID of ``key, side, embedding`` rows, with the draws of ``scores.draw_subsets``."""
    wrap = f"% {2**64}::UHUGEINT"
    return f"""WITH v AS ({vectors}),
hashed AS (
  SELECT s.range AS subset, v.*, (('0x' || substr(md5('{seed}|' || key), 1, 16))::UBIGINT::UHUGEINT
         + (s.range + 1)::UHUGEINT * {scores.STEP}::UHUGEINT) {wrap} AS a FROM v, range(0, {subsets}) s),
mixed AS (SELECT *, (xor(a, a // {2**30}::UHUGEINT) * {scores.MIX[0]}::UHUGEINT) {wrap} AS b FROM hashed),
drawn AS (SELECT *, (xor(b, b // {2**27}::UHUGEINT) * {scores.MIX[1]}::UHUGEINT) {wrap} AS c FROM mixed),
ranked AS (
  SELECT subset, key, embedding, side, row_number() OVER (
    PARTITION BY side, subset ORDER BY xor(c, c // {2**31}::UHUGEINT), key) AS r FROM drawn),
chosen AS (SELECT * FROM ranked WHERE r <= {size}),
pairs AS (
  SELECT a.subset, a.side AS sa, b.side AS sb, a.key = b.key AS same,
         pow({_DOT.format(a='a.embedding', b='b.embedding')} / {dim} + 1, 3) AS k
  FROM chosen a JOIN chosen b USING (subset)),
scored AS (
  SELECT subset, sum(k) FILTER (sa = sb AND NOT same) / ({size} * {size - 1})
       - 2 * avg(k) FILTER (sa = 'real' AND sb = 'fake') AS mmd2 FROM pairs GROUP BY 1)
SELECT count(*) AS subsets, round(avg(mmd2), {digits}) AS kid_mean, round(stddev_pop(mmd2), {digits}) AS kid_std FROM scored"""


ORACLES = {
    "pixel_norm": f"""SELECT vec_id, {_vec_sql('p')} AS normalized,
  {_vec_sql('list_transform(p, lambda y: (greatest(least(y * 2.0, 1.0), -1.0) + 1.0) / 2.0)')} AS clamped
FROM (SELECT vec_id, {_HALF} AS p FROM embeddings)""",
    "unit_vectors": f"""WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x, i: x::DOUBLE + (i - 1) / 64.0) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt({_DOT.format(a='v', b='v')}) AS norm FROM v)
SELECT vec_id, round(norm, 6) AS norm, {_vec_sql('list_transform(v, lambda y: y / norm)')} AS unit FROM n""",
    "clip_pairs": f"WITH {_PAIRS_SQL} SELECT pair, round(similarity, 6) AS similarity FROM pairs",
    "clip_score_by_label": f"""WITH {_PAIRS_SQL}
SELECT label::BIGINT AS label, count(*) AS n, round(avg(similarity), 6) AS clip_mean,
       round(stddev_samp(similarity), 6) AS clip_std FROM pairs GROUP BY 1""",
    "zip_prompts": """WITH a AS (
  SELECT image, row_number() OVER (ORDER BY image) - 1 AS rank FROM (SELECT 'img-' || vec_id || '.png' AS image FROM embeddings)),
b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS rank FROM benchmark)
SELECT rank, image, item_id FROM a FULL JOIN b USING (rank)""",
    "feature_mean": f"WITH {_CELLS_SQL} SELECT side, i, count(*) AS n, round(avg(x), 9) AS mean FROM cells GROUP BY 1, 2",
    "feature_cov": f"""WITH {_CELLS_SQL}
SELECT a.side, a.i, b.i AS j, round(covar_samp(a.x, b.x), 9) AS cov
FROM cells a JOIN cells b USING (vec_id) GROUP BY 1, 2, 3""",
    # The trace of the root of the product: coupled Newton-Schulz steps on the matrix over its trace.
    "fid": f"""WITH RECURSIVE {_CELLS_SQL},
m AS (SELECT side, i, avg(x) AS mean, count(*) AS n FROM cells GROUP BY 1, 2),
c AS (
  SELECT a.side, a.i, b.i AS j, covar_samp(a.x, b.x) AS v
  FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND a.side = b.side GROUP BY 1, 2, 3),
p AS (
  SELECT a.i, b.j, sum(a.v * b.v) AS v FROM c a JOIN c b ON a.j = b.i WHERE a.side = 'real' AND b.side = 'fake' GROUP BY 1, 2),
s AS (SELECT sum(v) AS s FROM p WHERE i = j),
steps AS (
  SELECT 0 AS k, 'y' AS w, i, j, v / s AS v FROM p, s
  UNION ALL SELECT 0, 'z', i, j, (i = j)::INT::DOUBLE FROM p
  UNION ALL
  SELECT k, w, i, j, v FROM (
    SELECT any_value(y.k) + 1 AS k, 'y' AS w, y.i, t.j, sum(y.v * t.v) AS v FROM steps y JOIN (
      SELECT z.i, x.j, 1.5 * (z.i = x.j)::INT - 0.5 * sum(z.v * x.v) AS v
      FROM steps z JOIN steps x ON z.w = 'z' AND x.w = 'y' AND z.j = x.i GROUP BY z.i, x.j) t
    ON y.w = 'y' AND y.j = t.i WHERE y.k < 45 GROUP BY y.i, t.j
    UNION ALL
    SELECT any_value(z.k) + 1, 'z', t.i, z.j, sum(t.v * z.v) FROM steps z JOIN (
      SELECT z.i, x.j, 1.5 * (z.i = x.j)::INT - 0.5 * sum(z.v * x.v) AS v
      FROM steps z JOIN steps x ON z.w = 'z' AND x.w = 'y' AND z.j = x.i GROUP BY z.i, x.j) t
    ON z.w = 'z' AND t.j = z.i WHERE z.k < 45 GROUP BY t.i, z.j)),
root AS (SELECT sum(v) * sqrt(any_value(s)) AS tr FROM steps, s WHERE w = 'y' AND i = j AND k = (SELECT max(k) FROM steps))
SELECT (SELECT max(n) FROM m WHERE side = 'real') AS n_real, (SELECT max(n) FROM m WHERE side = 'fake') AS n_fake,
       round((SELECT sum((a.mean - b.mean) ** 2) FROM m a JOIN m b USING (i) WHERE a.side = 'real' AND b.side = 'fake')
             + (SELECT sum(v) FROM c WHERE i = j) - 2 * tr, 6) AS fid FROM root""",
    "kid": kid_sql("SELECT vec_id AS key, embedding, CASE WHEN label < 5 THEN 'real' ELSE 'fake' END AS side FROM embeddings", 64, 10, 50, SEED),
    "masked_mean": f"""WITH tok AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
live AS (SELECT conv_id, turn FROM tok WHERE r <= 77),
cells AS (SELECT l.conv_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
          FROM live l JOIN embeddings e ON e.vec_id = l.turn),
means AS (SELECT conv_id, i, avg(x) AS m FROM cells GROUP BY 1, 2),
pooled AS (SELECT conv_id, list(m ORDER BY i) AS p FROM means GROUP BY 1)
SELECT c.conv_id, {_vec_sql('coalesce(p, list_resize([0.0::DOUBLE], 64, 0.0))')} AS pooled
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN pooled USING (conv_id)""",
    "noise_levels": f"""WITH betas AS (
  SELECT range AS t, 0.0001::DOUBLE + range * (0.0199::DOUBLE / 999) AS beta FROM range(0, {TIMESTEPS})),
bars AS (SELECT t, beta, exp(sum(ln(1 - beta)) OVER (ORDER BY t)) AS alpha_bar FROM betas),
prev AS (SELECT *, coalesce(lag(alpha_bar) OVER (ORDER BY t), 1.0) AS alpha_bar_prev FROM bars)
SELECT vec_id, t, round(beta, 9) AS beta, round(alpha_bar, 9) AS alpha_bar, round(alpha_bar_prev, 9) AS alpha_bar_prev,
       round(beta * (1 - alpha_bar_prev) / (1 - alpha_bar), 9) AS posterior_variance
FROM (SELECT vec_id, {u32_sql(f"'{SEED}'", 'vec_id', "'t'")} % {TIMESTEPS} AS t FROM embeddings) JOIN prev USING (t)""",
    "forward_noise": f"""WITH {_NOISED_SQL}
SELECT vec_id, t, {_vec_sql('list(y ORDER BY i)')} AS noised FROM noised GROUP BY 1, 2""",
    "mse_by_timestep": f"""WITH {_NOISED_SQL}
SELECT t // 100 AS t_bucket, count(DISTINCT vec_id) AS rows, round(avg((y - e) * (y - e)), 6) AS mse
FROM noised GROUP BY 1""",
    "latent_captions": f"""SELECT vec_id AS key, n_chars, round(sqrt({_DOT.format(a='embedding', b='embedding')}), 6) AS norm
FROM embeddings JOIN documents ON doc_id = vec_id WHERE label <> 9""",
    "log_latest": """SELECT event_type AS series, event_id % 500 AS step, epoch_us(max(ts)) AS ts_us,
  max_by(value, ts) AS value FROM events GROUP BY 1, 2""",
    "log_throughput": """WITH e AS (
  SELECT event_type AS series, event_id AS step, epoch_us(ts) AS us FROM events),
p AS (SELECT *, lag(step) OVER w AS prev_step, us - lag(us) OVER w AS d FROM e WINDOW w AS (PARTITION BY series ORDER BY step))
SELECT series, step, prev_step,
       round(CASE WHEN d > 0 THEN (step - prev_step) * 1e6 / d END, 6) AS steps_per_sec FROM p""",
    "metric_buckets": """WITH b AS (
  SELECT event_type AS series, event_id // 10 AS bucket, count(*) AS n, round(avg(value), 6) AS mean_value,
         max_by(value, event_id) AS last_value FROM events GROUP BY 1, 2)
SELECT *, coalesce(bucket - lag(bucket) OVER (PARTITION BY series ORDER BY bucket) - 1, 0) AS missing_before FROM b""",
    "ema_series": """WITH RECURSIVE x AS (
  SELECT event_type AS series, event_id AS step, value,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
r AS (
  SELECT series, step, n, value AS s FROM x WHERE n = 1
  UNION ALL
  SELECT x.series, x.step, x.n, 0.999::DOUBLE * r.s + 0.001::DOUBLE * x.value FROM r JOIN x ON x.series = r.series AND x.n = r.n + 1)
SELECT series, step, round(s, 6) AS ema FROM r""",
}
# What was added folder by folder is what was read at once.
ORACLES["fid_kept"] = ORACLES["fid"]
