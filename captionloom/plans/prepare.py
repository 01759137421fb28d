"""Queries over caption metadata: cleaning, filtering, payloads, order, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionloom.functions.hashing import timestep_sample
from captionloom.functions.text import clean_caption, clamp_text
from captionloom.operators import filters, ordering, payload, sampling
from captionloom.plans import views
from captionloom.plans.views import METADATA_SQL, PAYLOAD_SQL, SAFE_SQL, clean_sql, u32_sql
from captionloom.session import fresh_dir
from captionloom.sources import metadata as meta_source

SEED = 17


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.texts(spark, sf_dir)
    return docs.select("doc_id", clean_caption("text").alias("caption"))


def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.texts(spark, sf_dir, "pages", "page_id", "html")
    return pages.select("page_id", clean_caption("html").alias("caption"))


def safe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = views.metadata(spark, sf_dir)
    return meta.filter(filters.is_safe(meta)).select("idx", F.coalesce("NSFW", F.lit("none")).alias("flag"))


def caption_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.safe_captions(views.metadata(spark, sf_dir), 40)


def caption_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus lines with how often each occurs."""
    corpus = meta_source.captions(views.metadata(spark, sf_dir))
    return corpus.groupBy(F.md5(F.col("caption").cast("binary")).alias("caption_md5")).agg(
        F.count("*").alias("n"), F.max(F.length("caption")).cast("bigint").alias("chars")
    )


def filter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.filter_funnel(views.metadata(spark, sf_dir), views.payload(spark, sf_dir))


def attach_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.metadata(spark, sf_dir)
    joined = payload.attach_payload(filters.safe_captions(raw), views.payload(spark, sf_dir))
    return joined.select("idx", "url", "caption", F.md5(F.col("html").cast("binary")).alias("payload_md5"))


def missing_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.metadata(spark, sf_dir)
    return payload.missing_payload(filters.safe_captions(raw).select("idx", "url"), views.payload(spark, sf_dir))


def limit_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel of the first 120 input rows, as a limited trial run reports it."""
    meta = filters.limit_input(views.metadata(spark, sf_dir, indexed=True), 120)
    return payload.filter_funnel(meta)


def line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON Lines in order of their number, read back with the position of each line."""
    path = fresh_dir(spark, "lines")
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    docs.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").write.json(path)
    lines = ordering.lines_with_index(spark, path)
    row = F.from_json("value", "doc_id bigint, text string")
    return lines.select("idx", row["doc_id"].alias("doc_id"), F.md5(row["text"].cast("binary")).alias("text_md5"))


def shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.safe_captions(views.metadata(spark, sf_dir, indexed=True))
    ranked = ordering.kept_rank(kept.select("idx"))
    return ranked.select(
        ordering.sample_key("idx").alias("key"), "kept_rank", ordering.shard_id("kept_rank", 50).alias("shard")
    )


def shuffle_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select("doc_id")
    return ordering.shuffle_rank(docs, "doc_id", SEED, epoch=1)


def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select("doc_id")
    ranked = ordering.shuffle_rank(docs, "doc_id", SEED, epoch=1)
    made = ordering.batches(ranked, "shuffle_rank", ["doc_id"], 16)
    return made.select(
        "batch_id",
        F.col("batch_rows").cast("bigint").alias("batch_rows"),
        F.array_join(F.transform("doc_id", lambda x: x.cast("string")), " ").alias("doc_ids"),
    )


def caption_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select("doc_id")
    return docs.select(
        "doc_id",
        sampling.is_dropped(F.col("doc_id"), 0.1, SEED, epoch=2).alias("dropped"),
        timestep_sample(1000, SEED, F.col("doc_id"), "t").cast("bigint").alias("t"),
    )


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.select("doc_id", sampling.split_name(F.col("doc_id"), 0.05, SEED).alias("split"))


def resample_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many samples as there are shards drawn with replacement, shards of 50 documents."""
    docs = views.documents_indexed(spark, sf_dir).select("doc_id", "idx")
    shards = docs.select("doc_id", F.floor(F.col("idx") / 50).cast("bigint").alias("shard"))
    drawn = sampling.resample_shards(shards, "shard", draws_per_shard=1.0, seed=SEED)
    return drawn.groupBy("shard").agg(F.count("*").alias("rows"), F.countDistinct("draw").alias("draws"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta_source.url_manifest(views.table(spark, sf_dir, "pages"), "url")


def prompts_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 35 prompts of the benchmark lines and an inline prompt behind them (a limit is the feature)."""
    table = views.table(spark, sf_dir, "benchmark")
    return meta_source.prompt_table(table, "item_id", "text", inline="  a red fox ", limit=35).select("pos", "prompt")


def prompts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark lines as prompts, with the inline prompt at the end of the list."""
    table = views.table(spark, sf_dir, "benchmark")
    return meta_source.prompt_table(table, "item_id", "text", inline="  a red fox ").select("pos", "prompt")


LANES = 16


def shuffle_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to lanes and mixed in each by a buffer of 32 rows, with their place in the new order."""
    docs = views.table(spark, sf_dir, "documents").select(F.pmod("doc_id", F.lit(LANES)).cast("int").alias("lane"), "doc_id", "source")
    lanes = docs.repartitionById(LANES, "lane").sortWithinPartitions("doc_id")
    return ordering.buffer_shuffle(lanes, SEED, epoch=1, size=32, place="place")


def json_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a JSON Lines file that mixes ``NSFW``, ``nsfw`` and neither, with the flag of each key's presence."""
    path = fresh_dir(spark, "flags")
    meta = views.metadata(spark, sf_dir)
    key = F.col("idx") % 3
    line = (
        F.when(key == 0, F.to_json(F.struct("URL", "TEXT", "NSFW"), {"ignoreNullFields": "false"}))
        .when(key == 1, F.to_json(F.struct("URL", "TEXT", F.col("NSFW").alias("nsfw")), {"ignoreNullFields": "false"}))
        .otherwise(F.to_json(F.struct("URL", "TEXT"), {"ignoreNullFields": "false"}))
    )
    meta.select(line.alias("value")).write.text(path)
    rows = meta_source.read_json_lines_flagged(spark, path)
    return rows.groupBy(F.lower("NSFW").alias("flag"), F.md5(F.col("TEXT").cast("binary")).alias("text_md5")).agg(
        F.count("*").alias("n"), F.count("URL").alias("with_url")
    )


QUERIES = {
    f.__name__: f
    for f in (
        clean_documents, clean_pages, safe_rows, caption_clamp, caption_corpus, filter_funnel,
        attach_payload, missing_payload, limit_input, shard_assign, shuffle_rank, batch_assign,
        caption_dropout, holdout_split, resample_shards, manifest, prompts_union,
        prompts_all, shuffle_local, json_flags, line_index,
    )
}

_RANKED_SQL = f"""ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}|1|' || doc_id), doc_id) - 1 AS shuffle_rank
  FROM documents)"""

_PROMPTS_SQL = """SELECT pos, prompt FROM (
  SELECT item_id AS pos, trim(text) AS prompt FROM benchmark WHERE trim(text) <> ''
  UNION ALL SELECT max(item_id) + 1, 'a red fox' FROM benchmark WHERE trim(text) <> '')"""

ORACLES = {
    "clean_documents": f"SELECT doc_id, {clean_sql('text')} AS caption FROM documents",
    "clean_pages": f"SELECT page_id, {clean_sql('html')} AS caption FROM pages",
    "safe_rows": f"""WITH {METADATA_SQL}
SELECT idx, coalesce("NSFW", 'none') AS flag FROM metadata
WHERE lower(coalesce("NSFW", 'none')) NOT IN ('nsfw', 'unsafe', 'porn', 'sexual', '1')""",
    "caption_clamp": f"""WITH {METADATA_SQL}, {SAFE_SQL}
SELECT idx, url, substr(caption, 1, 40) AS caption FROM safe""",
    "caption_corpus": f"""SELECT md5(caption) AS caption_md5, count(*) AS n, max(length(caption)) AS chars
FROM (SELECT {clean_sql('text')} AS caption FROM documents) WHERE caption <> '' GROUP BY 1""",
    "filter_funnel": f"""WITH {METADATA_SQL}, {PAYLOAD_SQL}
SELECT CASE WHEN lower(coalesce("NSFW", 'none')) IN ('nsfw', 'unsafe', 'porn', 'sexual', '1') THEN 'unsafe'
            WHEN coalesce("URL", '') = '' THEN 'no_url'
            WHEN {clean_sql('"TEXT"')} = '' THEN 'no_caption'
            WHEN NOT EXISTS (SELECT 1 FROM payload WHERE payload.url = metadata."URL") THEN 'no_payload'
            ELSE 'kept' END AS reason, count(*) AS n
FROM metadata GROUP BY 1""",
    "attach_payload": f"""WITH {METADATA_SQL}, {PAYLOAD_SQL}, {SAFE_SQL}
SELECT idx, url, substr(caption, 1, 512) AS caption, md5(html) AS payload_md5 FROM safe JOIN payload USING (url)""",
    "missing_payload": f"""WITH {METADATA_SQL}, {PAYLOAD_SQL}, {SAFE_SQL}
SELECT idx, url FROM safe WHERE url NOT IN (SELECT url FROM payload)""",
    "limit_input": f"""WITH {METADATA_SQL}, numbered AS (
  SELECT *, row_number() OVER (ORDER BY idx) - 1 AS pos FROM metadata)
SELECT CASE WHEN lower(coalesce("NSFW", 'none')) IN ('nsfw', 'unsafe', 'porn', 'sexual', '1') THEN 'unsafe'
            WHEN coalesce("URL", '') = '' THEN 'no_url'
            WHEN {clean_sql('"TEXT"')} = '' THEN 'no_caption'
            ELSE 'kept' END AS reason, count(*) AS n
FROM numbered WHERE pos < 120 GROUP BY 1""",
    "shard_assign": f"""WITH {METADATA_SQL}, {SAFE_SQL}, ranked AS (
  SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS kept_rank FROM safe)
SELECT printf('sample-%09d', idx) AS key, kept_rank, printf('%06d', kept_rank // 50) AS shard FROM ranked""",
    "shuffle_rank": f"WITH {_RANKED_SQL} SELECT doc_id, shuffle_rank FROM ranked",
    "batch_assign": f"""WITH {_RANKED_SQL}
SELECT shuffle_rank // 16 AS batch_id, count(*) AS batch_rows,
       string_agg(doc_id::VARCHAR, ' ' ORDER BY shuffle_rank) AS doc_ids
FROM ranked GROUP BY 1""",
    "caption_dropout": f"""SELECT doc_id, {u32_sql(f"'{SEED}'", "'2'", 'doc_id')} / 4294967296.0 < 0.1 AS dropped,
       {u32_sql(f"'{SEED}'", 'doc_id', "'t'")} % 1000 AS t FROM documents""",
    "holdout_split": f"""SELECT doc_id,
       CASE WHEN {u32_sql(f"'{SEED}'", 'doc_id', "'split'")} / 4294967296.0 < 0.05
            THEN 'heldout' ELSE 'train' END AS split FROM documents""",
    "resample_shards": f"""WITH docs AS (
  SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS shard FROM documents),
shards AS (SELECT shard, count(*) AS rows, row_number() OVER (ORDER BY shard) - 1 AS pos FROM docs GROUP BY 1),
draws AS (SELECT g.range AS draw, {u32_sql(f"'{SEED}'", 'g.range', "'draw'")} % (SELECT count(*) FROM shards) AS pos
          FROM range(0, (SELECT count(*) FROM shards)) g)
SELECT shard, sum(rows)::BIGINT AS rows, count(*) AS draws FROM draws JOIN shards USING (pos) GROUP BY 1""",
    "manifest": """WITH urls AS (
  SELECT trim(url) AS url FROM pages WHERE trim(url) <> '' AND NOT starts_with(trim(url), '#')),
named AS (SELECT url, list_extract(string_split(url, '/'), -1) AS filename FROM urls)
SELECT url, filename, count(*) OVER (PARTITION BY filename) AS same_name FROM named""",
    "prompts_union": f"{_PROMPTS_SQL} ORDER BY pos LIMIT 35",
    "prompts_all": _PROMPTS_SQL,
    "line_index": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id, md5(text) AS text_md5 FROM documents",
    # A row goes out when the next one draws its slot; those whose slot is not drawn again follow by a hash of it.
    "shuffle_local": f"""WITH numbered AS (
  SELECT (doc_id % {LANES})::INT AS lane, doc_id, source, row_number() OVER (PARTITION BY doc_id % {LANES} ORDER BY doc_id) - 1 AS r
  FROM documents),
slots AS (
  SELECT *, CASE WHEN r < 32 THEN r ELSE ('0x' || substr(md5('{SEED}|1|' || lane || '|' || r), 1, 8))::BIGINT % 32 END AS slot
  FROM numbered),
sent AS (SELECT *, lead(r) OVER (PARTITION BY lane, slot ORDER BY r) AS at_row FROM slots)
SELECT lane, doc_id, source, row_number() OVER (
  PARTITION BY lane ORDER BY at_row NULLS LAST, md5('{SEED}|1|' || lane || '|rest|' || slot)) - 1 AS place FROM sent""",
    "json_flags": f"""WITH {METADATA_SQL}
SELECT CASE WHEN idx % 3 = 2 THEN '' ELSE lower(coalesce("NSFW", 'none')) END AS flag, md5(nullif("TEXT", '')) AS text_md5,
       count(*) AS n, count(nullif("URL", '')) AS with_url FROM metadata GROUP BY 1, 2""",
}
