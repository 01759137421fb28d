"""Queries over captions as words and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionloom.functions.text import clean_rows
from captionloom.functions.tokens import attention_mask, check_length, pad_truncate
from captionloom.operators import bpe, encode, lexicon, sampling
from captionloom.plans import views
from captionloom.session import materialize
from captionloom.plans.views import clean_sql, u32_sql
from captionloom.sources import vocab as vocab_source

SEED = 17
VOCAB_SIZE = 2000
LENGTH = 77


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.texts(spark, sf_dir)
    return clean_rows(docs, "text", "doc_id")


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of the documents, learnt anew and written down for the query's own uses."""
    words = lexicon.training_words(_corpus(spark, sf_dir))
    return materialize(bpe.bpe_train(words, VOCAB_SIZE), "vocab")


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.word_counts(_corpus(spark, sf_dir))


def char_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lexicon.word_counts(_corpus(spark, sf_dir))
    covered = lexicon.char_coverage(words)
    return covered.select("char", "n", F.round("share_before", 9).alias("share_before"), "kept")


def bpe_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the first round, with the piece each would make."""
    words = materialize(lexicon.training_words(_corpus(spark, sf_dir)), "words")
    table = bpe.symbol_table(words, lexicon.char_coverage(words))
    return bpe.pair_counts(table).select("left", "right", "n")


def bpe_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocab(spark, sf_dir)


def _token_rows(spark: SparkSession, sf_dir: str, vocab: DataFrame) -> DataFrame:
    return encode.token_rows(_corpus(spark, sf_dir), vocab, "caption", LENGTH)


def bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token rows of the documents, stamped with the vocabulary they were made with."""
    vocab = _vocab(spark, sf_dir)
    stamp = vocab_source.vocab_fingerprint(vocab)
    rows = _token_rows(spark, sf_dir, vocab)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return rows.select(
        "doc_id", text("tokens").alias("tokens"), text("mask").alias("mask"), "n_tokens", F.lit(stamp).alias("vocab_sha1")
    )


def bpe_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded texts next to the spelling they came from; they agree where no piece was unknown."""
    vocab = _vocab(spark, sf_dir)
    rows = _corpus(spark, sf_dir).withColumn("ids", encode.bpe_encode("caption", vocab))
    decoded = rows.withColumn("decoded", encode.bpe_decode("ids", vocab))
    return decoded.select(
        "doc_id",
        F.md5(F.col("decoded").cast("binary")).alias("decoded_md5"),
        (F.col("decoded") == F.col("caption")).alias("same"),
    )


def vocab_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.vocab_usage(_corpus(spark, sf_dir), _vocab(spark, sf_dir))


def token_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.token_report(_token_rows(spark, sf_dir, _vocab(spark, sf_dir)), LENGTH)


def _length_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths as stand-in ids, so that the rest can be written in SQL too."""
    # Words beyond the length stay uncut, and are left out with the rest.
    words = F.slice(F.split("caption", " ", LENGTH + 1), 1, LENGTH)
    ids = F.transform(words, lambda w: F.char_length(w))
    rows = _corpus(spark, sf_dir).select("doc_id", pad_truncate(ids, LENGTH).alias("tokens"))
    return rows.withColumn("mask", attention_mask("tokens"))


def _joined(name: str):
    return F.array_join(F.transform(name, lambda x: x.cast("string")), " ").alias(name)


def pad_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _length_rows(spark, sf_dir).withColumn("tokens", check_length("tokens", LENGTH))
    return rows.select("doc_id", _joined("tokens"), _joined("mask"))


def dropout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    dropped = sampling.caption_dropout(_length_rows(spark, sf_dir), "doc_id", 0.1, SEED, epoch=2, length=LENGTH)
    return dropped.select("doc_id", _joined("tokens"), _joined("mask"))


def guidance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prompt with and without its text."""
    both = encode.with_null_rows(_length_rows(spark, sf_dir), "doc_id", LENGTH)
    return both.select("doc_id", "is_uncond", _joined("tokens"), _joined("mask"))


QUERIES = {
    f.__name__: f
    for f in (
        word_counts, char_coverage, bpe_pair_counts, bpe_train, bpe_encode, bpe_decode, vocab_usage, token_report,
        pad_mask, dropout_rows, guidance_rows,
    )
}

_CLEAN = f"""corpus AS (
  SELECT doc_id, caption FROM (SELECT doc_id, {clean_sql('text')} AS caption FROM documents) WHERE caption <> '')"""
_WORDS = """words AS (
  SELECT word, count(*) AS n FROM (SELECT unnest(string_split(caption, ' ')) AS word FROM corpus {where})
  WHERE word <> '' GROUP BY 1)"""
_CHARS = """chars AS (
  SELECT char, sum(n)::BIGINT AS n FROM (SELECT unnest(string_split(word, '')) AS char, n FROM words)
  WHERE char <> '' GROUP BY 1),
covered AS (
  SELECT char, n, coalesce(sum(n) OVER (ORDER BY n DESC, char ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         / sum(n) OVER () AS share_before FROM chars)"""
_IDS = f"""{_CLEAN}, rows AS (
  SELECT doc_id, list_resize(list_slice(list_transform(string_split(caption, ' '), lambda w: length(w)), 1, {LENGTH}),
         {LENGTH}, 0) AS tokens FROM corpus)"""
_TEXT = "array_to_string({0}, ' ') AS {1}"
_MASK = "list_transform({0}, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)"
_NULLS = f"list_resize([4], {LENGTH}, 0)"

# The vocabulary in SQL, one merge a step: the table of distinct words as spaced symbols, with a row of n = 0
# that lists the pieces made so far. ``made`` numbers the pieces, specials first, single characters last.
_LEARN = f"""{_CLEAN}, raw AS (
  SELECT word, count(*) AS n FROM (SELECT unnest(string_split(caption, ' ')) AS word FROM corpus)
  WHERE word <> '' GROUP BY 1),
words AS (SELECT '▁' || word AS word, n FROM raw), {_CHARS},
kept AS (SELECT char, n FROM covered WHERE share_before < 0.9995),
letters AS (
  SELECT word, n, i, c, c IN (SELECT char FROM kept) AS ok, regexp_matches(c, '\\p{{Latin}}') AS latin
  FROM (SELECT word, n, unnest(string_split(word, '')) AS c, generate_subscripts(string_split(word, ''), 1) AS i FROM words)),
borders AS (
  SELECT *, NOT ok OR NOT lag(ok, 1, false) OVER w OR lag(latin) OVER w <> latin AND lag(c) OVER w <> '▁' AS begins
  FROM letters WINDOW w AS (PARTITION BY word ORDER BY i)),
runs AS (
  SELECT word, run, any_value(n) AS n, ' ' || string_agg(c, '  ' ORDER BY i) || ' ' AS symbols
  FROM (SELECT *, sum(begins::INT) OVER (PARTITION BY word ORDER BY i) AS run FROM borders) WHERE ok GROUP BY word, run),
start AS (
  SELECT symbols, sum(n)::BIGINT AS n FROM runs WHERE contains(symbols, '  ') GROUP BY symbols
  UNION ALL SELECT chr(10), 0),
steps AS (
  SELECT 0 AS step, symbols, n FROM start
  UNION ALL
  SELECT * FROM (
    SELECT t.step + 1 AS step,
           CASE WHEN t.n = 0 THEN t.symbols || b.l || '  ' || b.r || chr(10)
                ELSE replace(t.symbols, ' ' || b.l || '  ' || b.r || ' ', ' ' || b.l || b.r || ' ') END AS symbols, t.n
    FROM steps t, (
      SELECT l, r FROM (
        SELECT s[i] AS l, s[i + 1] AS r, sum(n) AS n FROM (
          SELECT s, n, unnest(range(1, len(s))) AS i FROM (SELECT string_split(trim(symbols), '  ') AS s, n FROM steps WHERE n > 0))
        GROUP BY 1, 2)
      WHERE length(l) + length(r) <= 16
        AND l || r NOT IN (SELECT unnest(string_split(replace(symbols, '  ', ''), chr(10))) FROM steps WHERE n = 0)
      ORDER BY n DESC, length(l || r), l || r, l LIMIT 1) b
    WHERE t.step < {VOCAB_SIZE} - 5 - (SELECT count(*) FROM kept)) x
  WHERE n = 0 OR contains(symbols, '  ')),
merges AS (
  SELECT m, i FROM (
    SELECT unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (
      SELECT string_split(trim(symbols, chr(10)), chr(10)) AS ms FROM steps WHERE n = 0 ORDER BY step DESC LIMIT 1)) WHERE m <> ''),
listed AS (
  SELECT unnest([0, 1, 2, 3, 4]) AS id, unnest(['<pad>', '<s>', '</s>', '<unk>', '<null>']) AS piece
  UNION ALL SELECT 4 + i, replace(m, '  ', '') FROM merges
  UNION ALL SELECT 4 + (SELECT count(*) FROM merges) + row_number() OVER (ORDER BY n DESC, char), char FROM kept),
vocab AS (SELECT id::INT AS id, piece, least(0, 5 - id)::DOUBLE AS score FROM listed),
stamp AS (SELECT sha1(string_agg(piece || chr(9) || score::BIGINT || chr(10), '' ORDER BY id)) AS vocab_sha1 FROM vocab)"""
# A piece is made from any two neighbours that spell it, in the order of the pieces.
_ENCODE = f"""{_LEARN}, ways AS (
  SELECT list(w ORDER BY id, w) AS ws FROM (
    SELECT DISTINCT id, left(piece, k) || '  ' || substr(piece, k + 1) AS w
    FROM (SELECT id, piece, unnest(range(1, length(piece))) AS k FROM vocab WHERE id > 4 AND length(piece) > 1)
    WHERE left(piece, k) IN (SELECT piece FROM vocab WHERE id > 4) AND substr(piece, k + 1) IN (SELECT piece FROM vocab WHERE id > 4))),
folded AS (
  SELECT word, n, string_split(trim(list_reduce(
    list_prepend(' ' || array_to_string(string_split(word, ''), '  ') || ' ', ws),
    lambda acc, w: replace(acc, ' ' || w || ' ', ' ' || replace(w, '  ', '') || ' '))), '  ') AS parts
  FROM words, ways),
maps AS (SELECT map(list(piece), list(id)) AS id_of, map(list(id), list(piece)) AS piece_of FROM vocab WHERE id > 4),
numbered AS (SELECT word, n, list_transform(parts, lambda x: coalesce(id_of[x], 3)) AS ids FROM folded, maps),
coded AS (
  SELECT word, n, list_filter(ids, lambda x, i: x <> 3 OR i = 1 OR ids[i - 1] <> 3) AS ids FROM numbered),
doc_ids AS (
  SELECT doc_id, flatten(list(ids ORDER BY k)) AS ids FROM (
    SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM (
      SELECT doc_id, list_filter(string_split(caption, ' '), lambda w: w <> '') AS ws FROM corpus)) d
  JOIN coded ON coded.word = '▁' || d.word GROUP BY doc_id),
token_rows AS (SELECT doc_id, ids, list_resize(list_slice(ids, 1, {LENGTH}), {LENGTH}, 0) AS tokens FROM doc_ids)"""

ORACLES = {
    "word_counts": f"WITH {_CLEAN}, {_WORDS.format(where='')} SELECT word, n FROM words",
    "char_coverage": f"""WITH {_CLEAN}, {_WORDS.format(where='')}, {_CHARS}
SELECT char, n, round(share_before, 9) AS share_before, share_before < 0.9995 AS kept FROM covered""",
    "bpe_pair_counts": f"""WITH {_CLEAN}, raw AS (
  SELECT word, count(*) AS n FROM (
    SELECT unnest(string_split(caption, ' ')) AS word FROM corpus)
  WHERE word <> '' GROUP BY 1),
words AS (SELECT '▁' || word AS word, n FROM raw), {_CHARS},
kept AS (SELECT char FROM covered WHERE share_before < 0.9995),
spots AS (SELECT word, n, string_split(word, '') AS s FROM words),
pairs AS (
  SELECT s[i] AS l, s[i + 1] AS r, n FROM (SELECT s, n, unnest(range(1, len(s))) AS i FROM spots))
SELECT l AS left, r AS right, sum(n)::BIGINT AS n FROM pairs
WHERE l IN (SELECT char FROM kept) AND r IN (SELECT char FROM kept)
  AND (l = '▁' OR regexp_matches(l, '\\p{{Latin}}') = regexp_matches(r, '\\p{{Latin}}')) GROUP BY 1, 2""",
    "bpe_train": f"WITH RECURSIVE {_LEARN} SELECT id, piece, score FROM vocab",
    "vocab_files": f"WITH RECURSIVE {_LEARN} SELECT id, piece, score, vocab_sha1 FROM vocab, stamp",
    "bpe_encode": f"""WITH RECURSIVE {_ENCODE} SELECT doc_id, {_TEXT.format('tokens', 'tokens')},
  {_TEXT.format(_MASK.format('tokens'), 'mask')}, len(ids)::INT AS n_tokens, vocab_sha1 FROM token_rows, stamp""",
    "bpe_decode": f"""WITH RECURSIVE {_ENCODE}, texts AS (
  SELECT doc_id, regexp_replace(replace(array_to_string(list_transform(ids, lambda x: CASE WHEN x = 3 THEN ' ⁇ '
    ELSE piece_of[x] END), ''), '▁', ' '), '^ ', '') AS decoded FROM token_rows, maps)
SELECT doc_id, md5(decoded) AS decoded_md5, decoded = caption AS same FROM texts JOIN corpus USING (doc_id)""",
    "vocab_usage": f"""WITH RECURSIVE {_ENCODE}, used AS (
  SELECT id, sum(n)::BIGINT AS n FROM (SELECT unnest(ids) AS id, n FROM coded) GROUP BY 1)
SELECT id, piece, n, n / sum(n) OVER () AS share FROM used JOIN vocab USING (id)""",
    "token_report": f"""WITH RECURSIVE {_ENCODE}
SELECT count(*) AS rows, avg(len(ids)) AS mean_tokens, avg((len(ids) > {LENGTH})::INT) AS truncated_share,
       sum(len(list_filter(tokens, lambda x: x = 3))) / sum(least(len(ids), {LENGTH})) AS unknown_share FROM token_rows""",
    "pad_mask": f"""WITH {_IDS} SELECT doc_id, {_TEXT.format('tokens', 'tokens')},
  {_TEXT.format(_MASK.format('tokens'), 'mask')} FROM rows""",
    "dropout_rows": f"""WITH {_IDS}, dropped AS (
  SELECT doc_id, CASE WHEN {u32_sql(f"'{SEED}'", "'2'", 'doc_id')} / 4294967296.0 < 0.1 THEN {_NULLS} ELSE tokens END AS t
  FROM rows)
SELECT doc_id, {_TEXT.format('t', 'tokens')}, {_TEXT.format(_MASK.format('t'), 'mask')} FROM dropped""",
    "guidance_rows": f"""WITH {_IDS}, both_rows AS (
  SELECT doc_id, false AS is_uncond, tokens AS t FROM rows UNION ALL SELECT doc_id, true, {_NULLS} FROM rows)
SELECT doc_id, is_uncond, {_TEXT.format('t', 'tokens')}, {_TEXT.format(_MASK.format('t'), 'mask')} FROM both_rows""",
}
