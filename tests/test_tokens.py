"""Vocabulary and encoding against the public sentencepiece library on the same text."""

import random
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece as spm
from pyspark.sql import functions as F

from captionloom.functions.text import clean_caption
from captionloom.functions.tokens import attention_mask, check_length, null_tokens, pad_truncate
from captionloom.operators import bpe, encode, lexicon
from captionloom.plans import tokens as token_plans


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs.select("doc_id", clean_caption("text").alias("caption")).filter("caption <> ''").repartition(6)


@pytest.fixture(scope="module")
def lines(corpus):
    return [r.caption for r in corpus.orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def twin(lines, tmp_path_factory):
    folder = tmp_path_factory.mktemp("spm")
    (folder / "corpus.txt").write_text("\n".join(lines) + "\n")
    spm.SentencePieceTrainer.train(
        input=str(folder / "corpus.txt"), model_prefix=str(folder / "m"), vocab_size=200, model_type="bpe",
        bos_id=1, eos_id=2, pad_id=0, unk_id=3, user_defined_symbols="<null>", minloglevel=2,
        max_sentence_length=1_000_000,
    )
    return spm.SentencePieceProcessor(str(folder / "m.model"))


def pieces_of(twin):
    return [(i, twin.id_to_piece(i), twin.get_score(i)) for i in range(twin.get_piece_size())]


@pytest.fixture(scope="module")
def vocab(spark, twin):
    return spark.createDataFrame(pieces_of(twin), "id int, piece string, score double")


def test_training_finds_the_same_vocabulary(corpus, twin):
    learnt = bpe.bpe_train(lexicon.training_words(corpus), 200)
    assert [tuple(r) for r in learnt.orderBy("id").collect()] == pieces_of(twin)


def test_training_finds_the_same_2000_pieces(corpus, lines, tmp_path):
    (tmp_path / "corpus.txt").write_text("\n".join(lines) + "\n")
    spm.SentencePieceTrainer.train(
        input=str(tmp_path / "corpus.txt"), model_prefix=str(tmp_path / "m"), vocab_size=2000, model_type="bpe",
        bos_id=1, eos_id=2, pad_id=0, unk_id=3, user_defined_symbols="<null>", minloglevel=2, max_sentence_length=1_000_000,
    )
    learnt = bpe.bpe_train(lexicon.training_words(corpus), 2000)
    assert [tuple(r) for r in learnt.orderBy("id").collect()] == pieces_of(spm.SentencePieceProcessor(str(tmp_path / "m.model")))


def plain_training(words, size, max_chars=16):
    """Merging the best pair of all, one at a time, over whole words of one script."""
    chars = Counter()
    for w, n in words.items():
        chars.update({c: n * w.count(c) for c in set(w)})
    alphabet = [c for c, _ in sorted(chars.items(), key=lambda x: (-x[1], x[0]))]
    runs, known, pieces = [(list(w), n) for w, n in words.items()], set(alphabet), []
    while len(pieces) < size - 5 - len(alphabet):
        ranked = [(-n, len(a + b), a + b, a, b) for (a, b), n in _pairs(runs).items() if len(a + b) <= max_chars and a + b not in known]
        if not ranked:
            break
        _, _, piece, a, b = min(ranked)
        runs = [(_merged(r, a, b, piece), n) for r, n in runs]
        known.add(piece)
        pieces.append(piece)
    return pieces


@pytest.mark.parametrize("held,head,per_write", [(20_000, 20_000, 256), (40, 15, 7), (300, 0, 40)])
def test_training_merges_one_by_one(spark, monkeypatch, held, head, per_write):
    for name, value in (("HELD_PAIRS", held), ("HEAD_RUNS", head), ("MERGES_PER_WRITE", per_write)):
        monkeypatch.setattr(bpe, name, value)
    monkeypatch.setattr(bpe.frequent_pairs, "__defaults__", (held,))
    rng = random.Random(8)
    syllables = ["ba", "ban", "na", "aa", "aaa", "s", "ss", "on", "tion", "x"]
    words = Counter("▁" + "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 7))) for _ in range(900))
    rows = spark.createDataFrame(list(words.items()), "word string, n bigint")
    want = plain_training(words, 260)
    got = [r.piece for r in bpe.bpe_train(rows, 260, coverage=1.0).orderBy("id").collect()]
    assert got[5 : 5 + len(want)] == want


def test_training_over_a_large_alphabet(spark):
    rng = random.Random(4)
    words = Counter("▁" + "".join(chr(0x4E00 + int(400 * rng.random() ** 3)) for _ in range(rng.randrange(1, 6))) for _ in range(2500))
    rows = spark.createDataFrame(list(words.items()), "word string, n bigint")
    want = plain_training(words, 700)
    got = [r.piece for r in bpe.bpe_train(rows, 700, coverage=1.0).orderBy("id").collect()]
    assert len(want) > 200 and got[5 : 5 + len(want)] == want


def test_encoding_and_decoding(spark, corpus, vocab, lines, twin):
    extra = [
        "<null>", "a <null> b", "x<null>y", "日本 text 日", "Ünïcode ﬁ ™ ①", "", "  spaced   out ", "a\tb", "zzzzzzzzzzzz" * 40,
        "UPPER Case", "q̈w̄", "٣ ३ 3",
    ]
    texts = lines + extra
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(5)
    coded = rows.withColumn("ids", encode.bpe_encode("t", vocab)).withColumn("back", encode.bpe_decode("ids", vocab))
    for r in coded.orderBy("i").collect():
        assert r.ids == twin.encode(texts[r.i].lower()), texts[r.i][:80]
        assert r.back == twin.decode(r.ids), texts[r.i][:80]


def test_token_rows_are_padded_and_cut(corpus, vocab, lines, twin):
    rows = encode.token_rows(corpus, vocab).orderBy("doc_id").collect()
    for r, line in zip(rows, lines):
        ids = twin.encode(line)
        assert r.tokens == (ids + [0] * 77)[:77] and r.n_tokens == len(ids)
        assert r["mask"] == [int(t != 0) for t in r.tokens]


def test_usage_is_the_sum_of_encodings(corpus, vocab, lines, twin):
    want: dict = {}
    for line in lines:
        for i in twin.encode(line):
            want[i] = want.get(i, 0) + 1
    rows = encode.vocab_usage(corpus, vocab).collect()
    assert {r.id: r.n for r in rows} == want
    assert sum(r.share for r in rows) == pytest.approx(1)


def test_report(corpus, vocab, lines, twin):
    report = encode.token_report(encode.token_rows(corpus, vocab)).first()
    lengths = [len(twin.encode(x)) for x in lines]
    assert report.rows == len(lines) and report.mean_tokens == pytest.approx(sum(lengths) / len(lines))
    assert report.truncated_share == pytest.approx(sum(n > 77 for n in lengths) / len(lines))


def test_fixed_rows(spark):
    row = spark.range(1).select(
        pad_truncate(F.array(F.lit(7), F.lit(8)), 4).alias("short"),
        pad_truncate(F.array(*[F.lit(i) for i in range(1, 6)]), 4).alias("long"),
        pad_truncate(F.array().cast("array<int>"), 4).alias("none"),
        null_tokens(4).alias("null"),
    )
    row = row.withColumns({f"m_{c}": attention_mask(c) for c in row.columns}).first()
    assert (row.short, row.long, row.none, row["null"]) == ([7, 8, 0, 0], [1, 2, 3, 4], [0] * 4, [4, 0, 0, 0])
    assert (row.m_short, row.m_none, row.m_null) == ([1, 1, 0, 0], [0] * 4, [1, 0, 0, 0])


def test_check_length_fails_long_rows(spark):
    rows = spark.range(1).select(F.array(F.lit(1), F.lit(2), F.lit(3)).alias("t"))
    assert rows.select(check_length("t", 3)).first()[0] == [1, 2, 3]
    with pytest.raises(Exception, match="exceeds context length"):
        rows.select(check_length("t", 2)).collect()


def test_null_rows(spark):
    rows = spark.createDataFrame([("a", [7, 0], [1, 0])], "key string, tokens array<int>, mask array<int>")
    got = sorted((r.is_uncond, r.tokens, r["mask"]) for r in encode.with_null_rows(rows, length=2).collect())
    assert got == [(False, [7, 0], [1, 0]), (True, [4, 0], [1, 0])]


def test_pairs_count_every_position(spark):
    table = spark.createDataFrame([(" a  a  a ", 2), (" a  b  a  b ", 3)], "symbols string, n bigint")
    got = {(r.left, r.right): r.n for r in bpe.pair_counts(table).collect()}
    assert got == {("a", "a"): 4, ("a", "b"): 6, ("b", "a"): 3}


def _changes(before, after):
    a, b = _pairs(before), _pairs(after)
    return {k: b[k] - a[k] for k in {*a, *b} if a[k] != b[k]}


def _pairs(runs):
    found = Counter()
    for run, w in runs:
        for k in zip(run, run[1:]):
            found[k] += w
    return found


def _merged(run, a, b, made):
    out, i = [], 0
    while i < len(run):
        if run[i : i + 2] == [a, b]:
            out.append(made)
            i += 2
        else:
            out.append(run[i])
            i += 1
    return out


def test_merging_is_left_to_right():
    rng = random.Random(2)
    for a, b in ((1, 2), (1, 1), (3, 2)):
        runs = [([rng.randrange(1, 4) for _ in range(rng.randrange(2, 9))], rng.randrange(1, 5)) for _ in range(60)]
        runs += [([1] * k, 1) for k in range(2, 8)]
        flat, weight = bpe.flatten(pa.array([r for r, _ in runs], pa.list_(pa.int32())), pa.array([w for _, w in runs]))
        want = [(_merged(r, a, b, 9), w) for r, w in runs]
        for f, w in ((flat, weight), bpe.touched(flat, weight, [(a, b, 9)])):
            keys, n = bpe.Runs(f, w).merge((a, b, 9))
            assert {(int(k) >> 32, int(k) & bpe.LAST): int(c) for k, c in zip(keys, n)} == _changes(runs, want)
        merged = bpe.Runs(flat, weight)
        merged.merge((a, b, 9))
        after, left = merged.flat()
        assert [int(x) for x in after] == [0, *[x for r, _ in want for x in [*r, 0]]]
        assert [int(x) for x in left] == [0, *[x for r, w in want for x in [*[w] * len(r), 0]]]


def test_vocabulary_smaller_than_alphabet(spark):
    words = spark.createDataFrame([("▁abc", 1)], "word string, n bigint")
    with pytest.raises(ValueError):
        bpe.bpe_train(words, 7)


def test_training_stops_when_nothing_is_left(spark):
    words = spark.createDataFrame([("▁ab", 5)], "word string, n bigint")
    rows = [r.piece for r in bpe.bpe_train(words, 100).orderBy("id").collect()]
    assert rows == ["<pad>", "<s>", "</s>", "<unk>", "<null>", "ab", "▁ab", "a", "b", "▁"]


def test_prompts_with_and_without_text_are_made_in_one_pass(spark, tmp_path):
    spark.createDataFrame([(1, "A  <b>cat</b>"), (2, None), (3, " &nbsp; ")], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = token_plans.guidance_rows(spark, str(tmp_path))
    got = {(r.doc_id, r.is_uncond): r.tokens.split(" ")[:3] for r in made.collect()}
    assert got == {(1, False): ["1", "3", "0"], (1, True): ["4", "0", "0"]}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    # One scan, and cleaning (two patterns) for the result alone, not for a test on it too.
    assert plan.count("Relation [") == 1 and plan.count("regexp_replace(") == 2


def test_stretches_are_cut_where_no_merge_can_span_and_added_up(spark):
    rows = [([1, 2, 3, 4], 5), ([1, 2, 4, 3], 7), ([3, 4], 2), ([2, 1], 9)]
    runs = spark.createDataFrame(rows, "symbols array<int>, n long").repartition(3)
    alive = [a << 32 | b for a, b in ((1, 2), (3, 4))]
    got = bpe.apply_merges(runs, [], bpe.np.array(sorted(alive)))
    assert sorted((tuple(r.symbols), r.n) for r in got.collect()) == [((1, 2), 12), ((3, 4), 7)]


def test_a_task_holds_a_bounded_part_of_its_stretches(spark, monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array([[1, 2, 3]] * 10, pa.list_(pa.int32())), pa.array([1] * 10)], ["symbols", "n"])
    monkeypatch.setattr(bpe, "CHUNK_SYMBOLS", 60)
    sizes = [(flat > 0).sum() for flat, _ in bpe._chunks(iter([batch] * 7))]
    assert sizes == [60, 60, 60, 30]


def test_ids_of_long_batches_are_made_in_parts(spark, monkeypatch):
    vocab = spark.createDataFrame([(i, p, float(min(0, 5 - i))) for i, p in enumerate([*"01234", "▁a", "▁", "a", "b"])], "id int, piece string, score double")
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "ab " * 50), (5, "x")], "k int, t string").coalesce(1)
    monkeypatch.setattr(encode, "_PART_CHARS", 3)
    coded = {r.k: r.ids for r in rows.select("k", encode.bpe_encode("t", vocab).alias("ids")).collect()}
    assert coded == {1: [5, 6, 8], 2: [], 3: [], 4: [5, 8] * 50, 5: [6, 3]}
