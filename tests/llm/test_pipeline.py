"""The pipeline stage by stage against plain Python, each on what the stage before it kept."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from captionloom.llm import langid
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, docs, shared):
    """The rows that went into each stage and what came out."""
    out, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(shared / f"stage-{name}")
        stage(spark, at, SF_DIR).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (at, after)
        at = after
    return out


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_columns_stay(stages, docs):
    for name in list(stages)[:-1]:
        assert stages[name][1].columns == docs.columns
    assert {"shard", "slot"} <= set(stages["sharding"][1].columns)


def test_language_rejects_what_has_none(stages):
    before, after = stages["language"]
    lost = Counter(rows(before, "doc_id", "text")) - Counter(rows(after, "doc_id", "text"))
    assert not Counter(rows(after, "doc_id", "text")) - Counter(rows(before, "doc_id", "text"))
    blank = Counter(r for r in rows(before, "doc_id", "text") if not langid.has_letter(r[1]))
    assert blank and not blank - lost
    assert sum(lost.values()) <= sum(blank.values()) + 2


def test_nothing_to_learn_from_rejects_only_what_has_no_letter(docs):
    want = Counter(r for r in rows(docs, "doc_id", "text") if langid.has_letter(r[1]))
    unlabelled = langid.accepted(docs.withColumn("lang", F.lit(None).cast("string")))
    assert unlabelled.columns == docs.columns
    assert want and Counter(rows(unlabelled, "doc_id", "text")) == want
    nameless = langid.accepted(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted(t for (t,) in rows(nameless, "text")) == sorted(want_text for _, want_text in want.elements())


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    pairs = rows(before, "doc_id", "text")
    group = brute.simhash(pairs)
    want = {c for _, _, c in group}
    kept = Counter(rows(after, "doc_id", "text"))
    assert sum(kept.values()) == len(want)
    known = {(d, t): c for (d, t), (_, _, c) in zip(pairs, group)}
    assert {known[k] for k in kept} == want
    assert {d for d, _ in kept if d is not None} <= want | {d for (d, t), c in known.items() if c is None}


def test_contaminated_documents_go(spark, stages):
    before, after = stages["benchmark"]
    items = rows(spark.read.parquet(f"{SF_DIR}/benchmark.parquet"), "item_id", "text")
    pairs = rows(before, "doc_id", "text")
    clean = Counter(p for p, r in zip(pairs, brute.decontaminate(pairs, items)) if not r[-1])
    assert Counter(rows(after, "doc_id", "text")) == clean and sum(clean.values()) < len(pairs)


def test_passages_without_an_id_count(spark, tmp_path):
    passage = " ".join(f"word{i}" for i in range(12))
    spark.createDataFrame([(None, passage), (1, "another passage")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, f"so {passage} it goes"), (2, "clean")], "doc_id long, text string")
    assert rows(corpus_pipeline.clean_of_benchmark(spark, docs, str(tmp_path)), "doc_id") == [(2,)]


def test_mixing_takes_whole_copies(stages):
    before, after = stages["mixing"]
    there, taken = Counter(rows(before, "doc_id", "text", "source")), Counter(rows(after, "doc_id", "text", "source"))
    assert all(taken[k] <= 2 * there[k] for k in taken)
    words = lambda c: sum(len((t or "").split()) * n for (_, t, _), n in c.items())
    longest = max(len((t or "").split()) for _, t, _ in there)
    assert abs(words(taken) - 1.5 * words(there)) <= longest * len({s for _, _, s in there})


def test_shards_hold_all(stages):
    before, after = stages["sharding"]
    assert Counter(rows(before, "doc_id", "text")) == Counter(rows(after, "doc_id", "text"))
    per = after.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("d")).collect()
    assert all(r["n"] == r["last"] + 1 == r["d"] for r in per)
    homes = after.groupBy("text").agg(F.countDistinct("shard").alias("n")).filter("n > 1")
    assert homes.isEmpty()


def test_empty_documents(spark, no_docs, shared):
    at = no_docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(shared / f"empty-{name}")
        stage(spark, at, SF_DIR).write.parquet(path)
        at = spark.read.parquet(path)
        assert at.count() == 0
