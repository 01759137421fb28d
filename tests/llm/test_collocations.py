"""Phrase mining against counting everything."""

import random
import re
from collections import Counter, defaultdict

import pytest

from captionloom.llm import collocations as co
from tests.llm.brute import lower_az
from tests.llm.test_operators import check

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, top=2000, least=10, most=3):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower_az(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, most + 1):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            inside = (
                b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            )
            if any(100 * b >= 50 * a for b in inside):
                continue
            cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top]):
            out.append((lang, rank + 1, phrase.decode(), -a, l, r, total[lang], -score))
    return out


def small_rows(n=400):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "Ünder", "\x1c", "a\u00a0b"]
    fixed = ["new york city", "of the", "ad hoc committee", "É A", "in order to"]
    rows = []
    for i in range(n):
        words = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randrange(1, 30))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for w in words)
        rows.append((text, rng.choice(["en", "en", "de", None, "und"])))
    rows += [(None, "en"), ("", "en"), ("...", "fr"), ("A a a a a a a a a a a a A", "xx"), ("one " * 20_000, "yy")]
    rows += [("the very same text of many copies, again and again", "en")] * 200
    return rows


@pytest.mark.parametrize("sample_rows", [20_000, 150, 1])
def test_collocations(spark, sample_rows):
    rows = small_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, n long, phrase string").repartition(6)
    check(co.collocations(docs, sample_rows=sample_rows), COLUMNS, brute(rows))


def test_limits_and_longer_phrases(spark):
    rows = small_rows(150)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    check(co.collocations(docs, top=7, min_count=4, max_words=4, sample_rows=60), COLUMNS, brute(rows, 7, 4, 4))


def test_more_phrases_than_are_sent(spark, monkeypatch):
    rows = small_rows(200)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    for words, keys in ((5, 60), (60, 60), (1000, 5)):
        monkeypatch.setattr(co, "MOST_WORDS", words)
        monkeypatch.setattr(co, "MOST_KEYS", keys)
        check(co.collocations(docs, sample_rows=50), COLUMNS, brute(rows))


def test_counts_that_are_handed_on_early(spark, monkeypatch):
    monkeypatch.setattr(co, "HELD", 20)
    rows = small_rows(200)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    check(co.collocations(docs, sample_rows=30), COLUMNS, brute(rows))


def test_products_beyond_64_bits(spark):
    found = [("en", "a", 1, 5 * 10**13), ("en", "b", 1, 4 * 10**13), ("en", "a b", 2, 3 * 10**13)]
    got = co.score_cuts(spark.createDataFrame(found, "lang string, phrase string, size int, f long")).first()
    assert got["score"] == 10**6 * 9 * 10**26 // (20 * 10**26)


def test_no_documents(spark):
    assert co.report(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert co.report(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0
