"""Phrase collocations of each language, found by Toivonen's mining.

A sample of the documents proposes phrases. A full pass then counts exactly all words, and every phrase whose two
parts (all but its last word, all but its first) are proposed: the proposals and their negative border. Where the pass
finds a frequent phrase of the border that was not proposed, longer phrases that contain it were not counted; further passes
count those, and only those, until nothing new is found. The sample only decides how many passes there are, never
the result: no phrase is frequent unless its parts are.

A task counts its documents in numbers: a known word has a number, a phrase the key ``number of all but its last word << 32 |
number of its last word``. It hands on counts in buckets of keys, a row a bucket, and buckets are added up in groups.

A text is cut into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs, with A-Z lowered. Counts are
occurrences, overlaps included, per language; a null language is ``und``, a null text is empty. A table without words
gives an empty result; columns beyond ``text`` and ``lang`` are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from captionloom.llm.common import arrow_rows
from captionloom.session import materialize

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2000
#: Documents that the sample holds on average, and its threshold: this part of what is expected there, two at least.
SAMPLE_ROWS = 20_000
SAMPLE_PART, SAMPLE_COUNT = 0.75, 2
#: Words and longer phrases that are sent to the tasks. Where more are frequent, all phrases are counted, whatever their parts.
MOST_WORDS, MOST_KEYS = 1_000_000, 8_000_000
#: Counts that a task holds before it hands them on; buckets for each input partition.
HELD = 4_000_000
BUCKETS = 4
#: Parts of a language's phrases that are ranked by themselves first.
RANK_PARTS = 64
#: A-Z lowered, tabs as spaces, what ends a piece as a line end.
BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else b for b in range(256))
END = b"\n"
LAST = 2**32 - 1


def tokens(texts: Iterable[bytes]) -> list[bytes]:
    """Words of the texts in order, with ``END`` where a piece ends."""
    data = END.join(texts).translate(BYTES).replace(END, b" \n ")
    return [w for w in data.split(b" ") if w]


@dataclass
class Level:
    """Phrases of one length by number. Numbers below ``old`` were known to an earlier pass."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    live: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    old: int = 0

    def found(self, keys: np.ndarray, first: bool) -> bool:
        """Takes the frequent keys of a pass; whether any was not known. The first pass counts what is known as well."""
        self.old = len(self.keys)
        fresh = np.setdiff1d(keys, self.keys)
        if first:
            self.live = np.isin(self.keys, keys)
        self.keys = np.concatenate([self.keys, fresh])
        self.live = np.concatenate([self.live, np.ones(len(fresh), bool)])
        return len(fresh) > 0


@dataclass
class Known:
    """The phrases of one language that longer ones may be made of."""

    words: dict[bytes, int] = field(default_factory=dict)
    #: Numbers of words that turned out to be rare; numbers below ``old`` were known to an earlier pass.
    rare: set[int] = field(default_factory=set)
    old: int = 0
    levels: list[Level] = field(default_factory=list)

    def found(self, words: list[bytes] | None, keys: list[np.ndarray], max_words: int) -> bool:
        """Takes what a pass found to be frequent; whether longer phrases may have been missed. ``words`` come with the first pass."""
        self.old = len(self.words)
        if words is not None:
            frequent = set(words)
            self.rare = {i for w, i in self.words.items() if w not in frequent}
            for w in words:
                self.words.setdefault(w, len(self.words))
        self.levels += [Level() for _ in range(len(keys) - len(self.levels))]
        fresh = [level.found(k, words is not None) for level, k in zip(self.levels, keys)]
        return any(fresh[: max_words - 2]) or len(self.words) > self.old

    def proposed(self) -> None:
        """Nothing of it has been counted yet."""
        self.old = 0
        for level in self.levels:
            level.old = 0

    def counter(self, max_words: int):
        """A function from the words of a text to the keys, for each length from 2, of the phrases to count."""
        words = {w: i for w, i in self.words.items() if i not in self.rare}
        tables = []
        for level in self.levels[: max_words - 2]:
            numbers = np.flatnonzero(level.live)
            order = np.argsort(level.keys[numbers], kind="stable")
            tables.append((level.keys[numbers][order], numbers[order], level.old))

        def keys_of(listed: list[bytes]) -> Iterator[np.ndarray]:
            last = np.fromiter(map(words.get, listed, repeat(-1)), np.int64, len(listed))
            ids, old = last, self.old
            for size in range(2, max_words + 1):
                if len(ids) < 2:
                    return
                a, b = ids[:-1], ids[1:]
                at = np.flatnonzero((a >= 0) & (b >= 0))
                keys = (a[at] << 32) | last[size - 1 :][at]
                # Where both parts were known before, the phrase has been counted.
                yield keys[(a[at] >= old) | (b[at] >= old)]
                if size - 2 >= len(tables):
                    return
                sorted_, numbers, old = tables[size - 2]
                ids = np.full(len(a), -1, np.int64)
                if len(sorted_):
                    spot = np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)
                    same = sorted_[spot] == keys
                    ids[at[same]] = numbers[spot[same]]

        return keys_of


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
        texts.setdefault(lang, []).append(text)
    return iter(texts.items())


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of their counts."""
    keys, f = (np.concatenate(x) for x in zip(*parts))
    if not len(keys):
        return keys, f
    order = np.argsort(keys, kind="stable")
    keys, f = keys[order], f[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(f, first)


class _Counts:
    """Counts of one task. New ones are added to the rest when they are as many; handed on before they grow too many."""

    def __init__(self, buckets: int):
        self.buckets, self.words, self.keys, self.new, self.held = buckets, {}, {}, 0, 0

    def add(self, lang: str, size: int, keys: np.ndarray) -> None:
        if len(keys):
            self.keys.setdefault((lang, size), []).append(np.unique(keys, return_counts=True))
            self.new += len(self.keys[lang, size][-1][0])
        if self.new > max(HELD // 4, self.held):
            self.keys = {at: [_summed(parts)] for at, parts in self.keys.items()}
            self.new, self.held = 0, sum(len(parts[0][0]) for parts in self.keys.values())

    def full(self) -> bool:
        return self.held > HELD or sum(map(len, self.words.values())) > HELD // 4

    def told(self) -> Iterator[pa.RecordBatch]:
        for lang, counted in self.words.items():
            counted.pop(END, None)
            words = sorted(counted, key=lambda w: zlib.crc32(w) % self.buckets)
            bucket = np.array([zlib.crc32(w) % self.buckets for w in words], np.int64)
            f = np.array([counted[w] for w in words], np.int64)
            yield from self._rows(lang, 1, bucket, pa.array(words, pa.binary()).cast(pa.string()), None, f)
        for (lang, size), parts in self.keys.items():
            keys, f = _summed(parts)
            # Some bits of a product, so that neighbours are spread.
            bucket = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % self.buckets
            order = np.argsort(bucket, kind="stable")
            yield from self._rows(lang, size, bucket[order], None, keys[order], f[order])
        self.__init__(self.buckets)

    def _rows(self, lang: str, size: int, bucket: np.ndarray, words, keys, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(f):
            return
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        n, ends = len(first), pa.array(np.append(first, len(f)).astype(np.int32))
        texts, numbers = pa.list_(pa.string()), pa.list_(pa.int64())
        columns = [
            pa.array([lang] * n, pa.string()),
            pa.array([size] * n, pa.int32()),
            pa.array(bucket[first]),
            pa.nulls(n, texts) if words is None else pa.ListArray.from_arrays(ends, words),
            pa.nulls(n, numbers) if keys is None else pa.ListArray.from_arrays(ends, pa.array(keys)),
            pa.ListArray.from_arrays(ends, pa.array(f)),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "size", "bucket", "words", "keys", "f"])


def count_known(texts: DataFrame, known: dict[str, Known], words: bool, least: int, max_words: int) -> DataFrame:
    """``lang, size, word, key, f`` of what one pass finds ``least`` times or more: words if asked for, and phrases whose
    parts are known. Rows of size 0 have the number of all words."""
    sent = texts.sparkSession.sparkContext.broadcast(known)
    buckets = max(16, BUCKETS * texts.rdd.getNumPartitions())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, counters = _Counts(buckets), {}
        for batch in batches:
            for lang, rows in _by_lang(batch):
                listed = tokens(rows)
                if words:
                    counts.words.setdefault(lang, Counter()).update(listed)
                if lang in sent.value:
                    if lang not in counters:
                        counters[lang] = sent.value[lang].counter(max_words)
                    for size, keys in enumerate(counters[lang](listed), 2):
                        counts.add(lang, size, keys)
            if counts.full():
                yield from counts.told()
        yield from counts.told()

    def total(group: pa.Table) -> pa.Table:
        lang, size, f = group["lang"][0].as_py(), group["size"][0].as_py(), group["f"].combine_chunks()
        if size == 1:
            sums: Counter = Counter()
            for word, n in zip(group["words"].combine_chunks().flatten().to_pylist(), f.flatten().to_pylist()):
                sums[word] += n
            rows = [(1, w, None, n) for w, n in sums.items() if n >= least] + [(0, None, None, sum(sums.values()))]
            columns = [list(c) for c in zip(*rows)]
        else:
            keys, n = _summed([(group["keys"].combine_chunks().flatten().to_numpy(), f.flatten().to_numpy())])
            keys, n = keys[n >= least], n[n >= least]
            columns = [[size] * len(keys), pa.nulls(len(keys), pa.string()), keys, n]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
        arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)]
        return pa.table([pa.array([lang] * len(arrays[0]), pa.string()), *arrays], ["lang", "size", "word", "key", "f"])

    told = texts.mapInArrow(count, "lang string, size int, bucket long, words array<string>, keys array<long>, f array<long>")
    return told.groupBy("lang", "size", "bucket").applyInArrow(total, "lang string, size int, word string, key long, f long")


def spelt(counted: DataFrame, known: dict[str, Known]) -> DataFrame:
    """``lang, phrase, size, f`` of counted words and keys."""
    names = {lang: (list(k.words), [level.keys for level in k.levels]) for lang, k in known.items()}
    sent = counted.sparkSession.sparkContext.broadcast(names)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases = []
            for lang, size, word, key in zip(*[batch[c].to_pylist() for c in ("lang", "size", "word", "key")]):
                if size > 1:
                    words, levels = sent.value[lang]
                    parts = [words[key & LAST]]
                    for level in range(size - 3, -1, -1):
                        key = int(levels[level][key >> 32])
                        parts.append(words[key & LAST])
                    parts.append(words[key >> 32])
                    word = b" ".join(reversed(parts)).decode()
                phrases.append(word)
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(phrases, pa.string()), batch["size"], batch["f"]], ["lang", "phrase", "size", "f"])

    return counted.select("lang", "size", "word", "key", "f").mapInArrow(spell, "lang string, phrase string, size int, f long")


def count_all(texts: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """``lang, phrase, size, f`` of all phrases of up to ``max_words`` words, whatever their parts, as plain rows."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pieces = texts.select("lang", F.explode(F.split(lowered, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    words = pieces.select("lang", F.regexp_extract_all("piece", F.lit(r"[^\x20\x09]+"), F.lit(0)).alias("words"))
    spots = words.select("lang", "words", F.posexplode("words").alias("at", "word"))
    sized = spots.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(max_words), F.size("words") - F.col("at")))).alias("size"))
    phrase = F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " ").alias("phrase")
    return sized.select("lang", phrase, "size").groupBy("lang", "phrase", "size").agg(F.count("*").alias("f"))


def _taken(known: dict[str, Known], counted: DataFrame, first: bool, longest: int, max_words: int) -> bool | None:
    """Adds what a pass found, up to ``longest`` words, to ``known``; whether longer phrases may have been missed.

    None if there are too many to send.
    """
    parts = counted.filter(F.col("size").between(1, longest))
    n_words, n_keys = parts.agg(*[F.count(F.when(c, 1)) for c in (F.col("size") == 1, F.col("size") > 1)]).first()
    held = sum(len(level.keys) for k in known.values() for level in k.levels)
    if n_words > MOST_WORDS or n_keys + held > MOST_KEYS:
        return None
    words: dict[str, list[bytes]] = {}
    if first:
        table = parts.filter("size = 1").select("lang", "word").toArrow()
        # In the order of the words, so that every run numbers them alike.
        for lang, word in sorted(zip(table["lang"].to_pylist(), table["word"].cast(pa.binary()).to_pylist())):
            words.setdefault(lang, []).append(word)
        for lang in set(known) - set(words):
            del known[lang]
    missed = False
    for lang in words if first else known:
        keys = []
        for size in range(2, longest + 1):
            table = parts.filter((F.col("lang") == lang) & (F.col("size") == size)).select("key").toArrow()
            keys.append(table["key"].to_numpy())
        missed |= known.setdefault(lang, Known()).found(words.get(lang), keys, max_words)
    return missed


def close(texts: DataFrame, least: int, longest: int, max_words: int, known: dict[str, Known]) -> tuple[list[DataFrame], bool]:
    """Counts phrases of up to ``max_words`` until none can have been missed: the tables counted, and whether all that were
    needed could be sent.

    ``known`` are proposals to begin with, and takes up the phrases of up to ``longest`` words. Without any, each pass adds a length.
    """
    passes: list[DataFrame] = []
    while True:
        first = not passes
        passes.append(materialize(count_known(texts, known, first, least, max_words), "counted"))
        missed = _taken(known, passes[-1], first, longest, max_words)
        if not missed:
            return passes, missed is not None


def frequent_phrases(
    docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, sample_rows: int = SAMPLE_ROWS, seed: int = 13
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, f`` of the phrases of up to ``max_words`` words with ``min_count`` occurrences or more, and ``lang, n``, all written."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    share = min(1.0, sample_rows / max(1, docs.count()))
    known: dict[str, Known] = {}
    with arrow_rows(docs.sparkSession):
        if share < 1:
            least = max(SAMPLE_COUNT, int(min_count * share * SAMPLE_PART))
            _, sent = close(texts.sample(share, seed), least, max_words - 1, max_words - 1, known)
            known = known if sent else {}
            for k in known.values():
                k.proposed()
        passes, sent = close(texts, min_count, max_words - 1, max_words, known)
        totals = materialize(passes[0].filter("size = 0").groupBy("lang").agg(F.sum("f").alias("n")), "totals")
        if not sent:
            return materialize(count_all(texts, max_words).filter(F.col("f") >= min_count), "found"), totals
        found = passes[0].filter("size > 0")
        for more in passes[1:]:
            found = found.unionByName(more)
        return materialize(spelt(found, known), "found"), totals


def score_cuts(found: DataFrame) -> DataFrame:
    """``lang, phrase, size, a, l, r, score`` of the phrases of two words and more, cut where they score least.

    Products are decimals of 38 digits, so they are exact up to counts of 10^15.
    """
    longer = found.filter("size > 1").withColumnRenamed("f", "a")
    words = F.split("phrase", " ")
    cuts = longer.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "size", "a", "k",
        F.array_join(F.slice(words, 1, F.col("k")), " ").alias("first"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " ").alias("rest"),
    )
    part = lambda name, f: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("over", exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)"))
    cuts = cuts.withColumn("under", exact("l") * exact("r"))
    least = F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("least")
    scored = cuts.groupBy("lang", "phrase", "size", "a").agg(least)
    return scored.select("lang", "phrase", "size", "a", "least.l", "least.r", F.col("least.score").cast("long").alias("score"))


def maximal(scored: DataFrame, percent: int = 50, max_words: int = MAX_WORDS) -> DataFrame:
    """Leaves out phrases that stand in a longer candidate which occurs at least ``percent`` percent as often."""
    words = F.split("phrase", " ")
    spans = [(start, size) for size in range(2, max_words) for start in range(1, max_words - size + 2)]
    if not spans:
        return scored
    inside = F.array(*[F.when(F.col("size") >= start + size - 1, F.when(F.col("size") > size, F.array_join(F.slice(words, start, size), " "))) for start, size in spans])
    parts = scored.select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), "a").filter(F.col("phrase").isNotNull())
    longest = materialize(parts.groupBy("lang", "phrase").agg(F.max("a").alias("within")), "within")
    kept = F.coalesce(100 * F.col("within") < percent * F.col("a"), F.lit(True))
    return scored.join(longest, ["lang", "phrase"], "left").filter(kept).drop("within")


def collocations(
    docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language by score, then count, then bytes."""
    found, totals = frequent_phrases(docs, min_count, max_words, sample_rows)
    left = maximal(materialize(score_cuts(found), "scored"), max_words=max_words)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # A language may have most phrases: its parts are ranked first, and their first ones together.
    parts = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    first = parts.withColumn("place", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).filter(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    number = lambda c: F.col(c).cast("long").alias(c)
    return ranked.join(totals, "lang").select("lang", number("rank"), "phrase", *[number(c) for c in ("a", "l", "r", "n", "score")])


def report(docs: DataFrame) -> DataFrame:
    return collocations(docs)
