"""Learning a byte-pair vocabulary over the distinct-word table.

The corpus is read once, to count words. Stretches in which merges can happen become arrays of symbol numbers, dealt to
partitions. From then on nothing is counted anew: a task applies merges to the stretches that hold one of the pairs, and
tells by how much the counts of the pairs beside them change, step by step.

A round guesses the next merges, lets all tasks apply them in order, and goes through the summed changes: as long as the most
frequent pair by the exact counts is a guessed one, its merge stands. It may have been guessed for later, if nothing it
touches was touched by the guesses passed over. At the first pair that was not guessed the rest of the round is thrown away; the first
guess of a round is always right. Guesses come from merging a bounded number of stretches, the most frequent and a share of the rest, on the driver; they
decide how many merges a round yields, not which.

The driver holds the counts of the pairs from a threshold on. A merge can only take from pairs that are there, and makes pairs of
the new symbol, whose counts never grow later; so a pair below the threshold stays below it, and counts are only taken
again, with a lower threshold, when the held ones are used up. For the same reason a stretch is cut between two symbols whose
pair is below the threshold, when it is written anew: no merge will span the place. Equal parts are added up, and rare
words soon leave. The uncut stretches are kept for a lower threshold.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionloom.functions.tokens import SPECIAL_PIECES
from captionloom.operators.lexicon import COVERAGE, WORD_START, char_coverage
from captionloom.session import drop_path, fresh_dir, materialize

# Longest piece in characters; scripts that count as one.
MAX_PIECE_CHARS = 16
TOGETHER = ("HAN", "HIRAGANA", "KATAKANA")
#: A common mark that belongs to the kana.
KANA_MARK = r"\x{30FC}"

#: Pairs that the driver holds; stretches that it guesses from; stretches in a partition.
HELD_PAIRS = 20_000
HEAD_RUNS = 20_000
PART_RUNS = 100_000
#: Symbols that a task holds at once.
CHUNK_SYMBOLS = 1_000_000
#: Guesses in a round, at least and at most; merges after which the stretches are written anew; merges that a threshold is set for.
LEAST_GUESSES, MOST_GUESSES = 32, 512
MERGES_PER_WRITE = 128
LOOKAHEAD = 4096
LAST = 2**32 - 1
Merge = tuple[int, int, int]


def _script_runs(spark: SparkSession) -> str:
    """A pattern for one stretch of a word in a single script, word start included.

    The scripts are those that the JVM knows; the frequent ones are tried first.
    """
    known = [str(s.name()) for s in spark._jvm.java.lang.Character.UnicodeScript.values()]
    single = [[n] for n in known if n not in (*TOGETHER, "INHERITED", "UNKNOWN", "LATIN", "COMMON")]
    groups = [["LATIN"], ["COMMON"], list(TOGETHER), *single]
    classes = []
    for group in groups:
        named = "".join(rf"\p{{Is{n}}}" for n in group)
        without = KANA_MARK if group == ["COMMON"] else ""
        named += KANA_MARK if group == list(TOGETHER) else ""
        classes.append(rf"[{named}\p{{IsInherited}}&&[^{WORD_START}{without}]]+")
    rest = rf"[\p{{IsUNKNOWN}}&&[^{WORD_START}]]+"
    return f"{WORD_START}?(?:{'|'.join([*classes, rest])})|{WORD_START}"


def _char_class(chars: list[str]) -> str:
    return "[" + "".join(rf"\x{{{ord(c):x}}}" for c in chars) + "]"


def merge_runs(words: DataFrame, alphabet: DataFrame) -> DataFrame:
    """``run, n``: stretches of words in which merges can happen, equal ones added up.

    Rare characters and script borders, which no piece may span, cut a word. ``alphabet`` has one row per character, so its
    rarer half fits a pattern.
    """
    dropped = [r["char"] for r in alphabet.filter(~F.col("kept")).select("char").collect()]
    text = F.col("word")
    parts = F.split(text, _char_class(dropped), -1) if dropped else F.array(text)
    runs = words.select(F.explode(parts).alias("part"), "n").select(
        F.explode(F.regexp_extract_all("part", F.lit(_script_runs(words.sparkSession)), F.lit(0))).alias("run"), "n"
    )
    return runs.filter(F.char_length("run") > 1).groupBy("run").agg(F.sum("n").alias("n"))


def symbol_table(words: DataFrame, alphabet: DataFrame) -> DataFrame:
    """``symbols, n``: the stretches with every character a symbol between spaces."""
    return merge_runs(words, alphabet).select(F.regexp_replace("run", "(.)", " $1 ").alias("symbols"), "n")


def gram_counts(symbols: DataFrame, max_chars: int | None = MAX_PIECE_CHARS) -> DataFrame:
    """``left, right, after, n``: adjacent pairs by the symbol that follows (null at the end).

    Every adjacent position counts, also within a run of one symbol. Pieces longer than
    ``max_chars`` are left out.
    """
    s = F.split(F.trim("symbols"), "  ")
    longer = symbols.filter(F.contains("symbols", F.lit("  "))).select(s.alias("s"), "n")
    s, size = F.col("s"), F.size("s")
    spots = F.arrays_zip(
        F.slice(s, 1, size - 1).alias("l"), F.slice(s, 2, size - 1).alias("r"), F.slice(s, 3, size - 2).alias("a")
    )
    spots = longer.select(F.explode(spots).alias("p"), "n").select(
        F.col("p.l").alias("left"), F.col("p.r").alias("right"), F.col("p.a").alias("after"), "n"
    )
    counted = spots.groupBy("left", "right", "after").agg(F.sum("n").alias("n"))
    return counted.filter(F.char_length("left") + F.char_length("right") <= max_chars) if max_chars else counted


def pair_counts(symbols: DataFrame, max_chars: int = MAX_PIECE_CHARS) -> DataFrame:
    """``left, right, n`` over the symbol table."""
    return gram_counts(symbols, max_chars).groupBy("left", "right").agg(F.sum("n").alias("n"))


def flatten(symbols: pa.Array, n: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of some stretches in a row, a 0 around each, and the count of each symbol's stretch."""
    size = np.diff(symbols.offsets.to_numpy())
    spots = np.arange(size.sum()) + np.repeat(np.arange(len(size)), size) + 1
    flat, weight = np.zeros(size.sum() + len(size) + 1, np.int64), np.zeros(size.sum() + len(size) + 1, np.int64)
    flat[spots], weight[spots] = symbols.flatten().to_numpy(), np.repeat(n.to_numpy(), size)
    return flat, weight


def pair_keys(flat: np.ndarray) -> np.ndarray:
    """``left << 32 | right`` of each symbol and the next; 0 where one is missing."""
    left, right = flat[:-1], flat[1:]
    return np.where((left > 0) & (right > 0), left << 32 | right, 0)


def sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    # By hash: a merge may change millions of places, and their order is of no use.
    at, different = pd.factorize(keys)
    out = np.zeros(len(different), np.int64)
    np.add.at(out, at, n)
    return different, out


class Runs:
    """Stretches whose pairs are merged in place: a symbol that has been taken up by its left neighbour is -1, and passed over."""

    def __init__(self, flat: np.ndarray, weight: np.ndarray):
        self.symbols, self.weight = flat.copy(), weight
        self.after, self.before = np.arange(1, len(flat) + 1), np.arange(-1, len(flat) - 1)
        self.after[-1:] = len(flat) - 1

    def copy(self) -> Runs:
        return Runs(*self.flat())

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        left = self.symbols >= 0
        return self.symbols[left], self.weight[left]

    def _keys(self, at: np.ndarray) -> np.ndarray:
        left, right = self.symbols[at], self.symbols[self.after[at]]
        return np.where((left > 0) & (right > 0), left << 32 | right, 0)

    def merge(self, step: Merge) -> tuple[np.ndarray, np.ndarray]:
        """Merges a pair, from the left where it overlaps itself: the pairs whose counts change, and by how much."""
        a, b, made = step
        at = np.flatnonzero(self.symbols == a)
        at = at[self.symbols[self.after[at]] == b]
        if a == b and len(at):
            starts = np.concatenate([[True], self.after[at[:-1]] != at[1:]])
            place = np.arange(len(at)) - np.flatnonzero(starts)[np.cumsum(starts) - 1]
            at = at[place % 2 == 0]
        if not len(at):
            return at, at
        taken = self.after[at]
        # Places rise, so one stands twice only where two merged pairs are neighbours.
        ahead = self.before[at]
        alone = np.concatenate([[True], ahead[1:] != taken[:-1]])
        was = np.concatenate([ahead[alone], at, taken])
        old = self._keys(was)
        beyond = self.after[taken]
        self.symbols[at], self.symbols[taken] = made, -1
        self.after[at], self.before[beyond] = beyond, at
        now = np.concatenate([self.before[at][alone], at])
        new = self._keys(now)
        keys, n = sums(np.concatenate([old, new]), np.concatenate([-self.weight[was], self.weight[now]]))
        some = (keys > 0) & (n != 0)
        return keys[some], n[some]


def touched(flat: np.ndarray, weight: np.ndarray, merges: list[Merge]) -> tuple[np.ndarray, np.ndarray]:
    """Only the stretches that hold a pair to be merged. Pairs of symbols yet to be made can stand nowhere else."""
    wanted = np.unique(np.array([a << 32 | b for a, b, _ in merges], np.int64))
    keys = pair_keys(flat)
    spot = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
    run = np.cumsum(flat == 0)
    hold = np.zeros(run[-1] + 2, bool)
    hold[run[:-1][wanted[spot] == keys]] = True
    # The 0 before a stretch belongs to it; one more ends the last.
    keep = hold[run]
    return np.append(flat[keep], 0), np.append(weight[keep], 0)


def _runs(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    parts = [flatten(b["symbols"], b["n"]) for b in batches if b.num_rows]
    if not parts:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The stretches of a task in parts of bounded size, however much of the table it reads."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch["symbols"].flatten())
        if size >= CHUNK_SYMBOLS:
            yield _runs(iter(held))
            held, size = [], 0
    if held:
        yield _runs(iter(held))


def count_changes(runs: DataFrame, done: list[Merge], guessed: list[Merge], least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each guessed merge, after those done, the pairs that lose occurrences and the new ones with ``least`` or more."""

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            mine = Runs(*touched(*chunk, done + guessed))
            for step in done:
                mine.merge(step)
            found = []
            for i, step in enumerate(guessed):
                keys, n = mine.merge(step)
                found.append((np.full(len(keys), i, np.int32), keys, n))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["step", "key", "n"])

    told = runs.mapInArrow(changes, "step int, key long, n long").groupBy("step", "key").agg(F.sum("n").alias("n"))
    table = told.filter((F.col("n") < 0) | (F.col("n") >= least)).toArrow()
    step, key, n = (table[c].to_numpy() for c in ("step", "key", "n"))
    order = np.argsort(step, kind="stable")
    ends = np.searchsorted(step[order], np.arange(len(guessed) + 1))
    return [(key[order[a:b]], n[order[a:b]]) for a, b in zip(ends, ends[1:])]


def cut(flat: np.ndarray, weight: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches cut between two symbols whose pair is not among the (sorted) ones ``alive``."""
    keys = pair_keys(flat)
    if not len(alive):
        dead = np.flatnonzero(keys)
    else:
        spot = np.minimum(np.searchsorted(alive, keys), len(alive) - 1)
        dead = np.flatnonzero((keys > 0) & (alive[spot] != keys))
    return np.insert(flat, dead + 1, 0), np.insert(weight, dead + 1, 0)


def apply_merges(runs: DataFrame, done: list[Merge], alive: np.ndarray | None = None) -> DataFrame:
    """The stretches with merges applied; those that are one piece now are left out. With ``alive`` they are cut
    between all other pairs, and equal ones added up."""

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            mine = Runs(*chunk)
            for step in done:
                mine.merge(step)
            flat, weight = mine.flat()
            if alive is not None:
                flat, weight = cut(flat, weight, alive)
            stops = np.flatnonzero(flat == 0)
            size = np.diff(stops) - 1
            keep = np.flatnonzero(size > 1)
            held = np.repeat(size > 1, size)
            values = flat[flat > 0][held].astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(size[keep])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array(weight[stops[keep] + 1])], ["symbols", "n"]
            )

    told = runs.mapInArrow(applied, "symbols array<int>, n long")
    return told if alive is None else told.groupBy("symbols").agg(F.sum("n").alias("n"))


def frequent_pairs(runs: DataFrame, sizes: list[int], max_chars: int, most: int = HELD_PAIRS) -> tuple[dict[int, int], int]:
    """The counts of the most frequent pairs that may become a piece, and the least count from which on they are all there."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, weight in _chunks(batches):
            keys, chars = pair_keys(flat), np.array(sizes)[flat]
            some = (keys > 0) & (chars[:-1] + chars[1:] <= max_chars)
            different, n = sums(keys[some], weight[:-1][some])
            yield pa.RecordBatch.from_arrays([pa.array(different), pa.array(n)], ["key", "n"])

    told = runs.mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    table = told.orderBy(F.desc("n")).limit(most + 1).toArrow()
    keys, n = table["key"].to_pylist(), table["n"].to_pylist()
    least = n[-1] + 1 if len(n) > most else 1
    if len(n) > most and n[0] < least:
        # Nothing but ties: all of them are needed.
        return frequent_pairs(runs, sizes, max_chars, 4 * most)
    return {k: c for k, c in zip(keys, n) if c >= least}, least


class Ranking:
    """Counts of pairs, and the best of those that may still become a piece: most frequent, then shorter, then by text."""

    def __init__(self, counts: dict[int, int], pieces: list[str], known: set[str], least: int, max_chars: int):
        self.counts, self.pieces, self.known, self.least, self.max_chars = dict(counts), pieces, known, least, max_chars
        self.heap = [self._entry(k, n) for k, n in counts.items()]
        heapq.heapify(self.heap)

    def above(self, least: int) -> Ranking:
        """The same without pairs below another threshold."""
        return Ranking({k: c for k, c in self.counts.items() if c >= least}, self.pieces, self.known, least, self.max_chars)

    def copy(self) -> Ranking:
        twin = Ranking({}, list(self.pieces), set(self.known), self.least, self.max_chars)
        twin.counts, twin.heap = dict(self.counts), list(self.heap)
        return twin

    def _entry(self, key: int, n: int) -> tuple:
        left, right = self.pieces[key >> 32], self.pieces[key & LAST]
        return -n, len(left) + len(right), left + right, left, key

    def best(self) -> int | None:
        while self.heap:
            n, _, piece, _, key = self.heap[0]
            if self.counts.get(key) == -n and -n >= self.least and piece not in self.known:
                return key
            heapq.heappop(self.heap)
        return None

    def take(self, key: int) -> Merge:
        """Makes the pair a piece, with a number of its own."""
        piece = self.pieces[key >> 32] + self.pieces[key & LAST]
        self.pieces.append(piece)
        self.known.add(piece)
        return key >> 32, key & LAST, len(self.pieces) - 1

    def follow(self, guessed: list[Merge], changes: list[tuple[np.ndarray, np.ndarray]]) -> list[Merge]:
        """Takes the guessed merges that are next by the exact counts, as far as each next one was guessed."""
        place = {a << 32 | b: i for i, (a, b, _) in enumerate(guessed)}
        for a, b, _ in guessed:
            self.pieces.append(self.pieces[a] + self.pieces[b])
        number = {made: i for i, (_, _, made) in enumerate(guessed)}
        changed: dict[int, set[int]] = {}
        for i, (keys, _) in enumerate(changes):
            for key in keys.tolist():
                if place.get(key, i) != i:
                    changed.setdefault(key, set()).add(i)
        taken, left = [], set(range(len(guessed)))
        while (key := self.best()) is not None and place.get(key) in left:
            i = place[key]
            keys, n = (x.tolist() for x in changes[i])
            # Guesses passed over: none of them may have merged what stands beside this pair, or a part of it.
            over = {j for j in left if j < i}
            beside = {number.get(x) for k in keys for x in (k >> 32, k & LAST)}
            if over & beside or over & changed.get(key, set()):
                break
            left.discard(i)
            taken.append(guessed[i])
            self.known.add(self.pieces[guessed[i][2]])
            self.change(keys, n)
        return taken

    def change(self, keys: list[int], n: list[int]) -> None:
        for key, by in zip(keys, n):
            if key in self.counts:
                self.counts[key] += by
            elif by >= self.least and len(self.pieces[key >> 32]) + len(self.pieces[key & LAST]) <= self.max_chars:
                self.counts[key] = by
            else:
                continue
            if self.counts[key] < self.least:
                del self.counts[key]
            else:
                heapq.heappush(self.heap, self._entry(key, self.counts[key]))


def guess(ranking: Ranking, head: Runs, wanted: int) -> tuple[list[Merge], int]:
    """The next merges as far as the chosen stretches tell, and the count of the last; the rest of the counts is taken to change alike."""
    ranking, head, found, total = ranking.copy(), head.copy(), [], 0
    while len(found) < wanted and (key := ranking.best()) is not None:
        total = ranking.counts[key]
        step = ranking.take(key)
        found.append(step)
        keys, n = head.merge(step)
        seen = -int(n[keys == key].sum())
        share = total / seen if seen else 1.0
        ranking.change(keys.tolist(), np.rint(n * max(1.0, share)).astype(np.int64).tolist())
    return found, total


def head_runs(runs: DataFrame, most: int = HEAD_RUNS) -> Runs:
    """The most frequent stretches and, of the others, a share drawn by hash that stands for all of them."""
    top = runs.orderBy(F.desc("n")).limit(most).toArrow()
    parts = top.to_batches()
    if top.num_rows == most:
        rest = runs.filter(F.col("n") < min(top["n"].to_pylist()))
        apart = -(-rest.count() // most)
        if apart:
            drawn = rest.filter(F.pmod(F.xxhash64("symbols"), F.lit(apart)) == 0).limit(2 * most)
            parts = parts + drawn.select("symbols", (F.col("n") * apart).alias("n")).toArrow().to_batches()
    return Runs(*_runs(iter(parts)))


def bpe_train(
    words: DataFrame, vocab_size: int = 32_000, coverage: float = COVERAGE, max_chars: int = MAX_PIECE_CHARS
) -> DataFrame:
    """``id, piece, score``: special pieces, merges in order of choice, then single characters.

    Only a bounded number of pairs and stretches, the changes beside a round's merges, and the vocabulary itself come to the
    driver. The stretches stay distributed, leave as they become one piece, and are written to the shared folder every so many
    merges, so that a lost executor costs a round and no more.
    """
    spark = words.sparkSession
    words = materialize(words, "words")
    alphabet = materialize(char_coverage(words, coverage), "alphabet")
    chars = [r["char"] for r in alphabet.filter("kept").orderBy(F.desc("n"), "char").select("char").collect()]
    wanted = vocab_size - len(SPECIAL_PIECES) - len(chars)
    if wanted < 0:
        raise ValueError(f"vocabulary of {vocab_size} is smaller than the alphabet of {len(chars)}")
    number = {c: i for i, c in enumerate(chars, 1)}

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = [[number[c] for c in run] for run in batch["run"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(listed, pa.list_(pa.int32())), batch["n"]], ["symbols", "n"])

    table = materialize(merge_runs(words, alphabet), "merge-runs")
    parts = max(spark.sparkContext.defaultParallelism, -(-table.count() // PART_RUNS))
    path = fresh_dir(spark, "runs")
    table.repartition(parts).mapInArrow(coded, "symbols array<int>, n long").write.parquet(path)

    def read(path: str) -> DataFrame:
        return spark.read.schema("symbols array<int>, n long").parquet(path)

    # ``whole`` holds the uncut stretches, to which the merges ``since`` are still to be applied; ``path`` the cut ones, with ``done``.
    whole, path = path, None
    ranking = Ranking({}, ["", *chars], set(chars), 1, max_chars)
    since: list[Merge] = []
    done: list[Merge] = []
    made: list[str] = []
    guesses = LEAST_GUESSES
    while len(made) < wanted:
        if (used_up := ranking.best() is None) and since:
            last, whole = whole, fresh_dir(spark, "runs")
            apply_merges(read(last), since).write.parquet(whole)
            drop_path(spark, last)
            since = []
        if used_up:
            sizes = [len(p) for p in ranking.pieces]
            counts, least = frequent_pairs(read(whole), sizes, max_chars)
            ranking = Ranking(counts, ranking.pieces, ranking.known, least, max_chars)
            if ranking.best() is None:
                if least == 1:
                    break
                # Only pairs whose piece is there already: go on below them.
                counts, least = frequent_pairs(read(whole), sizes, max_chars, 2**31)
                ranking = Ranking(counts, ranking.pieces, ranking.known, least, max_chars)
                if ranking.best() is None:
                    break
            # Well below the last merge ahead, as far as can be told: a wrong guess costs a new count, and nothing else.
            ahead, total = guess(ranking, head_runs(read(whole)), min(LOOKAHEAD, wanted - len(made)))
            floor = min(total, ranking.counts[ranking.best()]) // 2
            if floor > ranking.least:
                ranking = ranking.above(floor)
        if used_up or len(done) >= MERGES_PER_WRITE:
            alive = np.sort(np.fromiter(ranking.counts, np.int64, len(ranking.counts)))
            last, path = path, fresh_dir(spark, "runs")
            fewer = apply_merges(read(whole), [], alive) if used_up else apply_merges(read(last), done, alive)
            fewer.repartition(parts).write.parquet(path)
            if last is not None:
                drop_path(spark, last)
            done = []
            runs = read(path)
            head = head_runs(runs)
        guessed, _ = guess(ranking, head, min(guesses, wanted - len(made)))
        taken = ranking.follow(guessed, count_changes(runs, done, guessed, ranking.least))
        for step in taken:
            head.merge(step)
            made.append(ranking.pieces[step[2]])
        done += taken
        since += taken
        guesses = min(MOST_GUESSES, max(LEAST_GUESSES, 2 * len(taken)))
    listed = [*SPECIAL_PIECES, *made, *chars]
    n_special = len(SPECIAL_PIECES)
    rows = [(i, p, float(min(0, n_special - i))) for i, p in enumerate(listed)]
    return spark.createDataFrame(rows, "id int, piece string, score double")
