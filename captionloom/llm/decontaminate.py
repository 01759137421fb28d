"""Benchmark decontamination: scan texts for the word n-grams of test items, remove what is hit.

The n-grams are broadcast as a hash set keyed by the n-grams themselves, so that a hit on the hash
is verified word by word. A set holds at most ``MAX_GRAMS``; larger benchmarks are scanned in
several passes, each with a set of its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionloom.llm.common import PLACE, WORD_BYTES, with_place
from captionloom.session import materialize

WINDOW = 10
#: Pairs of n-gram and item in one broadcast: about 60 MB in a worker.
MAX_GRAMS = 300_000
FOUND = "struct<n_words:long,spans:array<struct<start:int,end:int>>,items:array<string>>"
_FOUND = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def words(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a text joined by single spaces, with start and end byte of each word."""
    joined = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split())
    if not joined:
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return joined, np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))


def grams(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct ``gram`` (bytes), ``n`` (words), ``item`` (null where it has no id) of ``benchmark`` (``item_id, text``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                joined, starts, ends = words(text)
                n = min(window, len(starts))
                if n:
                    found = sorted({joined[s:e] for s, e in zip(starts.tolist(), ends[n - 1 :].tolist())})
                    sizes, items = pa.array([n] * len(found), pa.int32()), pa.array([item] * len(found), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), sizes, items], ["gram", "n", "item"])

    items = benchmark.select(F.col("item_id").cast("string"), "text")
    return items.mapInArrow(cut, "gram binary, n int, item string").distinct()


def scan(text: str | None, table: dict[int, dict[bytes, list[str | None]]]) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Number of words, merged spans of hit words, and the items whose n-grams occur; items without an id hit unnamed."""
    joined, starts, ends = words(text)
    first = starts.tolist()
    hits: list[tuple[int, int]] = []
    items: set[str | None] = set()
    for n, known in table.items():
        for i, (s, e) in enumerate(zip(first, ends[n - 1 :].tolist())):
            if (gram := joined[s:e]) in known:
                hits.append((i, i + n))
                items.update(known[gram])
    return len(first), merged(hits), sorted(items - {None})


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _scanner(pairs: DataFrame):
    """A function of a text column, with the n-grams of ``pairs`` (bounded) broadcast."""
    table: dict[int, dict[bytes, list[str | None]]] = defaultdict(lambda: defaultdict(list))
    for row in pairs.toLocalIterator():
        table[row["n"]][bytes(row["gram"])].append(row["item"])
    known = pairs.sparkSession.sparkContext.broadcast({n: dict(d) for n, d in table.items()})

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        found = (scan(t.as_py(), known.value) for t in texts)
        rows = [
            {"n_words": n, "spans": [{"start": s, "end": e} for s, e in spans], "items": items} for n, spans, items in found
        ]
        return pa.array(rows, _FOUND)

    return find


def _unite(founds: Column) -> Column:
    """One result of the results that several passes gave for a text."""

    @F.arrow_udf(FOUND)
    def unite(founds: pa.Array) -> pa.Array:
        rows = []
        for parts in founds.to_pylist():
            spans = merged([(s["start"], s["end"]) for p in parts for s in p["spans"]])
            items = sorted({i for p in parts for i in p["items"]})
            rows.append({"n_words": parts[0]["n_words"], "spans": [{"start": s, "end": e} for s, e in spans], "items": items})
        return pa.array(rows, _FOUND)

    return unite(founds)


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_grams: int = MAX_GRAMS) -> DataFrame:
    """``docs`` (``text`` and others) with ``__found``: words, spans of hit words, items.

    One pass over the texts and no exchange while the benchmark fits one broadcast set. Beyond,
    every pass keeps a row for a text that it hit, and a text's passes are joined to it by place.
    """
    pairs = materialize(grams(benchmark, window), "grams")
    blocks = max(1, -(-pairs.count() // max_grams))
    if blocks == 1:
        return docs.withColumn("__found", _scanner(pairs)(F.col("text")))
    placed = with_place(docs)
    passes = None
    for k in range(blocks):
        share = pairs.filter(F.pmod(F.xxhash64("gram", "item"), F.lit(blocks)) == k)
        seen = placed.select(*PLACE, _scanner(share)(F.col("text")).alias("found"))
        seen = materialize(seen.filter((F.size("found.spans") > 0) | F.lit(k == 0)), "pass")
        passes = seen if passes is None else passes.union(seen)
    whole = passes.groupBy(*PLACE).agg(F.collect_list("found").alias("found"))
    return placed.join(whole.select(*PLACE, _unite(F.col("found")).alias("__found")), PLACE).drop(*PLACE)


def n_hit(found: Column) -> Column:
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_grams: int = MAX_GRAMS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row.

    Null and empty texts have no words; items without words have no windows. Items without an id hit words like any
    other, and are neither counted nor named.
    """
    found = F.col("__found")
    hit = find_hits(docs.select("doc_id", "text"), benchmark, window, max_grams)
    return hit.select(
        "doc_id",
        found["n_words"].alias("n_words"),
        n_hit(found).alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(found["items"]), ","), 256).alias("items_sha256"),
        (F.size(found["spans"]) > 0).alias("contaminated"),
    )


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the hit words and what stands between words of one span."""
    raw = text.encode("utf-8", "surrogatepass")
    is_word = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 32
    edges = np.flatnonzero(np.diff(is_word, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    kept, at = [], 0
    for first, last in spans:
        kept.append(raw[at : starts[first]])
        at = ends[last - 1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW, max_grams: int = MAX_GRAMS
) -> DataFrame:
    """``docs`` without contaminated documents, or (``mode='spans'``) without the hit spans of their texts."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode}")
    hit = find_hits(docs, benchmark, window, max_grams)
    if mode == "documents":
        return hit.filter(F.size("__found.spans") == 0).drop("__found")

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), spans.to_pylist())
        clean = [cut_spans(t, [(s["start"], s["end"]) for s in hits]) if hits else t for t, hits in pairs]
        return pa.array(clean, pa.string())

    return hit.withColumn("text", cut("text", "__found.spans")).drop("__found")
