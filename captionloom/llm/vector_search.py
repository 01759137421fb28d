"""Exact top-k by inner product: pivot distances bound every score, candidates are tried in the order of their bounds.

Vectors are made integers, ``floor(scale * x)``. Of vectors of one length, with M the largest norm, appending
``sqrt(M^2 - |x|^2)`` to a candidate and 0 to a query gives points whose squared distance is
``|q|^2 + M^2 - 2 q.x``: the largest score is the smallest distance, and the triangle inequality holds. The table
of distances to pivots gives each candidate the lower bound ``max |d(q, p) - d(x, p)|``.

Candidates are put in tiles, neighbours of one pivot together. A query searches its own tile first; what it finds
there rules out other tiles by the range of their pivot distances, and it goes to those that are left. In a tile
candidates are tried in the order of their bounds, until the next bound is beyond the k-th distance found. Ties are kept
until they are certainly worse, scores are exact integers, so the result is that of trying everything.

Vectors that are null or hold null or non-finite components, also after scaling, take no part. Vectors of different
lengths have no score together. A score beyond 64 bits counts as the nearest 64-bit number.
A null id is no query's and comes last in ties; rows with one id are different candidates, and each a query. An empty
table gives an empty result; columns beyond ``vec_id`` and ``embedding`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from captionloom.session import materialize

SCALE = 256.0
TOP = 5
PIVOTS = 24
#: Rows that pivots are chosen from, for each length of vector.
PIVOT_ROWS = 512
#: Tiles that queries are dealt to, and rows that a task holds at once.
TILES = 2048
TILE_ROWS = 8192
#: Lengths of vectors that may occur.
LENGTHS = 64
#: Candidates tried at a time; queries bounded at a time; tasks of a search.
STEP = 256
QUERY_ROWS = 64
TASKS = 4096
#: Of the largest distance that can occur: beyond what rounding, to single precision too, can do to a bound.
SLACK = 2e-6
LOW, HIGH = -(2**63), 2**63 - 1
#: Whole numbers whose sums of products stay below this are added exactly in double precision, in any order.
EXACT = 2.0**53
Pivots = dict[int, tuple[float, np.ndarray]]


def quantised(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """``rid, vec_id, dim, norm, x``: usable vectors as whole numbers (doubles), written. ``norm`` is the squared length."""
    scaled = F.transform("embedding", lambda c: c.cast("double") * scale)
    usable = vectors.select("vec_id", scaled.alias("x")).filter(
        F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    # Doubles of 2^53 and more are whole already.
    whole = F.transform("x", lambda c: F.when(F.abs(c) < EXACT, F.floor(c).cast("double")).otherwise(c))
    rows = usable.select(F.monotonically_increasing_id().alias("rid"), "vec_id", whole.alias("x"))
    norm = F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)
    return materialize(rows.select("rid", "vec_id", F.size("x").alias("dim"), norm.alias("norm"), "x"), "whole")


def choose_pivots(rows: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Of some rows those far from each other: each next one is the farthest from all before."""
    with np.errstate(all="ignore"):
        chosen, near = [0], ((rows - rows[0]) ** 2).sum(axis=1)
        while len(chosen) < min(n, len(rows)):
            chosen.append(int(near.argmax()))
            near = np.minimum(near, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def pivots_of(whole: DataFrame) -> Pivots:
    """Per length of vector the largest squared norm and the pivots, from a bounded number of rows by hash.

    The choice only decides how much is ruled out, never what is found.
    """
    sizes = whole.groupBy("dim").agg(F.max("norm").alias("most"), F.count("*").alias("n")).orderBy("dim").limit(LENGTHS + 1).collect()
    if len(sizes) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} different lengths")
    found = {}
    for r in sizes:
        # Some four times as many as wanted lie below the threshold, whatever the size of the table; equal ones count once.
        share = min(1.0, 4.0 * PIVOT_ROWS / r["n"])
        hashed = F.xxhash64("x", F.lit(11))
        some = whole.filter((F.col("dim") == r["dim"]) & (hashed.cast("double") <= (share * 2 - 1) * 2.0**63))
        drawn = some.select(hashed.alias("h"), "x").distinct().orderBy("h").limit(PIVOT_ROWS).collect()
        rows = np.array([d["x"] for d in drawn] or [[0.0] * r["dim"]], float).reshape(len(drawn) or 1, r["dim"])
        found[r["dim"]] = (r["most"], choose_pivots(rows))
    return found


def distances(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to pivots (lifted by 0) of rows whose appended coordinate is ``lift``."""
    with np.errstate(all="ignore"):
        d = ((x * x).sum(axis=1) + lift * lift)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * x @ pivots.T
        return np.sqrt(np.maximum(d, 0)).astype(np.float32)


def _matrix(rows: pa.Array, kind=np.float64) -> np.ndarray:
    return rows.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(rows), -1)


def _lists(values: np.ndarray) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), pa.float32()))


def to_pivots(pivots: Pivots, lifted: bool) -> Column:
    """The distances of a row (``dim, norm, x``) to the pivots of its length: as a candidate lifted to the largest norm, or as a query."""

    @F.arrow_udf("array<float>")
    def measure(dims: pa.Array, norms: pa.Array, x: pa.Array) -> pa.Array:
        dims, norms = dims.to_numpy(), norms.to_numpy()
        parts, places = [], []
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            most, points = pivots[int(dim)]
            rows = _matrix(x.take(pa.array(at))) if dim else np.zeros((len(at), 0))
            with np.errstate(all="ignore"):
                lift = np.sqrt(np.maximum(most - norms[at], 0)) if lifted else np.zeros(len(at))
            parts.append(_lists(distances(rows, lift, points)))
            places.append(at)
        back = np.argsort(np.concatenate(places), kind="stable")
        return pa.concat_arrays(parts).take(pa.array(back))

    return measure("dim", "norm", "x")


def tiled(whole: DataFrame, pivots: Pivots) -> DataFrame:
    """Candidates with ``to`` (distances to the pivots), ``tile`` and ``part``, written.

    Tiles are ranges of rows with one nearest pivot, by the distance to it; rows of a tile that is too large for one
    task are dealt to parts.
    """
    placed = whole.withColumn("to", to_pivots(pivots, True))
    placed = materialize(placed.withColumn("near", F.array_min("to")).withColumn("cell", F.array_position("to", F.col("near"))), "placed")
    total = placed.count()
    rows = max(TILE_ROWS, -(-total // TILES))
    ranged = placed.repartitionByRange(max(1, -(-total // rows)), "dim", "cell", "near", "rid")
    part = F.pmod(F.xxhash64("rid"), F.lit(-(-rows // TILE_ROWS))).cast("int")
    return materialize(ranged.drop("near", "cell").withColumn("tile", F.spark_partition_id()).withColumn("part", part), "tiles")


def tile_ranges(tiles: DataFrame) -> dict[int, list[tuple]]:
    """Per length ``tile, part, lowest and highest distance to each pivot``. At most ``TILES`` tiles, some numbers each."""
    ends = [f(F.get("to", F.lit(i))).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in range(PIVOTS)]
    found: dict[int, list[tuple]] = {}
    for r in tiles.groupBy("dim", "tile").agg(F.collect_set("part").alias("parts"), *ends).collect():
        lo, hi = ([r[f"{n}{i}"] for i in range(PIVOTS) if r[f"{n}{i}"] is not None] for n in ("lo", "hi"))
        found.setdefault(r["dim"], []).append((r["tile"], r["parts"], lo, hi))
    return found


def reach(norm: float | np.ndarray, most: float, kth: np.ndarray) -> np.ndarray:
    """The distance beyond which nothing scores as much as ``kth``, and slack for both sides of the comparison."""
    with np.errstate(all="ignore"):
        far = np.sqrt(norm) + np.sqrt(most)
        limit = np.sqrt(np.maximum(norm + most - 2.0 * kth, 0)) + 2 * SLACK * far
    # A score at the lower end of 64 bits may stand for any smaller one.
    return np.where(kth <= LOW, np.inf, limit)


def exact_scores(x: np.ndarray, q: np.ndarray, largest: float) -> np.ndarray:
    """Inner products of whole numbers as 64-bit integers; ``largest`` bounds the numbers of ``x``."""
    if len(q) * largest * np.abs(q).max(initial=0.0) < EXACT:
        return (x @ q).astype(np.int64)
    whole = [int(v) for v in q]
    sums = (sum(int(a) * b for a, b in zip(row, whole)) for row in x)
    return np.array([min(max(s, LOW), HIGH) for s in sums], np.int64)


class Part:
    """Candidates of one part of a tile, to be searched by any number of queries."""

    def __init__(self, batches: list[pa.RecordBatch], most: float):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.rid = table["rid"].to_numpy()
        ids = table["vec_id"].combine_chunks()
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.id = ids.fill_null(HIGH).to_numpy()
        dim = table["dim"][0].as_py()
        self.x = _matrix(table["x"].combine_chunks()) if dim else np.zeros((len(self.rid), 0))
        self.to = _matrix(table["to"].combine_chunks(), np.float32).T.copy()
        self.largest, self.most = np.abs(self.x).max(initial=0.0), most

    def best(self, queries: pa.RecordBatch, top: int) -> Iterator[tuple]:
        """``(rid, query, vec_id, score, candidate)`` of the best candidates of each query, none that its ``kth`` rules out."""
        rid, norm, kth = (queries[c].to_numpy(zero_copy_only=False) for c in ("rid", "norm", "kth"))
        to = _matrix(queries["to"], np.float32)
        x = _matrix(queries["x"]) if self.x.shape[1] else np.zeros((len(rid), 0))
        bounds = np.zeros((len(rid), len(self.rid)), np.float32)
        for mine, theirs in zip(to.T, self.to):
            np.maximum(bounds, np.abs(mine[:, None] - theirs[None]), out=bounds)
        for i, bound in enumerate(bounds):
            limit = reach(norm[i], self.most, kth[i])
            left = np.flatnonzero(~(bound > limit) & (self.rid != rid[i]))
            left = left[np.argsort(bound[left], kind="stable")]
            found = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for at in range(0, len(left), STEP):
                if bound[left[at]] > limit:
                    break
                some = left[at : at + STEP]
                score = np.concatenate([found[0], exact_scores(self.x[some], x[i], self.largest)])
                some = np.concatenate([found[1], some])
                order = np.lexsort((self.rid[some], self.id[some], ~self.known[some], ~score))[:top]
                found = score[order], some[order]
                if len(order) == top:
                    limit = min(limit, reach(norm[i], self.most, found[0][-1]))
            for score, c in zip(*found):
                yield rid[i], int(self.id[c]) if self.known[c] else None, int(score), self.rid[c]


def search(candidates: DataFrame, queries: DataFrame, pivots: Pivots, tasks: int, top: int = TOP) -> DataFrame:
    """``rid, vec_id, score, other`` of the best candidates of each query in each part it is dealt to.

    Candidates (``tile, part, dim, rid, vec_id, norm, x, to``) of a part are held by its task; queries (with ``kth``, a score
    that is reached elsewhere) pass by in batches.
    """
    key = ["tile", "dim", "part"]
    common = [*key, "rid", "norm", "x", "to"]
    both = candidates.select(*common, "vec_id", F.lit(LOW).alias("kth"), F.lit(0).alias("asks")).unionByName(
        queries.select(*common, F.lit(None).cast("long").alias("vec_id"), "kth", F.lit(1).alias("asks"))
    )
    dealt = both.repartition(tasks, *key).sortWithinPartitions(*key, "asks")
    most = {dim: m for dim, (m, _) in pivots.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows, part = None, [], None
        for batch in batches:
            marks = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in (*key, "asks")])
            cuts = [0, *(np.flatnonzero((np.diff(marks, axis=1) != 0).any(axis=0)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                where = tuple(marks[:3, a])
                if where != here:
                    here, rows, part = where, [], None
                if not marks[3, a]:
                    rows.append(batch.slice(a, b - a))
                    continue
                part = part or Part(rows, most[int(where[1])])
                for first in range(a, b, QUERY_ROWS):
                    told = list(part.best(batch.slice(first, min(QUERY_ROWS, b - first)), top))
                    if told:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*told)], ["rid", "vec_id", "score", "other"])

    return dealt.mapInArrow(run, "rid long, vec_id long, score long, other long")


def elsewhere(queries: DataFrame, ranges: dict[int, list[tuple]], pivots: Pivots) -> DataFrame:
    """Each query (with its home ``tile, part`` and ``kth``) once for every other part whose tile it cannot rule out."""
    tables = {}
    for dim, tiles in ranges.items():
        lo, hi = (np.array([t[i] for t in tiles], np.float32) for i in (2, 3))
        tables[dim] = (lo, hi, [[(t[0], p) for p in t[1]] for t in tiles])

    @F.arrow_udf("array<struct<tile: int, part: int>>")
    def open_parts(dims: pa.Array, norms: pa.Array, kth: pa.Array, to: pa.Array, tile: pa.Array, part: pa.Array) -> pa.Array:
        found = []
        for dim, norm, k, at, *home in zip(*[c.to_pylist() for c in (dims, norms, kth, to, tile, part)]):
            lo, hi, parts = tables[dim]
            at = np.array(at, np.float32)[None]
            bound = np.maximum(np.maximum(lo - at, at - hi), 0).max(axis=1, initial=0)
            left = np.flatnonzero(~(bound > reach(norm, pivots[dim][0], np.int64(k))))
            found.append([{"tile": t, "part": p} for i in left for t, p in parts[i] if [t, p] != home])
        return pa.array(found, pa.list_(pa.struct([("tile", pa.int32()), ("part", pa.int32())])))

    dealt = queries.withColumn("there", open_parts("dim", "norm", "kth", "to", "tile", "part")).drop("tile", "part")
    return dealt.select("*", F.inline("there")).drop("there")


def top_scores(vectors: DataFrame, is_query: Column, top: int = TOP, scale: float = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` highest integer inner products of every row that ``is_query``
    chooses by ``vec_id``, over all other rows; ties to the smaller ``vec_id``."""
    whole = quantised(vectors.select("vec_id", "embedding"), scale)
    pivots = pivots_of(whole)
    tiles = tiled(whole, pivots)
    ranges = tile_ranges(tiles)
    tasks = max(1, min(TASKS, sum(len(parts) for found in ranges.values() for _, parts, _, _ in found)))
    asked = materialize(tiles.filter(is_query).withColumn("to", to_pivots(pivots, False)), "asked")
    home = materialize(search(tiles, asked.withColumn("kth", F.lit(LOW)), pivots, tasks, top), "home")
    # The k-th score at home, where there are as many.
    kth = home.groupBy("rid").agg(F.when(F.count("*") == top, F.min("score")).alias("kth"))
    known = asked.join(kth, "rid", "left").withColumn("kth", F.coalesce("kth", F.lit(LOW)))
    found = home.unionByName(search(tiles, elsewhere(known, ranges, pivots), pivots, tasks, top))
    order = W.partitionBy("rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    names = asked.select("rid", F.col("vec_id").alias("query_id"))
    return ranked.join(names, "rid").select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame, every: int = 50) -> DataFrame:
    """The five best of each row whose ``vec_id`` is divisible by ``every``."""
    return top_scores(vectors, F.col("vec_id") % every == 0)
