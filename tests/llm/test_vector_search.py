"""Exact top-k search against scoring every pair."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from captionloom.llm import vector_search as vs
from tests.llm.test_operators import bag

SCHEMA = "vec_id long, embedding array<double>"
COLUMNS = ["query_id", "rank", "vec_id", "score"]


def brute(rows, every=50, top=5):
    whole = []
    for i, (vec, e) in enumerate(rows):
        if e is not None and all(x is not None and math.isfinite(x * 256) for x in e):
            whole.append((i, vec, [math.floor(256 * x) for x in e]))
    out = []
    for i, vec, e in whole:
        if vec is None or vec % every:
            continue
        scored = []
        for j, other, f in whole:
            if i != j and len(e) == len(f):
                score = min(max(sum(a * b for a, b in zip(e, f)), -(2**63)), 2**63 - 1)
                scored.append((-score, other is None, other or 0, other))
        out += [(vec, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:top])]
    return out


def rows_of(n=700, dim=12):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((9, dim))
    vectors = [centres[i % 9] + 0.1 * rng.standard_normal(dim) for i in range(n)]
    vectors += [3.0 * v for v in vectors[:20]] + [0.0 * v for v in vectors[:3]]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    # Copies of one vector in a large part of the rows, ties by id, repeated ids, a null id.
    rows += [(2000 + i, rows[7][1]) for i in range(300)] + [rows[50], rows[50], (None, rows[0][1]), (None, rows[0][1])]
    rows += [(5000, None), (5050, [float("nan")] * dim), (5100, [None] * dim), (5150, [float("inf")] + [0.0] * (dim - 1)), (5200, [1e308] * dim)]
    # Other lengths: alone, two, none at all; numbers whose products pass 53 and 64 bits.
    rows += [(6000, [1.0]), (6050, [0.5, 1.0]), (6051, [0.25, -1.0]), (6100, []), (6101, [])]
    rows += [(7000, [1e8, -3e8, 7.5]), (7001, [1e8 + 1, -3e8, 0.1]), (7050, [1e9, 1e9, 1e9]), (7051, [-1e9, -1e9, 5.0]), (7052, [1e30, 1.0, 1.0])]
    rows += [(7100, [1e200] * 4), (7101, [-1e200] * 4), (7102, [1.0] * 4), (7103, [0.0] * 4)]
    return rows


@pytest.mark.parametrize("tile_rows,tiles", [(8192, 2048), (64, 2048), (32, 4)])
def test_search(spark, monkeypatch, tile_rows, tiles):
    monkeypatch.setattr(vs, "TILE_ROWS", tile_rows)
    monkeypatch.setattr(vs, "TILES", tiles)
    rows = rows_of()
    table = spark.createDataFrame([(*r, "x", 1.0) for r in rows], SCHEMA + ", rid string, norm double").repartition(4)
    got = vs.report(table)
    assert got.columns == COLUMNS and got.schema["rank"].dataType.simpleString() == "int"
    got, want = bag(got.collect()), bag(brute(rows))
    assert got == want, (list((got - want).items())[:5], list((want - got).items())[:5])


def test_other_scale_and_number(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)]
    got = vs.top_scores(spark.createDataFrame(rows, SCHEMA), F.col("vec_id").isin(0, 3), top=2, scale=1.0)
    assert {(r["query_id"], r["rank"]) for r in got.collect()} == {(0, 1), (0, 2), (3, 1), (3, 2)}


def test_few_rows(spark):
    assert vs.report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vs.report(spark.createDataFrame([(50, [1.0, 2.0])], SCHEMA)).count() == 0
    got = vs.report(spark.createDataFrame([(50, [1.0, 2.0]), (7, [0.5, 0.0])], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(50, 1, 7, 256 * 128)]


def test_bounds_rule_out(spark):
    # In clusters most candidates are never scored.
    rng = np.random.default_rng(9)
    centres = 4 * rng.standard_normal((40, 16))
    tried = []
    rows = [(i, [float(x) for x in centres[i % 40] + 0.05 * rng.standard_normal(16)]) for i in range(4000)]
    whole = vs.quantised(spark.createDataFrame(rows, SCHEMA))
    pivots = vs.pivots_of(whole)
    tiles = vs.tiled(whole, pivots)
    table = tiles.toArrow()
    part = vs.Part(table.to_batches(), pivots[16][0])
    plain = vs.exact_scores
    vs.exact_scores = lambda x, q, largest: tried.append(len(x)) or plain(x, q, largest)
    try:
        asked = tiles.filter("vec_id < 40").withColumn("to", vs.to_pivots(pivots, False)).withColumn("kth", F.lit(vs.LOW)).toArrow()
        for batch in asked.to_batches():
            list(part.best(batch, 5))
    finally:
        vs.exact_scores = plain
    assert sum(tried) < 0.5 * 40 * len(rows)
