"""Hard negatives against a plain search over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casemill.llm import negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, row_id string, block int, part string, score int, pieces int, scores string"
EXTRA = ("r", 1, "p", 2, 3, "s")
LONG = 2**63


def expected(rows, scale=256):
    kept = []
    for vec_id, vector, label in rows:
        if None not in (vec_id, vector, label) and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [math.floor(scale * x) for x in vector], label))

    def ranked(anchor, want):
        found = [(sum(a * b for a, b in zip(anchor[1], other[1], strict=False)), other[0], k) for k, other in enumerate(kept) if other[0] != anchor[0] and want(other)]
        return sorted(found, key=lambda x: (-x[0], x[1], x[2]))

    out = []
    for anchor in kept:
        if anchor[0] % 50:
            continue
        others = ranked(anchor, lambda o: o[2] != anchor[2])
        for score, positive, _ in ranked(anchor, lambda o: o[2] == anchor[2])[:5]:
            hit = [o for o in others if 50 * score <= 100 * o[0] <= 95 * score][:3]
            out += [(anchor[0], positive, i + 1, o[1], score, o[0]) for i, o in enumerate(hit)]
    return sorted(tuple(max(-LONG, min(LONG - 1, x)) for x in row) for row in out)


def run(spark, rows):
    frame = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(4)
    return sorted(map(tuple, negatives.mine(frame, F.col("vec_id") % 50 == 0).collect()))


def vectors(seed, many=700, width=9, size=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0.2, size) for _ in range(width)], rng.choice((1, 1, 1, 2, 3, 4))) for i in range(many)]
    rows += [(10_000 + i, rows[i % 7][1], 1 + i % 2) for i in range(60)]  # ties
    rows += [(50, rows[3][1], 2), (50, rows[4][1], 1), (51, rows[50][1], rows[50][2]), (51, rows[50][1], rows[50][2])]  # repeated ids and rows
    rows += [(20_000, None, 1), (20_050, [1.0, None], 1), (20_100, [math.nan] * width, 1), (20_150, [math.inf] * width, 1), (20_200, [1.0] * width, None)]
    return rows + [(None, [1.0] * width, 1), (-100, [0.0] * width, 1), (30_000, [], 2), (30_050, [2.0, 1.0], 3), (30_100, [1.0] * width, 99)]


@pytest.mark.parametrize("blocks", [(8192, 2048, 8192), (64, 16, 5)])
def test_mined_rows_are_those_of_a_full_search(spark, monkeypatch, blocks):
    for name, value in zip(("BLOCK_ROWS", "PIECE_ROWS", "LANE_ANCHORS"), blocks, strict=True):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(1)
    got = run(spark, rows)
    assert got == expected(rows) and len(got) > 100


@pytest.mark.parametrize("size", [4e7, 1e12])
def test_large_components_are_exact(spark, size):
    rows = vectors(2, many=120, width=4, size=size)
    assert run(spark, rows) == expected(rows)


def test_empty_tables_and_no_anchor(spark):
    assert run(spark, []) == [] and run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == [] and run(spark, [(50, None, 1)]) == []


def test_scan_keeps_what_may_matter_and_drops_the_rest():
    rng = np.random.default_rng(5)
    rows = np.floor(256 * rng.normal(size=(500, 64)))
    block = negatives.Block(np.arange(500), np.arange(500), np.zeros(500, int), rows)
    anchor, visited = rows[7] * (rng.random(64) < 0.2), []

    def needed(low, high):
        visited.append(len(low))
        return high >= np.partition(low, -5)[-5]

    live, scores = negatives.scan(block, anchor, np.ones(500, bool), needed)
    exact = rows @ anchor
    assert (scores == exact[live]).all() and set(np.argsort(-exact)[:5]) <= set(live.tolist())
    assert visited[0] == 500 and len(live) < 500


def test_windows_of_scores():
    for score in range(0, 500):
        low, high = negatives.window(score, 50, 95)
        assert [s for s in range(600) if 50 * score <= 100 * s <= 95 * score] == list(range(low, high + 1))
    low, high = negatives.window(-7, 50, 95)
    assert low > high
