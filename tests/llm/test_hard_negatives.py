"""Hard negatives against brute force over all rows, packed products against plain ones."""

import math
import random

import numpy as np
import pytest

from tabcal.llm.hard_negatives import first_of, mine_hard_negatives, packed_products


@pytest.mark.parametrize("low,high,dims", [(-100, 100, 64), (0, 1, 3), (-5, 300, 200), (7, 7, 5), (-(1 << 30), 1 << 30, 9), (-(1 << 80), 1 << 80, 4), (-(1 << 25), 3, 700)])
def test_packed_products_are_exact(low, high, dims):
    rng = random.Random(dims)
    a, r = ([[rng.randint(low, high) for _ in range(dims)] for _ in range(n)] for n in (5, 23))
    kind = object if high >= 1 << 62 else np.int64
    got = packed_products(np.array(a, dtype=kind), np.array(r, dtype=kind))
    assert got.tolist() == [[sum(x * y for x, y in zip(u, v, strict=True)) for v in r] for u in a]


def test_first_of_takes_the_first_place_of_equals():
    scores = np.array([3, 9, 9, 1, 9, 5])
    assert first_of(scores, np.array([True, False, True, True, True, True]), 2).tolist() == [2, 4]
    assert first_of(scores, scores < 9, 10).tolist() == [5, 0, 3] and first_of(scores, scores > 10, 3).tolist() == []


def good(i, label, v):
    return i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows):
    rows = sorted({(i, label, tuple(x + 0.0 for x in v)) for i, label, v in rows if good(i, label, v)})
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    out = []
    for i, label, v in whole:
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, other) for j, other, w in whole if j != i and len(w) == len(v))
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            fits = [(n, k) for n, k, other in scored if other != label and 30 * -p <= 100 * -n <= 90 * -p][:10]
            out += [(i, j, rank, k, -p, -n) for rank, (n, k) in enumerate(fits, 1)]
    return sorted(out)


def vectors(seed, n=260):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 0.3) for _ in range(8)] for _ in range(6)]
    rows = []
    for i in range(n):
        v = [x + rng.gauss(0, 0.2) for x in rng.choice(base)]
        rows.append((i * 5, rng.choice([0, 0, 0, 1, 2]), v))
    rows += [(1100, 1, rows[3][2]), (1105, 1, rows[3][2]), (1105, 1, rows[3][2]), (100, 0, rows[5][2]), (100, 0, rows[5][2]), (200, 2, rows[9][2])]
    rows += [(None, 0, base[0]), (7, None, base[0]), (8, 0, None), (9, 0, [None] + base[0][1:]), (300, 1, [float("nan")] * 8), (400, 0, [float("inf")] * 8)]
    rows += [(1200, 0, [0.0] * 8), (1201, 0, [-0.0] * 8), (1202, 1, [0.0] * 8), (1300, 5, [0.5, 0.5]), (1301, 5, [0.5, 0.25]), (1302, 6, [0.4, 0.2]), (1400, 7, [1.0])]
    rows += [(1500, 8, [1e9] * 3), (1501, 8, [1e9, 2e9, 3.0]), (1502, 9, [1e9, 1.0, -4e8]), (-100, 0, base[1]), (1600, 0, [])]
    return rows


@pytest.mark.parametrize("block_bytes", [4 << 20, 900])
@pytest.mark.parametrize("seed", [0, 1])
def test_mining_equals_all_pairs(spark, seed, block_bytes):
    rows = vectors(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, h1 string")
    got = mine_hard_negatives(df, block_bytes=block_bytes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows)
    assert len(want) > 50 and sorted(tuple(r) for r in got.collect()) == want


def test_no_rows_and_no_anchors(spark):
    df = spark.createDataFrame([(1, 0, [0.5]), (2, 1, [0.5])], "vec_id long, label int, embedding array<float>")
    assert mine_hard_negatives(df).collect() == [] and mine_hard_negatives(df.limit(0)).collect() == []
    whole = spark.createDataFrame([(0, 0, None), (None, None, [1.0])], "vec_id long, label int, embedding array<float>")
    assert mine_hard_negatives(whole).collect() == []
