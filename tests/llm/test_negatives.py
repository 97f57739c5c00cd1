import math

import numpy as np
import pytest

from vitrine.llm import negatives


def brute(rows, asked, positives=5, count=10, low=30, high=90, of=100, scale=256):
    whole = [
        (i, label, [math.floor(scale * float(np.float32(x))) for x in v]) for i, label, v in rows
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for anchor in {(i, label, tuple(v)) for i, label, v in whole if i in asked}:
        scored = [(-sum(a * b for a, b in zip(anchor[2], v)), i, label) for i, label, v in whole if i != anchor[0] and len(v) == len(anchor[2])]
        scored.sort()
        for s, p, _ in [x for x in scored if x[2] == anchor[1]][:positives]:
            near = [x for x in scored if x[2] != anchor[1] and low * -s <= of * -x[0] <= high * -s][:count]
            out += [(anchor[0], p, r, i, -s, -x) for r, (x, i, _) in enumerate(near, 1)]
    return sorted(out)


def got(spark, rows, asked, **options):
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 as id", "2 as v", "3 as key", "4 as score")
    return sorted(tuple(r) for r in negatives.mine(frame, frame.where(frame.vec_id.isin(list(asked))), **options).collect())


def table(n=400, labels=4, seed=1):
    draw = np.random.default_rng(seed)
    rows = [(k, int(draw.integers(labels)), (draw.normal(size=6) / 3 + 0.3).astype(np.float32).tolist()) for k in range(n)]
    rows += [(n + k, k % labels, rows[5][2]) for k in range(40)]  # ties
    rows += [rows[9], rows[9], (0, 3, rows[0][2]), (0, 3, rows[1][2])]  # repeated rows, one id with several vectors
    bad = [None, [0.1, None] * 3, [float("nan")] * 6, [float("inf")] * 6, []]
    rows += [(1_000 + k, 1, v) for k, v in enumerate(bad)] + [(1_100, None, rows[3][2]), (None, 1, rows[3][2])]
    return rows + [(1_200, 1, [0.5, 0.5]), (1_201, 1, [0.4, 0.5]), (1_202, 2, [0.2, 0.3]), (1_300, 1, [0.0] * 6)]


ASKED = {0, 5, 9, 17, 401, 1_000, 1_001, 1_002, 1_003, 1_100, 1_200, 1_300}


@pytest.mark.parametrize("options", [{}, {"positives": 3, "count": 2}, {"low": 0, "high": 200}, {"low": 90, "high": 90}, {"scale": 3}])
def test_the_first_of_each_window(spark, options):
    want = brute(table(), ASKED, **options)
    if "count" in options:
        options = {**options, "negatives": options["count"]}
        del options["count"]
    assert want and got(spark, table(), ASKED, **options) == want


def test_small_blocks_and_chunks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 2)
    monkeypatch.setattr(negatives, "PAIRS", 50)
    assert got(spark, table(120), {0, 5, 9, 17}) == brute(table(120), {0, 5, 9, 17})


def test_one_label_fills_most(spark):
    rows = [(i, 0 if i % 3 else label, v) for i, label, v in table(300)[:300]]
    assert got(spark, rows, {0, 1, 2, 3}) == brute(rows, {0, 1, 2, 3})


def test_large_and_small_numbers_are_exact(spark):
    draw = np.random.default_rng(4)
    for size in (1e4, 2e5):
        rows = [(k, k % 2, (draw.normal(size=5) * size + size / 2).astype(np.float32).tolist()) for k in range(60)]
        want = brute(rows, {0, 1, 2})
        assert want and got(spark, rows, {0, 1, 2}) == want
    with pytest.raises(Exception, match="too long"):
        got(spark, [(0, 1, [1e20] * 3), (1, 2, [1.0] * 3)], {0})


def test_no_candidates(spark):
    assert got(spark, [], {0}) == []
    assert got(spark, table(50), {99_999}) == []
    assert got(spark, [(k, 1, [0.5, 0.1 * k]) for k in range(9)], {0, 1}) == []  # no other label
    assert got(spark, [(k, k, [0.5, 0.1 * k]) for k in range(9)], {0, 1}) == []  # no positive
