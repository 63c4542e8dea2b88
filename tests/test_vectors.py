"""Cosine searches by blocks against plain loops, with ties, nulls, other widths and vectors of length 0."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from attesto.operators import vectors

SCHEMA = "row long, vec array<float>, note string"


def _rows(seed, n, width):
    r = random.Random(seed)
    some = [[float(np.float32(r.uniform(-1, 1))) for _ in range(width)] for _ in range(max(1, n // 3))]
    rows = [(i * 5 - 3, r.choice(some), f"n{i}") for i in range(n)]
    rows += [(10**12, [0.0] * width, None), (10**12 + 1, None, "x"), (10**12 + 2, [1.0] * (width + 1), "x"), (10**12 + 3, [None] + [1.0] * (width - 1), "x"), (10**12 + 4, [float("nan")] * width, "x"), (10**12 + 5, [float("inf")] * width, "x"), (10**12 + 6, [], "x")]
    r.shuffle(rows)
    return rows


def _plain(rows, query, k, digits):
    out = []
    for row, vec, _ in rows:
        if vec is None or len(vec) != len(query) or any(x is None or not math.isfinite(x) for x in vec):
            continue
        length = math.sqrt(sum(x * x for x in vec)) * math.sqrt(sum(x * x for x in query))
        score = sum(x * y for x, y in zip(vec, query)) / length if length else 0.0
        out.append((-float(Decimal(repr(score)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)), row))
    return [(row, -s) for s, row in sorted(out)[:k]]


@pytest.mark.parametrize("k", [0, 1, 7, 500])
def test_top_k_by_blocks(spark, k):
    rows = _rows(3, 400, 9)
    query = [0.3, -0.2, 0.9, 0.1, 0.0, -0.7, 0.2, 0.5, 0.11]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = _plain(rows, query, k, 4)
    got = vectors.cosine_top_k(frame, query, k, digits=4).orderBy("rank").collect()
    assert [(r.row, r.score) for r in got] == want and [r["rank"] for r in got] == [*range(1, len(want) + 1)]
    assert {r.note for r in got} <= {x[2] for x in rows}
    packed = vectors.packed_top_k(vectors.packed(frame, size=50), query, k, digits=4).orderBy("rank").collect()
    assert [(r.row, r.score) for r in packed] == want
    assert dict(_plain(rows, query, 10**6, 4)) == {r.row: r.score for r in vectors.cosines(frame, query, digits=4).collect()}


def test_equal_vectors_tie_in_any_place():
    """A score never depends on where in a block a vector lies, so ties are ties."""
    r = np.random.default_rng(1)
    for width in (1, 3, 64, 257):
        one, query = r.normal(size=width).astype(np.float32), r.normal(size=width)
        matrix = r.normal(size=(2000, width)).astype(np.float32)
        places = np.sort(r.choice(2000, 40, replace=False))
        matrix[places] = one * np.sign(one @ query)
        at, scores = vectors._best_rows(matrix, query, list(range(2000)), 2000, None)
        tied = at[np.isin(at, places)]
        assert len(set(vectors._cosines(matrix, query)[places])) == 1 and tied.tolist() == places.tolist() and (np.diff(scores) <= 0).all()


def test_the_screen_loses_nothing():
    r = np.random.default_rng(2)
    for trial in range(60):
        n, width, k = int(r.integers(1, 3000)), int(r.integers(1, 40)), int(r.integers(1, 20))
        matrix = (r.normal(size=(n, width)) * 10.0 ** r.integers(-25, 19)).astype(np.float32)
        query = r.normal(size=width)
        scores = vectors._cosines(matrix, query)
        at, _ = vectors._best_rows(matrix, query, list(range(n)), k, None)
        assert at.tolist() == sorted(range(n), key=lambda i: (-scores[i], i))[:k]


def test_empty_and_plan(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert vectors.cosine_top_k(frame, [1.0], 5).count() == 0 and vectors.packed(frame).count() == 0
    plan = vectors.cosine_top_k(frame, [1.0], 5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan and "aggregate(" not in plan
