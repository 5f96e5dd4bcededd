"""Nearest neighbours without a radius against all pairs."""

import random

import pytest

from pointweave.operators.nearest import nearest


def points(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "frame int, id long, x long, y long, z long, d2 string")


@pytest.mark.parametrize("width", [3, 100, 50_000])
def test_nearest_equals_all_pairs(spark, width):
    r = random.Random(width)
    cloud = lambda n, start: [(k % 3, start + k, *(r.randint(-400, 400) for _ in "xyz")) for k in range(n)]
    left, right = cloud(300, 0), cloud(250, 1000)
    left += [(0, 900, 10**6, -(10**6), 0), (1, 901, None, 0, 0), (7, 902, 0, 0, 0), (2, 903, *right[2][2:])]  # far away, nowhere, alone, on a point
    right += [(0, 2000, *right[0][2:]), (0, 500, *right[0][2:]), (2, 2001, 5, None, 5), (8, 2002, 1, 1, 1)]
    got = sorted(tuple(x) for x in nearest(points(spark, left), points(spark, right), ("frame",), width).collect())
    want = []
    for f, i, *p in left:
        near = [(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), j) for g, j, *q in right if g == f and None not in p and None not in q]
        if near:
            d2, j = min(near)
            want.append((f, i, j, d2))
    assert got == sorted(want)


def test_nearest_of_nothing(spark):
    some, none = points(spark, [(0, 1, 2, 3, 4)]), points(spark, [])
    assert nearest(some, none, ("frame",)).count() == nearest(none, some, ("frame",)).count() == nearest(some, none).count() == 0
    assert [tuple(r) for r in nearest(some, some.withColumn("id", some.id + 1)).collect()] == [(1, 2, 0)]


@pytest.mark.parametrize("limit", [0, 200])
def test_groups_beyond_a_task_and_both_ways(spark, monkeypatch, limit):
    from pointweave.operators import nearest as N

    r = random.Random(5)
    cloud = lambda n, start: [(min(k % 9, 3), start + k, *(r.choice([r.randint(-9, 9), r.randint(-900, 900)]) for _ in "xyz")) for k in range(n)]
    left, right = cloud(300, 0), cloud(270, 1000)
    right += [(3, 3000 + k, 7, 7, 7) for k in range(300)]  # over a leaf in one place
    asked = []
    levels = N.by_levels
    monkeypatch.setattr(N, "by_levels", lambda *a, **k: asked.append(1) or levels(*a, **k))
    monkeypatch.setattr(N, "IN_TASK", limit)
    got = sorted(tuple(x) for x in N.nearest(points(spark, left), points(spark, right), ("frame",), 50, both=True).collect())
    want = []
    for back, (a, b) in ((False, (left, right)), (True, (right, left))):
        for f, i, *p in a:
            d2, j = min((sum((u - v) ** 2 for u, v in zip(p, q, strict=True)), j) for g, j, *q in b if g == f)
            want.append((f, i, j, d2, back))
    assert got == sorted(want) and len(asked) == 2
