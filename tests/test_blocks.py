"""Components, surfaces, yaw search, coarsening and pose graphs in tasks against the plain forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.functions import geometry as G
from pointweave.operators import clusters, fusion, joins, objects, solvers


@pytest.mark.parametrize("limit", [0, 60, 1 << 20])
def test_components_do_not_depend_on_where_they_are_found(spark, monkeypatch, limit):
    r = random.Random(limit)
    cells = [(g, *(r.randint(-6, 6) for _ in "xyz")) for g in (1, 1, 1, 2, 3) for _ in range(40)]
    df = spark.createDataFrame(cells, "g int, x long, y long, z long").withColumn("key", G.voxel_key(F.col("x"), F.col("y"), F.col("z"), 1))
    monkeypatch.setattr(clusters, "IN_TASK", limit)
    got = {(x.g, x.key): x.cluster for x in clusters.connected_cells(df.select("g", "key"), ["g"]).collect()}
    keys = {(x.g, x.key): (x.x, x.y, x.z) for x in df.collect()}
    label = {k: k[1] for k in keys}
    while True:
        new = {a: min(label[b] for b, q in keys.items() if b[0] == a[0] and max(abs(u - v) for u, v in zip(p, q, strict=True)) <= 1) for a, p in keys.items()}
        if new == label:
            break
        label = new
    assert got == label


def test_yaws_of_loops_equal_those_of_pairs(spark, monkeypatch):
    r = random.Random(1)
    monkeypatch.setattr(objects, "BLOCK", 7)
    places = [(k, k, r.randint(-60, 60), r.randint(-60, 60)) for k in range(80)]
    heights = [(k, s, q, r.randint(1, 500)) for k in range(80) for s in range(6) for q in range(3) if r.random() < 0.6]
    k, d = spark.createDataFrame(places, "id long, t long, x long, y long"), spark.createDataFrame(heights, "frame long, sector int, ring int, h long")
    want = objects.yaw_distance(d, joins.loop_candidates(k, 30, 3, 900).select("i", "j"), 6)
    got = objects.loop_yaws(k, d, 30, 3, 900, 6)
    rows = sorted(map(tuple, got.select("i", "j", "distance", "shift").collect()))
    assert rows and rows == sorted(map(tuple, want.select("i", "j", "distance", "shift").collect()))


def test_coarser_cells_over_tiles(spark):
    r = random.Random(2)
    cells = {tuple(r.choice([r.randint(-300, 300), r.randint(-3, 3)]) for _ in "xyz") for _ in range(800)}
    df = spark.createDataFrame(sorted(cells), "x long, y long, z long")
    keys = df.select(G.voxel_key(F.col("x"), F.col("y"), F.col("z"), 1).alias("key"))
    got = {x.factor: (x.cells, x.chosen) for x in fusion.coarsened(keys, 200).collect()}
    want = {f: len({tuple(v // f for v in c) for c in cells}) for f in range(1, 65)}
    least = min((f for f, n in want.items() if n <= 200), default=64)
    assert got == {f: (n, f == least) for f, n in want.items()}


def test_pose_graph_reaches_a_minimum():
    r = np.random.default_rng(3)
    steps = np.c_[1 + r.random(29), r.random(29) / 5, (r.random(29) - 0.5)]
    edges = [(k, k + 1, z, 1.0) for k, z in enumerate(steps)] + [(3, 20, np.array([0.5, 0.0, 0.0]), 10.0), (11, 29, np.array([0.2, 0.1, 0.3]), 4.0)]

    def cost(p):
        total = 0.0
        for i, j, z, w in edges:
            c, s = np.cos(p[i, 2]), np.sin(p[i, 2])
            d = p[j, :2] - p[i, :2]
            turn = (p[j, 2] - p[i, 2] - z[2] + np.pi) % (2 * np.pi) - np.pi
            total += w * ((c * d[0] + s * d[1] - z[0]) ** 2 + (-s * d[0] + c * d[1] - z[1]) ** 2 + turn**2)
        return total

    best = solvers.pose_graph(30, edges, solvers.chained(steps), 200)
    least = cost(best)
    assert least < cost(solvers.chained(steps))
    for k in range(3, 90):
        for by in (-1e-4, 1e-4):
            moved = best.copy()
            moved.ravel()[k] += by
            assert cost(moved) >= least - 1e-9
