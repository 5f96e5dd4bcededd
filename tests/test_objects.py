import numpy as np
from pyspark.sql import functions as F

from pointweave.functions import geometry as G
from pointweave.operators import objects, ordered
from pointweave.plans import QUERIES
from pointweave.plans.adapters import ticks
from pointweave.streaming import machines


def test_hilbert_is_a_curve_through_every_cell(spark):
    side = F.sequence(F.lit(0), F.lit(7))
    grid = spark.range(1).select(F.explode(side).alias("x")).select("x", F.explode(side).alias("y")).select("x", "y", F.explode(side).alias("z"))
    cells = {r.c: (r.x, r.y, r.z) for r in grid.withColumn("c", G.hilbert(F.col("x"), F.col("y"), F.col("z"), 3)).collect()}
    assert sorted(cells) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(cells[k], cells[k + 1], strict=True)) == 1 for k in range(511))


def test_greedy_tracks_follow_and_restart(spark):
    d = [(0, 0, 1, 0.0, 0.0), (0, 0, 2, 10.0, 0.0), (0, 1, 1, 9.0, 0.0), (0, 1, 2, 1.0, 0.0), (0, 2, 1, 2.0, 0.0), (0, 4, 1, 2.0, 0.0)]
    found = objects.greedy_tracks(spark.createDataFrame(d, "k int, frame int, id int, x double, y double"), ["k"], 3.0)
    assert sorted((r.frame, r.id, r.track) for r in found.collect()) == [(0, 1, 0), (0, 2, 1), (1, 1, 1), (1, 2, 0), (2, 1, 0), (4, 1, 2)]


def test_registration_recovers_a_motion(spark):
    rng = np.random.default_rng(1)
    p = np.c_[rng.uniform(-4, 4, (300, 2)), np.zeros(300)]
    p[100:200] = p[100:200][:, [0, 2, 1]] + [0, 4, 4]
    p[200:] = p[200:][:, [2, 0, 1]] + [4, 0, 4]
    c, s = np.cos(0.05), np.sin(0.05)
    q = p @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T + [0.2, -0.1, 0.15]
    rows = [(0, k, *map(float, v)) for k, cloud in ((0, p), (1, q)) for v in cloud] + [(1, 0, 0.0, 0.0, 0.0)]
    found = {r.pair: r for r in objects.registered(spark.createDataFrame(rows, "pair long, side int, x double, y double, z double")).collect()}
    assert np.allclose(found[0].shift, [0.2, -0.1, 0.15], atol=1e-3) and found[0].error < 1e-3
    assert found[1].fitness == 0.0


def test_nearest_rotation(spark):
    m = np.eye(3) + 0.01 * np.random.default_rng(2).normal(size=(3, 3))
    r = np.array(spark.createDataFrame([(m.ravel().tolist(),)], "m array<double>").select(objects.nearest_rotation(F.col("m")).alias("r")).first().r).reshape(3, 3)
    assert np.allclose(r @ r.T, np.eye(3)) and np.linalg.det(r) > 0 and np.abs(r - m).max() < 0.05


def test_yaw_search_finds_the_turn(spark):
    rng = np.random.default_rng(3)
    h = rng.integers(1, 9, (60, 20))
    rows = [(0, s, r, int(h[s, r])) for s in range(60) for r in range(20)] + [(1, (s + 13) % 60, r, int(h[s, r])) for s in range(60) for r in range(20)]
    d = spark.createDataFrame(rows, "frame int, sector int, ring int, h long")
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "i int, j int")
    found = {r.j: (round(r.distance, 6), r["shift"]) for r in objects.yaw_distance(d, pairs, 60).collect()}
    assert found[1] == (0.0, 47)


def test_attention_has_explicit_zero_rows(spark):
    q = spark.createDataFrame([(1,), (2,)], "q int")
    p = spark.createDataFrame([(1, 5, 0.0), (1, 6, 0.0)], "q int, k int, s double")
    assert sorted((r.q, r.weight) for r in objects.attention(q, p, "q", F.col("s")).collect()) == [(1, 0.5), (1, 0.5), (2, 0.0)]


def test_every_revision_is_judged_as_by_the_machine(spark):
    rng = np.random.default_rng(5)
    rows, want = [], []
    for user in range(12):
        rev, times = machines.Revisions("user"), []
        for version in range(40):
            old = list(times)
            if user and version == rng.integers(1, 60):  # an old time differs
                old[int(rng.integers(len(old)))] += 1
            time = (times[-1] if times else 0) + (0 if user > 8 and version == 30 else int(rng.integers(1, 9)))
            rows.append((user, version, len(old), sum(old), time))
            want.append((user, version, rev.step({"user": user, "version": version, "times": [*old, time]})["accepted"]))
            times.append(time)
    found = ordered.revisions_accepted(spark.createDataFrame(rows, "user long, version int, n_old long, sum_old long, time long"), ["user"])
    assert sorted((r.user, r.version, r.accepted) for r in found.collect()) == want and not all(a for *_, a in want)


def test_revision_stream_has_every_revision(spark):
    events = "/root/testdata/sf0.001"
    found = QUERIES["revision_stream"](spark, events)
    assert found.count() == ticks(spark, events).count() and found.agg(F.max("version")).first()[0] >= 20
    assert found.where("accepted <> (user_id % 5 <> 0 OR version < 7)").count() == 0
