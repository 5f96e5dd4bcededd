"""Golden micro-fixtures: ties, boundaries, resets, and rejections."""

import base64
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointweave.functions import arrays as A
from pointweave.functions import geometry as G
from pointweave.operators import clusters, filters, fusion, joins, ordered, scoring, selection, solvers
from pointweave.operators.consistency import ConsistencyRules, consistent
from pointweave.sources import readers, sinks
from pointweave.streaming import machines


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_voxel_key_below_zero_and_out_of_range(spark):
    df = spark.createDataFrame([(-0.01, -2.0, 1.99), (0.0, 2.0, -2.01)], "x double, y double, z double")
    key = G.voxel_key(F.col("x"), F.col("y"), F.col("z"), 1)
    assert [tuple(r) for r in df.select(*G.decode_key(key)).collect()] == [(-1, -2, 1), (0, 2, -3)]
    far = spark.createDataFrame([(2.0**21, 0.0, 0.0)], "x double, y double, z double")
    with pytest.raises(Exception, match="range"):
        far.select(G.checked_voxel_key(F.col("x"), F.col("y"), F.col("z"), 1)).collect()


def test_tile_map_counts_and_ties(spark):
    c = spark.createDataFrame([(0, 0, 0, 0, 5, 10, 35, 2), (0, 0, 0, 0, 5, 11, 50, 1), (0, 0, 0, 1, 5, 11, 25, 1), (0, 0, 0, 0, 9, 12, 50, 1), (0, 0, 0, 0, 9, 11, 50, 1)], "tx int, ty int, tz int, stamp int, cell long, label int, w long, n long")
    found = rows(fusion.tile_map(c), "cell", "label", "confidence", "point_count", "keyframe_count")
    assert [(r[0], r[1], round(r[2], 4), r[3], r[4]) for r in found] == [(5, 11, round(75 / 110, 4), 4, 2), (9, 11, 0.5, 2, 1)]


def test_reversible_map_equals_rebuild(spark):
    rng = np.random.default_rng(8147)
    schema = "tx long, ty long, tz long, stamp int, cell long, label int, w long"

    def packets(shift):
        return spark.createDataFrame([(int(x), 0, 0, int(s), int(c), int(k), int(w)) for x, s, c, k, w in zip(rng0 % 3 + shift * (stamps == 2), stamps, cells, labels, weights, strict=True)], schema)

    rng0, stamps, cells, labels, weights = rng.integers(0, 9, 300), rng.integers(0, 5, 300), rng.integers(0, 20, 300), rng.integers(0, 4, 300), rng.integers(1, 9, 300)
    old, new = (fusion.contributions(packets(k), [3], 2) for k in (0, 1))
    now = fusion.refreshed_map(fusion.tile_map(old), new, fusion.revised_tiles(old, new))
    assert rows(now, *now.columns) == rows(fusion.tile_map(new), *now.columns)
    assert fusion.revised_tiles(old, old).count() == 0


def test_abstention_conventions(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, -1), (2, 2), (-1, 0)], "gt int, pred int")
    c = scoring.confusion(df)
    s = scoring.summary(c).first()
    assert (s.evaluated, s.coverage, s.acc_answered, s.acc_strict) == (5, 0.8, 0.75, 0.6)
    strict = {r.cls: r.iou for r in scoring.class_scores(c, 3).collect()}
    loose = {r.cls: r.iou for r in scoring.class_scores(c, 3, strict=False).collect()}
    assert (round(strict[1], 4), loose[1]) == (0.3333, 0.5)
    unmapped = scoring.confusion(spark.createDataFrame([(4, 4)] * 3 + [(4, -2)], "gt int, pred int"))
    assert scoring.summary(unmapped).first().acc_answered == 0.75


def test_bracket_closed_at_the_end_and_clamped(spark):
    poses = spark.createDataFrame([(1, 0, 0), (1, 10, 100), (1, 25, 50)], "k int, t long, v long")
    q = spark.createDataFrame([(1, 0), (1, 10), (1, 25), (1, 26), (1, -1)], "k int, at long")
    found = {r["at"]: (r.t0, r.t1) for r in joins.bracket(q, poses, "at", ["k"], 7).collect()}
    assert found == {0: (0, 10), 10: (10, 25), 25: (10, 25), 26: (None, None), -1: (None, None)}
    assert sorted(r["at"] for r in joins.bracket(q, poses, "at", ["k"], 7, clamp=True).collect()) == [0, 0, 10, 25, 25]


def test_nearest_takes_the_earliest_on_ties(spark):
    left = spark.createDataFrame([(1, 100), (2, 500)], "id int, a long")
    right = spark.createDataFrame([(90,), (110,), (441,)], "b long")
    one = lambda d: d.withColumn("k", F.lit(0))
    assert rows(joins.nearest(one(left), one(right), ["k"], "id", "a", "b", 60), "id", "b") == [(1, 90), (2, 441)]


def test_latest_before_is_causal_and_bounded(spark):
    left = spark.createDataFrame([(1, 99), (1, 110), (1, 121)], "k int, t long")
    right = spark.createDataFrame([(1, 100, 7)], "k int, t long, v int")
    assert rows(joins.latest_before(left, right, ["k"], "t", "v", 20).fillna(-1), "t", "v") == [(99, -1), (110, 7), (121, -1)]


def test_delivery(spark):
    p = spark.createDataFrame([(1, "h", 20), (2, "h", 10), (3, "g", 5)], "id long, hash string, ready long")
    r = spark.createDataFrame([("h", 30), ("h", 11), ("g", 4)], "hash string, received long")
    assert rows(joins.delivery(p, r), "id", "received") == [(1, 30), (2, 11)]


def test_reciprocal_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(-40, 40, (80, 3)), rng.integers(-40, 40, (80, 3))

    def cloud(p):
        df = spark.createDataFrame([(k, *map(int, v)) for k, v in enumerate(p)], "id long, x long, y long, z long")
        return df.withColumn("key", G.voxel_key(F.col("x"), F.col("y"), F.col("z"), 12))

    d = ((a[:, None] - b[None]) ** 2).sum(-1)
    want = [(i, int(d[i].argmin())) for i in range(80) if d[i].min() <= 144 and d[:, d[i].argmin()].argmin() == i]
    assert rows(joins.reciprocal(cloud(a), cloud(b), 144), "id_a", "id_b") == want


def test_z_buffer_hides_the_far_point(spark):
    px = spark.createDataFrame([(0, 1, 5, 5, 5), (0, 2, 5, 5, 10), (0, 3, 9, 5, 50)], "frame int, id int, u long, v long, z long")
    assert rows(joins.z_buffer(px, 1, 1), "id", "visible", "edge") == [(1, True, True), (2, False, True), (3, True, False)]


def boxes_of(spark, *boxes):
    names = "frame int, box int, label int, annotated int, cx double, cy double, cz double, qw double, qx double, qy double, qz double, length double, width double, height double"
    return spark.createDataFrame(list(boxes), names)


def test_points_in_a_turned_box(spark):
    """A box of width 2, length 8 and height 2, turned by a right angle: seven points along y lie in it, one beside it does not."""
    at = [(10.0, 17.0 + k) for k in range(7)] + [(13.0, 20.0)]
    p = spark.createDataFrame([(0, k, x, y, 0.0, 5) for k, (x, y) in enumerate(at)], "frame int, id int, x double, y double, z double, cls int")
    half = 0.5**0.5
    box = (0, 7, 5, 9, 10.0, 20.0, 0.0, half, 0.0, 0.0, half, 8.0, 2.0, 2.0)
    owned = joins.points_in_boxes(p, boxes_of(spark, box), 3, 1e-5)
    assert rows(owned.fillna(-9), "id", "owner") == [(k, 7) for k in range(7)] + [(7, -9)]
    assert rows(joins.box_groups(owned), "frame", "owner", "n") == [(0, 7, 7)]
    doubled = joins.points_in_boxes(p, boxes_of(spark, box, (0, 8, *box[2:])), 3, 1e-5)
    assert rows(doubled.fillna(-9), "id", "owner") == [(k, -2) for k in range(7)] + [(7, -9)] and joins.box_groups(doubled).count() == 0
    for other in ((0, 7, 4, *box[3:]), (0, 7, 5, 4, *box[4:]), (1, *box[1:])):  # another label, too few annotated points, another frame
        assert joins.points_in_boxes(p, boxes_of(spark, other), 3, 1e-5).where("owner IS NOT NULL").count() == 0


def test_episodes(spark):
    df = spark.createDataFrame([(0, f, f * 5, ok) for f, ok in ((0, False), (1, True), (3, False), (4, False))], "k int, frame int, stamp long, ok boolean")
    found = rows(ordered.episodes(df, ["k"], "frame", "stamp", "ok").fillna(-1), "start", "length", "recovered", "first_observed", "reappearance", "censored")
    assert found == [(0, 1, 5, True, False, False), (15, 2, -1, False, True, True)]


def test_carried_sign_equals_the_loop(spark):
    rng = np.random.default_rng(1)
    q = rng.integers(-2, 3, (300, 2))
    sign, want = 1, [1]
    for i in range(1, len(q)):
        raw = int(q[i] @ q[i - 1])
        sign = 1 if raw == 0 else (-sign if raw < 0 else sign)
        want.append(sign)
    df = spark.createDataFrame([(0, i, int(a), int(b)) for i, (a, b) in enumerate(q)], "k int, i int, a int, b int")
    assert [s for _, s in rows(ordered.carried_sign(df, ["k"], "i", ["a", "b"]), "i", "sign")] == want


def test_even_sample_and_resample(spark):
    df = spark.range(250).withColumn("k", F.lit(0))
    assert rows(selection.evenly(df, ["k"], ["id"], 100), "id") == sorted({(j * 250 // 100,) for j in range(100)})
    w = spark.createDataFrame([(0, 1, 0), (0, 2, 3), (0, 3, 1)], "k int, id int, w long")
    d = spark.createDataFrame([(0, n, u) for n, u in enumerate((0.0, 0.5, 0.74, 0.75, 0.99))], "k int, draw int, u double")
    assert [r[1] for r in rows(selection.weighted_resample(w, ["k"], "id", "w", d), "draw", "id")] == [2, 2, 2, 3, 3]


def test_arrays(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.5], [0.2, 0.5, 0.3])], "p array<double>, q array<double>")
    p, q = F.col("p"), F.col("q")
    r = df.select(A.argmax(p).alias("a"), A.margin(q).alias("m"), A.hellinger(q, q).alias("h"), A.kl_divergence(q, q).alias("k"), A.marginal(q, [[0, 1]]).alias("g"), A.softmax(p).alias("s")).first()
    assert (r.a, round(r.m, 9), round(r.h, 6), r.k, r.g) == (1, 0.2, 0.0, 0.0, [0.7])
    assert abs(sum(r.s) - 1) < 1e-12


def test_consistency_flips_weak_static_points(spark):
    def posterior(pairs):
        p = [0.0] * 16
        for k, v in pairs:
            p[k] = v
        p[0] += 1 - sum(p)
        return p

    data = [(0, 0, 0.0, k, 5.0, k * 0.1, 0.0, posterior([(10, 0.99)])) for k in range(3)]
    data += [(0, 1, 0.5, k, 5.0, k * 0.1, 0.0, posterior([(12, 0.40), (10, 0.38)])) for k in range(3)]
    data += [(0, 2, 1.0, k, 5.0, k * 0.1, 0.0, posterior([(12, 0.40), (10, 0.38)])) for k in range(3)]
    df = spark.createDataFrame(data, "stream int, frame int, stamp double, pt int, x double, y double, z double, p array<double>")
    found = rows(consistent(df, ConsistencyRules()), "frame", "pt", "label")
    # Frame 2 sees frame 1's raw, weak posteriors, not its enhanced labels.
    assert [label for _, _, label in found] == [10] * 6 + [12] * 3


def test_clusters_and_surfaces(spark):
    cells = [(0, 0, 0), (1, 1, 1), (2, 1, 1), (9, 9, 9), (9, 10, 9), (-5, 0, 0)]
    df = spark.createDataFrame([(0, float(x), float(y), float(z)) for x, y, z in cells], "k int, x double, y double, z double").withColumn("key", G.voxel_key(F.col("x"), F.col("y"), F.col("z"), 1))
    sizes = clusters.cluster_sizes(clusters.connected_cells(df, ["k"]), ["k"], 1)
    assert rows(sizes, "cells") == [(1,), (2,), (3,)]
    pts = [(0, i, 5.0, 0.1 * i, 0.0) for i in range(8)] + [(0, 8, 9.0, 9.0, 9.0)] + [(1, i, 5.0 + 3 * i, 0.0, 0.0) for i in range(8)]
    s = clusters.main_surface(spark.createDataFrame(pts, "k int, id int, x double, y double, z double"), ["k"], "id")
    assert rows(s, "k", "id") == [(0, i) for i in range(8)]


def test_solvers(spark):
    c, s = np.cos(0.7), np.sin(0.7)
    a = np.random.default_rng(2).normal(size=(50, 3))
    b = a @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T + [3, -2, 1]
    df = spark.createDataFrame([(0, i, *map(float, x), *map(float, y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "track int, t int, ax double, ay double, az double, bx double, by double, bz double")
    assert solvers.trajectory_error(df).first().ate < 1e-9
    m = np.cov(a.T)
    e = spark.range(1).select(*solvers.eigenvalues({f"c{'xyz'[i]}{'xyz'[j]}": F.lit(float(m[i, j])) for i in range(3) for j in range(i, 3)})).first()
    assert np.allclose(e, np.sort(np.linalg.eigvalsh(m))[::-1])
    edges = [(k, k + 1, np.array([1.0, 0, 0]), 1.0) for k in range(3)] + [(0, 3, np.zeros(3), 100.0)]
    p = solvers.pose_graph(4, edges, np.array([[0, 0, 0], [1, 0, 0], [2, 0, 0], [3.0, 0, 0]]))
    assert abs(p[3, 0]) < 0.3 and (p[0] == 0).all()
    ends = solvers.principal_extents(spark.createDataFrame([(0, 3 * i, 4 * i, 0) for i in range(11)], "k int, x_mm long, y_mm long, z_mm long"), ["k"]).first()
    assert abs(ends.extent - 50) < 1e-6


def test_machines():
    pair = machines.Pairing("k", 2)
    out = [pair.step({"k": 0, "stamp": s, "kind": kind}) for s, kind in ((1, "a"), (2, "a"), (2, "b"), (3, "a"), (4, "a"), (1, "b"))]
    assert [o and o["stamp"] for o in out] == [None, None, 2, None, None, None] and pair.evicted == 2
    claim = machines.Claims("k", 2)
    steps = [("graph", 0), ("packet", 1), ("packet", 2), ("graph", 1), ("packet", 3), ("packet", 4), ("graph", 9)]
    out = [o for kind, s in steps if (o := claim.step({"k": 0, "kind": kind, "stamp": s}))]
    assert [c for o in out for c in o["claimed"]] == [1, 3, 4] and [e for o in out for e in o["evicted"]] == [2]
    rev = machines.Revisions("k")
    assert [rev.step({"k": 0, "version": v, "times": t})["accepted"] for v, t in ((0, [1]), (1, [1, 11]), (1, [1, 11]), (2, [1, 11]))] == [True, True, False, False]
    ses = machines.Sessions("k")
    assert [ses.step({"k": 0, "event_id": 0, "session": s})["accepted"] for s in "abab"] == [True, True, False, True]
    kf = machines.Keyframes("k", 10, 2)
    assert [kf.step({"k": 0, "t_us": t})["status"] for t in (0, 5, 5, 3, 10, 30)] == ["accepted", "insufficient", "duplicate", "nonmonotonic", "accepted", "capacity"]
    led = machines.Ledger("k", 3, 10)
    assert [led.step({"k": 0, "event_id": 0, "t_us": t, "label": v})["evidence"] for t, v in ((0, 1), (10, 1), (21, 2))] == [0, 1, 0]
    ins = machines.Instances("k")
    obs = lambda t, x, p: ins.step({"k": 0, "session": "s", "track": 7, "t": t, "x": x, "p": p})
    assert obs(0.0, 0.0, [0.9, 0.05, 0.05])["label"] == 0
    assert (r := obs(0.5, 0.1, [0.45, 0.5, 0.05]))["label"] == 0 and r["reason"] == "accepted"
    assert obs(1.0, 0.2, [0.02, 0.95, 0.03])["reason"] == "reset"
    assert (r := obs(1.5, 9.0, [0.9, 0.05, 0.05]))["reason"] == "motion" and r["epoch"] == 2


def test_readers_and_sinks(spark, tmp_path):
    xyz = np.arange(8, dtype="<f4").reshape(2, 4)
    (tmp_path / "000003.bin").write_bytes(xyz.tobytes())
    (tmp_path / "000003.label").write_bytes(np.array([(7 << 16) | 10, 40], "<u4").tobytes())
    scans, words = readers.scans(spark, str(tmp_path)), readers.labels(spark, str(tmp_path))
    assert rows(readers.labelled_scans(scans, words), "frame", "pt", "x", "semantic", "instance") == [(3, 0, 0.0, 10, 7), (3, 1, 4.0, 40, 0)]
    (tmp_path / "000004.bin").write_bytes(b"12345")
    with pytest.raises(Exception, match="whole records"):
        readers.scans(spark, str(tmp_path)).collect()
    (tmp_path / "traj.txt").write_text("# comment\n1.5 0 0 0 0 0 0 2\n0.5 1 1 1 0 0 0 -1\n")
    assert rows(readers.trajectory(spark, str(tmp_path / "traj.txt")), "t", "qw") == [(0.5, -1.0), (1.5, -1.0)]
    (tmp_path / "calib.txt").write_text("calib_time: 09-Jan\nP0: 1.0 2e0 3\n")
    assert rows(readers.calibration(spark, str(tmp_path / "calib.txt")), "key", "value") == [("P0", [1.0, 2.0, 3.0])]
    (tmp_path / "a.json").write_text('[{"s": "} , ["}, {"s": "x"}]')
    assert readers.json_records(spark, str(tmp_path / "a.json"), "s string").count() == 2
    (tmp_path / "b.json").write_text('[{"s": "} , ["}, {"s": ')
    with pytest.raises(Exception):
        readers.json_records(spark, str(tmp_path / "b.json"), "s string").collect()
    cloud = np.zeros(2, [("x", ">f4"), ("y", ">f4"), ("z", ">f4"), ("pad", "V6")])
    cloud["x"] = (1, 2)
    message = [(5, 1, 2, 18, 20, True, 0, 4, 8, b"".join(c.tobytes() + b"\0\0" for c in cloud))]
    layout = "stamp_ns long, width int, height int, point_step int, row_step int, big_endian boolean, ox int, oy int, oz int, data binary"
    assert rows(readers.point_clouds(spark.createDataFrame(message, layout)), "stamp_ns", "pt", "x") == [(5, 0, 1.0), (5, 1, 2.0)]
    packet = {"ids": [1, 2], "session": "a"}
    assert sinks.decode_packet(sinks.encode_packet(packet), set(packet)) == packet
    with pytest.raises(ValueError):
        sinks.decode_packet(base64.b64encode(zlib.compress(b" " * 5000)).decode(), set(packet), most=100)
    with pytest.raises(Exception, match="NaN"):
        sinks.json_report(spark.createDataFrame([(float("nan"),)], "v double")).collect()
    with pytest.raises(Exception, match="positive"):
        readers.validated(spark.createDataFrame([(-1,)], "v int"), {"positive": F.col("v") > 0}).collect()
    with pytest.raises(ValueError):
        filters.compiled({"nope": True}, {})
    assert readers.frame_list("2:9:3", spark.range(12).withColumnRenamed("id", "frame")).count() == 3
    rec = sinks.cloud_records(spark.createDataFrame(pd.DataFrame({"frame": [0], "pt": [0], "x": [1.0], "y": [2.0], "z": [3.0], "rgb": [255], "cls": [4], "conf": [0.5], "has": [1]}))).first()
    assert rec.n == 1 and len(rec.data) == 28
