"""Association, memory, carving, records, readers, writers and streams against plain Python on small scenes."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from pointweave.functions import geometry as G
from pointweave.operators import carving, joins, memory, records, tables
from pointweave.sources import readers, sinks
from pointweave.streaming import machines, runs


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_gated_association_equals_brute_force(spark):
    rng = random.Random(4)
    at = lambda: tuple(rng.randint(-60, 60) for _ in range(3))
    now, past = [(f, 1000 * f + k, *at()) for f in (1, 2) for k in range(70)], [(f, 1000 * f + 500 + k, *at()) for f in (1, 2) for k in range(70)]
    shift = {1: (3, -4, 1), 2: (0, 5, -2)}
    schema = "frame int, id long, x long, y long, z long"
    relative = spark.createDataFrame([(f, 0, -1, 0, 1, 0, 0, 0, 0, 1, *t) for f, t in shift.items()], "frame int, " + ", ".join(f"r{i}{j} long" for i in (1, 2, 3) for j in (1, 2, 3)) + ", tx long, ty long, tz long")
    key = lambda d: d.withColumn("key", G.voxel_key(F.col("x"), F.col("y"), F.col("z"), 25))
    found = joins.associate(key(spark.createDataFrame(now, schema)), key(joins.moved(spark.createDataFrame(past, schema), relative)), 625, 6)
    want = []
    for f in (1, 2):
        a = [(r[1], r[2:]) for r in now if r[0] == f]
        b = [(r[1], (-r[3] + shift[f][0], r[2] + shift[f][1], r[4] + shift[f][2])) for r in past if r[0] == f]
        d2 = lambda p, q: sum((u - v) ** 2 for u, v in zip(p, q, strict=True))
        for i, p in a:
            best, j, q = min((d2(p, q), j, q) for j, q in b)
            if best > 625 or min((d2(p2, q), i2) for i2, p2 in a)[1] != i:
                continue
            delta, rays = [u - v for u, v in zip(p, q, strict=True)], (p, [u - v for u, v in zip(q, shift[f], strict=True)])
            if all(math.hypot(*r) > 1e-6 and abs(sum(u * v for u, v in zip(delta, r, strict=True))) <= 6 * math.hypot(*r) for r in rays):
                want.append((i, j, best))
    assert rows(found, "id_a", "id_b", "d2") == sorted(want) and len(want) > 5


def test_memory_equals_a_plain_ledger(spark):
    rng = random.Random(5)
    pts = [(f, 100 * f + k, rng.randint(0, 60), rng.randint(0, 20), 0) for f in range(8) for k in range(25)]
    df = spark.createDataFrame(pts, "frame int, id long, x long, y long, z long")
    rec = memory.records(df, 10, ["id"], ["id", "x", "y", "z"])
    found = rows(memory.retrieved(rec, memory.alive(rec, 3, 4), 150, 2), "id_a", "id_b")
    held, want = {}, []
    for f in range(8):
        new = {}
        for _, i, x, y, z in sorted(p for p in pts if p[0] == f):
            new.setdefault((x // 10, y // 10), (f, i, x, y))
        for (cx, cy), (_, i, x, y) in new.items():
            near = [((x - u) ** 2 + (y - v) ** 2, j) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for g, j, u, v in held.get((cx + dx, cy + dy), []) if f - g <= 4]
            want += [(i, j) for d, j in sorted(near)[:2] if d <= 150]
        for cell, r in new.items():  # the newest first, three at most
            held[cell] = [r, *held.get(cell, [])][:3]
    assert found == sorted(want) and len(want) > 50


def test_carving_equals_a_plain_loop(spark):
    rng = random.Random(6)
    image = carving.SweepImage(columns=24, rows=8, low=-0.6, span=1.2, least=2.0, most=60.0, margin=3.0, dilate=1)
    cand = [(k, *(float(rng.randint(-80, 80)) for _ in range(2)), float(rng.randint(-10, 10))) for k in range(150)]
    origin = {(f, b): (10.0 * f + b, -5.0 * f, 0.0, 0.6, 0.8) for f in range(3) for b in range(4)}
    raw = [(f, *(float(rng.randint(-50, 50)) for _ in range(2)), float(rng.randint(-15, 15))) for f in range(3) for _ in range(120)]

    def cell(x, y, z):
        r = math.sqrt(x * x + y * y + z * z)
        return r, math.floor((z / max(r, 1e-3) + 0.6) * (8 / 1.2)), min(math.floor((math.atan2(y, x) + carving.PI) * (24 / (2 * carving.PI))), 23)

    images = {}
    for f, x, y, z in raw:
        r, row, col = cell(x, y, z)
        if 0 <= row < 8:
            images[f, row, col] = min(r, images.get((f, row, col), math.inf))
    want, votes = set(), {}
    for f in range(3):
        for k, x, y, z in cand:
            ox, oy, oz, c, s = origin[f, 2]
            if max(abs(x - ox), abs(y - oy), abs(z - oz)) >= 60:
                continue
            b = min(math.floor((math.atan2(c * (y - oy) - s * (x - ox), c * (x - ox) + s * (y - oy)) + carving.PI) * (4 / (2 * carving.PI))), 3)
            ox, oy, oz, c, s = origin[f, b]
            r, row, col = cell(c * (x - ox) + s * (y - oy), c * (y - oy) - s * (x - ox), z - oz)
            here = images.get((f, row, col))
            if not 2 <= r <= 60 or here is None:
                continue
            near = min(v for i in (-1, 0, 1) for j in (-1, 0, 1) if (v := images.get((f, row + i, (col + j) % 24))) is not None)
            free, seen = near > r + 3, abs(here - r) <= 3
            want.add((f, k, free, seen))
            n = votes.setdefault(k, [0, 0, 0])
            n[0] = 0 if seen else n[0] + free
            n[1], n[2] = n[1] + seen, n[2] + 1
    looks = carving.carve(
        spark.createDataFrame(cand, "key int, x double, y double, z double"),
        spark.createDataFrame([(*k, *v) for k, v in origin.items()], "frame int, bin int, ox double, oy double, oz double, cos double, sin double"),
        carving.sweep_image(spark.createDataFrame(raw, "frame int, x double, y double, z double"), image),
        image,
        4,
    )
    assert set(rows(looks, "frame", "key", "free", "seen")) == want and sum(w[2] for w in want) > 5 and sum(w[3] for w in want) > 5
    assert rows(carving.carve_votes(looks, True), "key", "n_free", "n_seen", "n_tested") == sorted((k, *n) for k, n in votes.items())


def test_records(spark):
    texts = ['{"k": 1, "r": 2.5}', '{"k": 1, "k": 2}', '{"k": NaN}', "[1]", '{"k": 1', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    assert rows(df.select("id", records.strict_json(F.col("t"), "k long, r double")["k"].alias("k")).where("k IS NOT NULL"), "id", "k") == [(0, 1)]
    deep = ['{"k": 1, "o": {"a": 1}}', '{"k": 1, "o": {"a": 1, "a": 2}}', '{"k": 1, "o": [{"b": {"a": 1, "a": 1}}]}', '{"k": 1, "o": {"x": NaN}}', '[1]', '{"k": 1} x', '{"k": 1}, {"k": 2}', '{"k": 1}]', None, ""]
    deep = spark.createDataFrame(list(enumerate(deep)), "id int, t string")
    assert rows(deep.select("id", records.strict_json(F.col("t"), "k long")["k"].alias("k")).where("k IS NOT NULL"), "id", "k") == [(0, 1)]
    q = spark.createDataFrame([(1, 0.5**0.5, 0.0, 0.0, 0.5**0.5), (2, 1.0, 1.0, 0.0, 0.0), (3, float("nan"), 0.0, 0.0, 0.0)], "id int, w double, x double, y double, z double")
    got = {r.id: r for r in q.withColumns(records.transform_of({c: F.col(c) for c in "wxyz"})).collect()}
    assert got[1].valid and abs(got[1].r12 + 1) < 1e-12 and abs(got[1].r21 - 1) < 1e-12 and not got[2].valid and not got[3].valid and got[2].r11 is None
    raw = spark.createDataFrame([(0, 4), (0, 5), (0, 9), (1, 5)], "drive int, index int")
    registry = spark.createDataFrame([(0, "a", 5, 6), (0, "b", 8, 20)], "drive int, sequence string, first int, last int")
    assert rows(records.aligned(raw, registry), "index", "sequence", "frame") == [(5, "a", 0), (9, "b", 1)]
    keys = records.ravel_keys(spark.createDataFrame([(0, -5, 0, 0), (0, 5, 12, 0), (0, 5, 12, 3)], "frame int, x int, y int, z int"), 10, ["frame"])
    assert rows(keys, "x", "key") == [(-5, 0), (5, 3), (5, 3)]


def test_remaining_readers_and_writers(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# t\n2 0 0 0 0 0 0 -2\n1 0 0 0 0 0 0 1\n3 0 0 0 0 0 0 1\n")
    assert rows(readers.trajectory(spark, str(tmp_path / "t.txt"), 1.5), "t", "qw") == [(2.0, -1.0), (3.0, -1.0)]
    (tmp_path / "imu.txt").write_text(" ".join(str(k) for k in range(30)) + "\n")
    assert rows(readers.inertial(spark, str(tmp_path / "imu.txt")), "c0", "c29") == [(0.0, 29.0)]
    (tmp_path / "a.jsonl").write_text('{"s": "x"}\n{"s": "y"}\n')
    assert rows(readers.json_lines(spark, str(tmp_path / "a.jsonl"), "s string"), "s") == [("x",), ("y",)]
    (tmp_path / "log.csv").write_text("a,b\n1,x\n2,y\n")
    assert rows(readers.csv_log(spark, str(tmp_path / "log.csv"), "a int, b string"), "a", "b") == [(1, "x"), (2, "y")]
    shuffled = spark.createDataFrame([(0, 0, 2, "c"), (0, 1, 0, "a"), (0, 2, 1, "b")], "frame int, pt int, order int, label string")
    assert rows(readers.restored_order(shuffled), "pt", "label") == [(0, "a"), (1, "b"), (2, "c")]

    voxels, votes = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "key int, cls int"), spark.createDataFrame([(2, 4), (3, 1)], "key int, n_free int")
    sinks.write_map(voxels, votes, str(tmp_path / "map"), 3)
    assert rows(spark.read.parquet(str(tmp_path / "map/raw")), "key") == [(1,), (2,), (3,)]
    assert rows(spark.read.parquet(str(tmp_path / "map/map")), "key") == [(1,), (3,)]
    masks = spark.createDataFrame([(0, 1, 1, 9), (1, 2, 2, 8)], "frame int, u int, v int, id int")
    sinks.write_masks(masks, str(tmp_path / "masks"))
    assert rows(spark.read.parquet(str(tmp_path / "masks")).where("frame = 1"), "u", "id") == [(2, 8)]
    sinks.write_topics({"/lidar/points": voxels, "/pose": votes}, str(tmp_path / "bag"))
    assert rows(spark.read.parquet(str(tmp_path / "bag/lidar__points")), "key") == [(1,), (2,), (3,)]
    sinks.write_features(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "log string, f double"), str(tmp_path / "cache"))
    assert rows(spark.read.parquet(str(tmp_path / "cache/counts")), "log", "n") == [("a", 2), ("b", 1)]
    with pytest.raises(Exception, match="exists"):
        sinks.write_masks(masks, str(tmp_path / "masks"))
    assert json.loads(sinks.json_report(spark.createDataFrame([(1, 2.5)], "a int, b double")).first().value) == {"a": 1, "b": 2.5}


def test_shared_folder_is_asked_for_on_clusters(spark, monkeypatch):
    class Conf:
        def __init__(self, master):
            self.values = {"spark.master": master}

        def get(self, name, default=None):
            return self.values.get(name, default)

        def set(self, name, value):
            self.values[name] = value

    class Session:
        def __init__(self, master):
            self.conf = Conf(master)

    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            tables.shared_folder(Session(master))
    local = Session("local[4]")
    assert tables.shared_folder(local).startswith("file:///") and tables.shared_folder(local) == local.conf.get("spark.checkpoint.dir")
    kept = tables.stored(spark.range(3), "three")
    assert kept.count() == 3
    tables.release(kept)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(kept.stored_path).count()


def test_pose_graphs_close_loops_and_keep_raw_odometry(spark):
    from pointweave.operators import solvers

    turn = math.pi / 2
    square = [(k, k + 1, 1.0, 0.0, turn + 0.05, 1.0) for k in range(8)]  # a square walked twice, turning a little too far
    loops = [(0, 4, 0.0, 0.0, 0.0, 100.0), (0, 8, 0.0, 0.0, 0.0, 100.0)]
    schema = "log int, i int, j int, x double, y double, angle double, weight double"
    edges = spark.createDataFrame([(0, *e) for e in square + loops] + [(1, *e) for e in square], schema)
    found = {(r.log, r.version): r for r in solvers.graph_corrections(edges, ["log"]).collect()}
    assert set(found) == {(0, 0), (0, 1), (0, 2), (1, 0)}
    assert all(found[k].dx == found[k].dy == found[k].da == 0 for k in ((0, 0), (1, 0)))
    for version, node in ((1, 4), (2, 8)):
        r = found[0, version]
        assert r.node == node and math.hypot(r.x, r.y) < 0.05
        raw = solvers.chained([[1.0, 0.0, turn + 0.05]] * node)[-1]
        c, s = math.cos(r.da), math.sin(r.da)
        assert abs(r.dx + c * raw[0] - s * raw[1] - r.x) < 1e-9 and abs(r.dy + s * raw[0] + c * raw[1] - r.y) < 1e-9 and abs(r.da + raw[2] - r.angle) < 1e-9
    with pytest.raises(Exception, match="split logs"):
        solvers.graph_corrections(edges, ["log"], most=5).collect()


def test_queue_and_throttle():
    queue = machines.BoundedQueue("k", 1)
    got = [queue.step({"k": 0, "event_id": i, "t_us": t, "cost": 10}) for i, t in enumerate([0, 1, 2, 10, 11, 12, 40])]
    assert [(r["served"], r["wait"], r["dropped"]) for r in got] == [(True, 0, 0), (True, 9, 0), (False, None, 1), (True, 10, 1), (False, None, 2), (False, None, 3), (True, 0, 3)]
    throttle = machines.Throttle("k", 2, 5, 30)
    assert [throttle.step({"k": 0, "event_id": 0, "t_us": t, "cost": c})["published"] for t, c in [(0, 1), (4, 1), (5, 10), (20, 1), (25, 100), (54, 1), (55, 1)]] == [True, False, True, False, True, False, True]


def test_consistency_follows_the_sensor_and_its_rays(spark):
    from pointweave.operators.consistency import ConsistencyRules, consistent

    p = lambda k, top: [top if c == k else (1 - top) / 15 for c in range(16)]
    # The sensor moves by one along x, so what stood at x + 1 is now at x; the last point is nearer along its ray by 0.2.
    before = [(0, 0, 0.0, i, 6.0, float(i), 0.0, p(10, 0.99)) for i in range(3)]
    after = [(0, 1, 0.5, i, 5.0 - (0.2 if i == 2 else 0.0), float(i), 0.0, p(12, 0.4)) for i in range(3)]
    df = spark.createDataFrame(before + after, "stream int, frame int, stamp double, pt int, x double, y double, z double, p array<double>")
    move = spark.createDataFrame([(0, 1, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, -1.0, 0.0, 0.0)], "stream int, frame int, " + ", ".join(f"r{i}{j} double" for i in (1, 2, 3) for j in (1, 2, 3)) + ", tx double, ty double, tz double")
    labels = lambda rules, relative: [r.label for r in consistent(df, rules, relative).where("frame = 1").orderBy("pt").collect()]
    assert labels(ConsistencyRules(), None) == [12, 12, 12]
    assert labels(ConsistencyRules(), move) == [10, 10, 10]
    assert labels(ConsistencyRules(radial=0.1), move) == [10, 10, 12]


def test_streams_equal_their_batch_forms(spark):
    from pointweave.plans import QUERIES

    for name in ("packet_claims", "instance_semantics"):
        batch, stream = (sorted(map(str, QUERIES[n](spark, "/root/testdata/sf0.001").collect())) for n in (name, f"stream_{name}"))
        assert batch == stream and batch


def test_stale_packets_are_evicted():
    claims = machines.Claims("k", 10, 100)
    got = [claims.step({"k": 0, "kind": kind, "stamp": stamp}) for kind, stamp in [("packet", 0), ("packet", 50), ("packet", 101), ("graph", 60), ("graph", 500)]]
    assert [(r["claimed"], r["evicted"]) if r else None for r in got] == [None, None, ([], [0]), ([50], []), ([], [101])]
