"""Queries of strict records, registries, keys by extent, subsets and readings of an evaluation, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.functions import geometry as G
from pointweave.operators import ordered, records
from pointweave.operators.fusion import vote_map
from pointweave.operators.tiles import windows
from pointweave.plans.adapters import POINTS, TICKS, key_sql, points, table, ticks
from pointweave.plans.queries import MAP, VOXEL, query


@query(f"""WITH {POINTS}, c AS (SELECT *, CAST(floor(x_mm / 700.0) AS BIGINT) AS x, CAST(floor(y_mm / 700.0) AS BIGINT) AS y, CAST(floor(z_mm / 700.0) AS BIGINT) AS z FROM points),
b AS (SELECT frame, min(x) AS lx, min(y) AS ly, min(z) AS lz, max(y) - min(y) + 1 AS ny, max(z) - min(z) + 1 AS nz FROM c GROUP BY frame) SELECT c.frame, pt, ((x - lx) * ny + (y - ly)) * nz + (z - lz) AS key FROM c JOIN b ON c.frame = b.frame""")
def ravel_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ04: cell keys in the extent of each frame."""
    p = points(spark, sf_dir).select("frame", "pt", *(F.col(f"{a}_mm").alias(a) for a in "xyz"))
    return records.ravel_keys(p, 700, ["frame"]).select("frame", "pt", "key")


@query(f"WITH {POINTS} SELECT frame, pt, CAST(cls * 16 AS DOUBLE) * 0.2 AS scaled, CAST(cls * 16 AS DOUBLE) / 255 AS share FROM points")
def intensity_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ32: intensities scaled for two networks."""
    i = (F.col("cls") * 16).cast("double")
    return points(spark, sf_dir).select("frame", "pt", (i * 0.2).alias("scaled"), (i / 255).alias("share"))


QUATERNION = {
    "w": "CASE event_id % 4 WHEN 0 THEN 0.6 WHEN 1 THEN 0.0 WHEN 2 THEN 0.28 ELSE 0.5 END",
    "x": "CASE event_id % 4 WHEN 1 THEN 1.0 WHEN 3 THEN 0.5 ELSE 0.0 END",
    "y": "CASE event_id % 4 WHEN 2 THEN 0.96 WHEN 3 THEN 0.4 ELSE 0.0 END",
    "z": "CASE event_id % 4 WHEN 0 THEN 0.8 WHEN 3 THEN 0.5 ELSE 0.0 END",
}
QUATERNION_SQL = ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in QUATERNION.items())


@query(f"""WITH q AS (SELECT event_id, {QUATERNION_SQL} FROM events), n AS (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS n FROM q), u AS (SELECT event_id, abs(n - 1) <= 0.001 AS valid, w / n AS w, x / n AS x, y / n AS y, z / n AS z FROM n)
SELECT event_id, valid, CASE WHEN valid THEN CAST(floor((1 - 2 * (y * y + z * z)) * 1000000 + 0.5) AS BIGINT) END AS r11, CASE WHEN valid THEN CAST(floor(2 * (x * y - z * w) * 1000000 + 0.5) AS BIGINT) END AS r12, CASE WHEN valid THEN CAST(floor(2 * (x * z + y * w) * 1000000 + 0.5) AS BIGINT) END AS r13 FROM u""")
def odometry_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12: rotations of odometry messages; quaternions that are not of length 1 are refused."""
    q = table(spark, sf_dir, "events").selectExpr("event_id", *(f"CAST({e} AS DOUBLE) AS {c}" for c, e in QUATERNION.items()))
    found = q.withColumns(records.transform_of({c: F.col(c) for c in "wxyz"}))
    return found.select("event_id", "valid", *(F.floor(F.col(f"r1{k}") * 1_000_000 + 0.5).cast("long").alias(f"r1{k}") for k in (1, 2, 3)))


@query("""WITH reg(drive, sequence, first, last) AS (SELECT * FROM (VALUES (0, 'a', 100, 5000), (0, 'b', 6000, 9000), (1, 'c', 0, 1000000000), (3, 'd', 50, 60)) t)
SELECT o_orderkey AS index, r.sequence, CAST(o_orderkey - first AS BIGINT) AS frame FROM orders o JOIN reg r ON o.o_custkey % 5 = r.drive AND o_orderkey BETWEEN first AND last""")
def sequence_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC21: raw drives aligned to the frames of registered sequences; the registry is a table of fixed size."""
    registry = spark.createDataFrame([(0, "a", 100, 5000), (0, "b", 6000, 9000), (1, "c", 0, 1_000_000_000), (3, "d", 50, 60)], "drive int, sequence string, first long, last long")
    raw = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).cast("int").alias("drive"), F.col("o_orderkey").alias("index"))
    return records.aligned(raw, F.broadcast(registry)).select("index", "sequence", "frame")


@query(f"WITH {POINTS} SELECT frame, pt, cls FROM points WHERE least(greatest(CAST(floor((z_mm + 2400) / 4900.0 * 64) AS BIGINT), 0), 63) % 2 = 0")
def decimated_beams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT18: every second elevation bin of 64."""
    return records.decimated(points(spark, sf_dir), (F.col("z_mm") + 2400) / 4900.0, 64, 2).select("frame", "pt", "cls")


TEXTS = """CASE event_id % 5 WHEN 0 THEN concat('{"k": ', event_id, ', "r": 0.5}') WHEN 1 THEN concat('{"k": ', event_id, ', "k": 1}') WHEN 2 THEN concat('{"k": ', event_id, ', "r": NaN}') WHEN 3 THEN concat('{"k": ', event_id) ELSE concat('{"r": 1.50, "k": ', event_id, '}') END"""


@query(f"""WITH t AS (SELECT event_id, {TEXTS} AS s FROM events), v AS (SELECT event_id, s, CASE WHEN json_valid(s) AND s NOT LIKE '%NaN%' THEN len(json_keys(s)) = len(list_distinct(json_keys(s))) ELSE false END AS ok FROM t)
SELECT event_id, ok, CASE WHEN ok THEN CAST(json_extract_string(s, '$.k') AS BIGINT) END AS k, CASE WHEN ok THEN CAST(json_extract_string(s, '$.r') AS DOUBLE) END AS r FROM v""")
def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN01: objects with repeated keys, NaN or broken text are refused."""
    t = table(spark, sf_dir, "events").selectExpr("event_id", f"{TEXTS} AS s").withColumn("o", records.strict_json(F.col("s"), "k long, r double"))
    ok = F.col("o.k").isNotNull() & (F.col("o.r").isNotNull() | ~F.col("s").contains('"r"'))
    return t.select("event_id", ok.alias("ok"), F.when(ok, F.col("o.k")).alias("k"), F.when(ok, F.col("o.r")).alias("r"))


PAIR = ("""concat('{"k": ', event_id % 7, ', "r": ', user_id % 3, '.50}')""", """concat('{ "r":', user_id % 2, '.5,  "k":', event_id % 6, '.0 }')""")


@query("SELECT event_id, event_id % 7 = event_id % 6 AND user_id % 3 = user_id % 2 AS same FROM events")
def configs_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN02: configurations of other order and spelling compared by value."""
    t = table(spark, sf_dir, "events").selectExpr("event_id", f"{PAIR[0]} AS a", f"{PAIR[1]} AS b")
    return t.select("event_id", records.same_values(F.col("a"), F.col("b")).alias("same"))


@query(f"""WITH {POINTS} SELECT frame, arm, CAST(count(*) FILTER (hit) AS DOUBLE) / count(*) AS correct_fraction FROM (SELECT frame, unnest([{{'arm': 'scan', 'hit': pred = gt}}, {{'arm': 'class', 'hit': cls % 9 = gt}}], recursive := true) FROM points WHERE gt <> -1) GROUP BY ALL""")
def arm_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN03: a map from arm to its share of right points for each frame, exploded again."""
    right = {"scan": F.col("pred") == F.col("gt"), "class": F.pmod("cls", F.lit(9)) == F.col("gt")}
    maps = points(spark, sf_dir).where("gt <> -1").groupBy("frame").agg(F.create_map(*(x for arm, hit in right.items() for x in (F.lit(arm), F.count_if(hit) / F.count("*")))).alias("correct_fraction"))
    return maps.select("frame", F.explode("correct_fraction").alias("arm", "correct_fraction"))


@query(f"""WITH {POINTS}, px AS (SELECT frame, pt, CAST(floor(x_mm / 2000.0) AS BIGINT) AS u, CAST(floor(y_mm / 2000.0) AS BIGINT) AS v, pred, gt, CAST(z_mm AS BIGINT) AS z, x_mm * x_mm + y_mm * y_mm AS r2 FROM points),
cell AS (SELECT frame, u, v, min(pred) AS plo, max(pred) AS phi, min(z) AS zlo, max(z) AS zhi FROM px GROUP BY ALL),
w AS (SELECT a.frame, a.u, a.v, min(b.plo) < max(b.phi) AS semantic, max(b.zhi) - min(b.zlo) > 1500 AS depth FROM cell a JOIN cell b ON a.frame = b.frame AND abs(a.u - b.u) <= 1 AND abs(a.v - b.v) <= 1 GROUP BY ALL),
s AS (SELECT pred, gt, unnest([CASE WHEN semantic THEN 'semantic_boundary' ELSE 'semantic_interior' END, CASE WHEN depth THEN 'depth_boundary' ELSE 'depth_interior' END,
  CASE WHEN r2 < 400000000 THEN 'range_0' WHEN r2 < 1600000000 THEN 'range_1' ELSE 'range_2' END]) AS subset FROM px JOIN w USING (frame, u, v) WHERE gt <> -1)
SELECT subset, count(*) AS n, count(*) FILTER (pred = gt) AS correct FROM s GROUP BY subset""")
def boundary_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL01: subsets by semantic and depth boundaries of the image around a point, and by range."""
    p = points(spark, sf_dir).select("frame", G.cell("x_mm", 2000).alias("u"), G.cell("y_mm", 2000).alias("v"), "pred", "gt", F.col("z_mm").alias("z"), (F.col("x_mm") * F.col("x_mm") + F.col("y_mm") * F.col("y_mm")).alias("r2"))
    both = windows(p, ["z", "pred"], 1).where("gt <> -1")
    both = both.select("pred", "gt", "r2", (F.col("hi_z") - F.col("lo_z") > 1500).alias("depth"), (F.col("hi_pred") > F.col("lo_pred")).alias("semantic"))
    side = lambda c: F.concat(F.lit(f"{c}_"), F.when(F.col(c), "boundary").otherwise("interior"))
    band = F.when(F.col("r2") < 400_000_000, "range_0").when(F.col("r2") < 1_600_000_000, "range_1").otherwise("range_2")
    rows = both.select("pred", "gt", F.explode(F.array(side("semantic"), side("depth"), band)).alias("subset"))
    return rows.groupBy("subset").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("gt")).alias("correct"))


@query(f"""WITH {MAP}, k AS (SELECT {key_sql('x_mm', 'y_mm', 'z_mm', VOXEL)} AS key, pred, gt, w_micro >= 930000 AS inserted FROM points),
g AS (SELECT key, gt FROM (SELECT key, gt, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, gt) AS place FROM k WHERE gt <> -1 AND inserted GROUP BY key, gt) WHERE place = 1),
r AS (SELECT 'offline_all' AS reading, pred = gt AS hit FROM k WHERE gt <> -1 UNION ALL SELECT 'offline_inserted', pred = gt FROM k WHERE gt <> -1 AND inserted
UNION ALL SELECT 'map_pointgt_inserted', f.cls % 9 = gt FROM k JOIN fused f USING (key) WHERE gt <> -1 AND inserted UNION ALL SELECT 'map_majority_inserted', f.cls % 9 = g.gt FROM g JOIN fused f USING (key)
UNION ALL SELECT 'map_all_lookup', coalesce(f.cls % 9 = gt, false) FROM k LEFT JOIN fused f USING (key) WHERE gt <> -1)
SELECT reading, count(*) AS n, count(*) FILTER (hit) AS correct FROM r GROUP BY reading""")
def map_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL03: five readings of one map: predictions of all and of inserted points, the map at inserted points, against the
    majority of each voxel, and looked up for all points."""
    p = points(spark, sf_dir)
    key = G.voxel_key(F.col("x_mm"), F.col("y_mm"), F.col("z_mm"), VOXEL)
    fused = vote_map(p, key).select("key", F.pmod("cls", F.lit(9)).alias("fused"))
    k = p.where("gt <> -1").select(key.alias("key"), "pred", "gt", (F.col("w_micro") >= 930_000).alias("inserted")).join(fused, "key", "left")
    readings = {"offline_all": (F.lit(True), F.col("pred")), "offline_inserted": (F.col("inserted"), F.col("pred")), "map_pointgt_inserted": (F.col("inserted") & F.col("fused").isNotNull(), F.col("fused")), "map_all_lookup": (F.lit(True), F.col("fused"))}
    each = F.explode(F.array_compact(F.array(*(F.when(used, F.struct(F.lit(n).alias("reading"), F.coalesce(value == F.col("gt"), F.lit(False)).alias("hit"))) for n, (used, value) in readings.items())))).alias("r")
    by_point = k.select(each).select("r.*")
    counts = k.where("inserted AND fused IS NOT NULL").groupBy("key", "gt", "fused").agg(F.count("*").alias("n"))
    top = counts.groupBy("key", "fused").agg(F.max(F.struct("n", (-F.col("gt")).alias("low"))).alias("top"))
    by_voxel = top.select(F.lit("map_majority_inserted").alias("reading"), (F.col("fused") == -F.col("top.low")).alias("hit"))
    return by_point.unionByName(by_voxel).groupBy("reading").agg(F.count("*").alias("n"), F.count_if("hit").alias("correct"))


@query(f"""WITH {TICKS}, b AS (SELECT a.event_id, a.user_id, a.t_us, a.v_cent, max(b.t_us) AS base FROM ticks a JOIN ticks b ON a.user_id = b.user_id AND b.t_us <= a.t_us - 86400000000 GROUP BY ALL),
p AS (SELECT user_id, t_us, max(v_cent) AS x, max(v_cent + event_id % 7) AS e FROM ticks GROUP BY ALL)
SELECT b.user_id, count(*) AS n, CAST(sum(((n.e - o.e) - (n.x - o.x)) * ((n.e - o.e) - (n.x - o.x))) AS BIGINT) AS rpe2 FROM b JOIN p n ON n.user_id = b.user_id AND n.t_us = b.t_us JOIN p o ON o.user_id = b.user_id AND o.t_us = b.base GROUP BY b.user_id""")
def relative_pose_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG41 (RPE): errors of displacement over the newest step of at least a day, per trajectory."""
    t = ticks(spark, sf_dir)
    at = t.groupBy("user_id", "t_us").agg(F.max("v_cent").alias("x"), F.max(F.col("v_cent") + F.col("event_id") % 7).alias("e"))
    steps = ordered.baseline(t, ["user_id"], "t_us", 86_400_000_000).where("base IS NOT NULL").select("user_id", "t_us", "base")
    both = steps.join(at, ["user_id", "t_us"]).join(at.toDF("user_id", "base", "x0", "e0"), ["user_id", "base"])
    d = (F.col("e") - F.col("e0")) - (F.col("x") - F.col("x0"))
    return both.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(d * d).alias("rpe2"))


@query(f"""WITH {POINTS}, v AS (SELECT frame % 2 AS visit, {key_sql('x_mm', 'y_mm', 'z_mm', 8000)} AS key, count(*) AS n, count(DISTINCT frame) AS groups, sum(x_mm) AS x, sum(y_mm) AS y, sum(z_mm) AS z FROM points GROUP BY ALL)
SELECT a.key, a.groups >= 2 AND b.groups >= 2 AND pow(CAST(a.x AS DOUBLE) / a.n - CAST(b.x AS DOUBLE) / b.n, 2) + pow(CAST(a.y AS DOUBLE) / a.n - CAST(b.y AS DOUBLE) / b.n, 2) + pow(CAST(a.z AS DOUBLE) / a.n - CAST(b.z AS DOUBLE) / b.n, 2) <= 250000 AS near FROM v a JOIN v b ON a.key = b.key AND a.visit = 0 AND b.visit = 1""")
def revisit_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT11: the distance between two visits' centroids of a voxel, and enough sweeps in both, as a gate of proposals."""
    key = G.voxel_key(F.col("x_mm"), F.col("y_mm"), F.col("z_mm"), 8000)
    once = points(spark, sf_dir).groupBy(F.pmod("frame", F.lit(2)).alias("visit"), key.alias("key"), "frame").agg(F.count("*").alias("n"), *(F.sum(f"{a}_mm").alias(a) for a in "xyz"))
    v = once.groupBy("visit", "key").agg(F.count("*").alias("groups"), F.sum("n").alias("n"), *(F.sum(a).alias(a) for a in "xyz"))
    a, b = (v.where(F.col("visit") == k).select("key", F.col("groups").alias(f"g{k}"), *((F.col(c) / F.col("n")).alias(f"{c}{k}") for c in "xyz")) for k in (0, 1))
    d2 = sum((F.pow(F.col(f"{c}0") - F.col(f"{c}1"), F.lit(2)) for c in "yz"), F.pow(F.col("x0") - F.col("x1"), F.lit(2)))
    return a.join(b, "key").select("key", ((F.col("g0") >= 2) & (F.col("g1") >= 2) & (d2 <= 250_000)).alias("near"))


@query(f"""WITH {POINTS}, r AS (SELECT frame % 2 AS arm, frame % 3 AS seed, gt, count(*) AS n, count(*) FILTER (gt = pred) AS hit FROM points WHERE gt <> -1 GROUP BY ALL), s AS (SELECT arm, gt, avg(CAST(hit AS DOUBLE) / n) AS mean, stddev_samp(CAST(hit AS DOUBLE) / n) AS sd FROM r GROUP BY ALL),
p AS (SELECT a.gt, b.mean - a.mean AS gain, sqrt(a.sd * a.sd + b.sd * b.sd) AS sd FROM s a JOIN s b ON a.gt = b.gt AND a.arm = 0 AND b.arm = 1) SELECT gt, CASE WHEN sd IS NULL THEN 'open' WHEN gain > 3 * sd THEN 'better' WHEN -gain > 3 * sd THEN 'worse' ELSE 'open' END AS call FROM p""")
def class_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL07: a class is called better or worse only beyond three standard deviations over repeats."""
    r = points(spark, sf_dir).where("gt <> -1").groupBy(F.pmod("frame", F.lit(2)).alias("arm"), F.pmod("frame", F.lit(3)).alias("seed"), "gt").agg((F.count_if(F.col("gt") == F.col("pred")) / F.count("*")).alias("share"))
    s = r.groupBy("arm", "gt").agg(F.avg("share").alias("mean"), F.stddev_samp("share").alias("sd"))
    a, b = (s.where(F.col("arm") == k).select("gt", F.col("mean").alias(f"m{k}"), F.col("sd").alias(f"s{k}")) for k in (0, 1))
    both = a.join(b, "gt").select("gt", (F.col("m1") - F.col("m0")).alias("gain"), F.sqrt(F.col("s0") * F.col("s0") + F.col("s1") * F.col("s1")).alias("sd"))
    call = F.when(F.col("sd").isNull(), "open").when(F.col("gain") > 3 * F.col("sd"), "better").when(-F.col("gain") > 3 * F.col("sd"), "worse").otherwise("open")
    return both.select("gt", call.alias("call"))
