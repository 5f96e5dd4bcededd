"""Queries of ordered operators, geometry, arrays, selections and sets, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.functions import arrays as A
from pointweave.functions import geometry as G
from pointweave.operators import ordered, positions, selection
from pointweave.plans.adapters import POINTS, TICKS, TRACKS, key_sql, points, table, ticks, tracks
from pointweave.plans.queries import query

BY = ["user_id", "event_type"]

# Ordered rows ------------------------------------------------------------------------------------------------------


@query(f"WITH {TRACKS} SELECT user_id, event_type, frame, CAST(frame - row_number() OVER (PARTITION BY user_id, event_type ORDER BY frame) AS INTEGER) AS run FROM tracks")
def consecutive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN07."""
    return ordered.runs(tracks(spark, sf_dir), BY, "frame").select("user_id", "event_type", "frame", "run")


EPISODES = f"""{TRACKS}, r AS (SELECT *, CAST(frame - row_number() OVER (PARTITION BY user_id, event_type ORDER BY frame) AS INTEGER) AS run FROM tracks),
i AS (SELECT *, min(run) OVER (PARTITION BY user_id, event_type) AS first_run, sum(CASE WHEN base THEN 1 ELSE 0 END) OVER w AS island, row_number() OVER w AS spot, lead(stamp_us) OVER w AS ns, lead(base) OVER w AS nb
  FROM r WINDOW w AS (PARTITION BY user_id, event_type, run ORDER BY frame)),
e AS (SELECT user_id, event_type, run, island, min(stamp_us) AS start, count(*) AS length, max(CASE WHEN nb THEN ns END) AS recovered, min(spot) AS spot, min(first_run) AS first_run FROM i WHERE NOT base GROUP BY ALL)"""


@query(f"WITH {EPISODES} SELECT user_id, event_type, run, start, length, recovered, spot = 1 AND run = first_run AS first_observed, spot = 1 AND run <> first_run AS reappearance, recovered IS NULL AS censored FROM e")
def error_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN08: errors within runs, how they start and end."""
    return ordered.episodes(tracks(spark, sf_dir), BY, "frame", "stamp_us", "base")


@query(f"""WITH {TRACKS}, g AS (SELECT user_id, event_type, min(stamp_us) AS start, max(stamp_us) AS last, min(CASE WHEN base THEN stamp_us END) AS hit FROM tracks GROUP BY ALL)
SELECT user_id, event_type, start, least(coalesce(hit - start, last - start + 500000), last - start + 500000) AS delay, hit IS NULL AS censored FROM g""")
def delay_to_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN09."""
    return ordered.delay_to_success(tracks(spark, sf_dir), BY, "stamp_us", "base", 500_000)


@query(f"""WITH {TICKS}, d AS (SELECT event_id, user_id, t_us, v_cent % 7 - 3 AS a, v_cent % 5 - 2 AS b FROM ticks),
p AS (SELECT *, a * lag(a) OVER w + b * lag(b) OVER w AS dot FROM d WINDOW w AS (PARTITION BY user_id ORDER BY t_us)),
q AS (SELECT *, sum(CASE WHEN dot = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t_us) AS part FROM p)
SELECT event_id, CAST(CASE WHEN sum(CASE WHEN dot < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, part ORDER BY t_us) % 2 = 1 THEN -1 ELSE 1 END AS INTEGER) AS sign FROM q""")
def hemisphere_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN06: the sign that keeps neighbours on the same side, as the parity of flips so far."""
    d = ticks(spark, sf_dir).select("event_id", "user_id", "t_us", (F.pmod("v_cent", F.lit(7)) - 3).alias("a"), (F.pmod("v_cent", F.lit(5)) - 2).alias("b"))
    return ordered.carried_sign(d, ["user_id"], "t_us", ["a", "b"]).select("event_id", "sign")


@query(f"""WITH {TICKS}, d AS (SELECT event_id, user_id, t_us, v_cent % 3600 AS a FROM ticks), s AS (SELECT *, a - lag(a) OVER (PARTITION BY user_id ORDER BY t_us) AS d FROM d),
w AS (SELECT *, greatest(coalesce((d + 1799) - 3600 * CAST(floor((d + 1799) / 3600.0) AS BIGINT) - 1799, 0), 0) AS step FROM s),
c AS (SELECT event_id, CAST(sum(step) OVER (PARTITION BY user_id ORDER BY t_us) AS BIGINT) AS swept FROM w) SELECT event_id, swept, CAST(floor(swept / 3600) AS BIGINT) AS ring, swept % 3600 AS phase FROM c""")
def unwrapped_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN01: an angle in tenths of degrees unwrapped to rings and phase."""
    d = ticks(spark, sf_dir).select("event_id", "user_id", "t_us", F.pmod("v_cent", F.lit(3600)).alias("a"))
    return ordered.unwrapped_rings(d, ["user_id"], "t_us", "a", 3600).select("event_id", "swept", "ring", "phase")


@query(f"""WITH {TICKS}, d AS (SELECT event_id, user_id, t_us, v_cent % 3600 AS a FROM ticks), b AS (SELECT *, CASE WHEN lag(a) OVER w - a > 1800 THEN 1 ELSE 0 END AS k FROM d WINDOW w AS (PARTITION BY user_id ORDER BY t_us))
SELECT event_id, CAST(sum(k) OVER (PARTITION BY user_id ORDER BY t_us) AS BIGINT) AS ring FROM b""")
def ring_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN05."""
    d = ticks(spark, sf_dir).select("event_id", "user_id", "t_us", F.pmod("v_cent", F.lit(3600)).alias("a"))
    return ordered.ring_breaks(d, ["user_id"], "t_us", "a", 1800).select("event_id", "ring")


@query(f"""WITH {TICKS}, s AS (SELECT user_id, event_type, t_us, v_cent AS x, event_id AS y, coalesce((v_cent - lag(v_cent) OVER w) * (v_cent - lag(v_cent) OVER w) + (event_id - lag(event_id) OVER w) * (event_id - lag(event_id) OVER w), 0) AS step,
  first_value(v_cent) OVER f AS ax, last_value(v_cent) OVER f AS bx, first_value(event_id) OVER f AS ay, last_value(event_id) OVER f AS bk, first_value(t_us) OVER f AS ta, last_value(t_us) OVER f AS tb
  FROM ticks WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t_us), f AS (PARTITION BY user_id, event_type ORDER BY t_us ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT user_id, event_type, count(*) AS n, CAST(sum(step) AS BIGINT) AS path2, any_value((bx - ax) * (bx - ax) + (bk - ay) * (bk - ay)) AS displacement2, any_value(tb - ta) AS duration FROM s GROUP BY ALL""")
def track_kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG42, AGG41 (path length)."""
    t = ticks(spark, sf_dir).select("user_id", "event_type", "t_us", F.col("v_cent").alias("x"), F.col("event_id").alias("y"))
    return ordered.kinematics(t, BY, "t_us", "x", "y")


@query(f"""WITH {TICKS} SELECT event_id, t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY t_us) AS gap FROM ticks""")
def inter_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN16, DAT02."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("t_us")
    return ticks(spark, sf_dir).select("event_id", (F.col("t_us") - F.lag("t_us").over(w)).alias("gap"))


@query(f"""WITH {TICKS}, s AS (SELECT *, lag(t_us) OVER w AS t1, lag(t_us, 2) OVER w AS t2, lag(v_cent) OVER w AS x1, lag(v_cent, 2) OVER w AS x2 FROM ticks WINDOW w AS (PARTITION BY user_id ORDER BY t_us)),
v AS (SELECT *, CASE WHEN abs(CAST(x1 - x2 AS DOUBLE) / CASE WHEN t1 > t2 THEN t1 - t2 END) <= 1e-6 THEN CAST(x1 - x2 AS DOUBLE) / CASE WHEN t1 > t2 THEN t1 - t2 END END AS v FROM s)
SELECT event_id, CAST(floor(v * 1e15) AS BIGINT) AS v_scaled FROM v""")
def track_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN11: velocity from the last two observations, none beyond the limit."""
    out = ordered.velocity(ticks(spark, sf_dir), ["user_id"], "t_us", "v_cent", 1e-6)
    return out.select("event_id", F.floor(F.col("v") * 1e15).cast("long").alias("v_scaled"))


@query(f"WITH {TICKS} SELECT a.event_id, max(b.t_us) AS base FROM ticks a LEFT JOIN ticks b ON a.user_id = b.user_id AND b.t_us <= a.t_us - 86400000000 GROUP BY a.event_id")
def twist_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN13: the newest sample at least a day older."""
    return ordered.baseline(ticks(spark, sf_dir), ["user_id"], "t_us", 86_400_000_000).select("event_id", "base")


@query(f"""WITH {TICKS}, q AS (SELECT event_id, user_id, t_us, v_cent, min(t_us) OVER w AS a, max(t_us) OVER w AS b FROM ticks WINDOW w AS (PARTITION BY user_id)),
p AS (SELECT user_id, CAST(least(floor((t_us - a) / greatest(b - a, 1) * 4), 3) AS INTEGER) AS quarter, v_cent FROM q) SELECT user_id, quarter, count(*) AS n, CAST(sum(v_cent) AS BIGINT) AS v FROM p GROUP BY ALL""")
def quarter_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN17."""
    return ordered.quarters(ticks(spark, sf_dir), ["user_id"], "t_us").groupBy("user_id", "quarter").agg(F.count("*").alias("n"), F.sum("v_cent").alias("v"))


@query(f"WITH {POINTS} SELECT frame, pt, CAST(row_number() OVER (PARTITION BY frame ORDER BY z_mm, pt) - 1 AS INTEGER) AS place FROM points")
def stable_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN02: the permutation of a stable sort."""
    return ordered.argsorted(points(spark, sf_dir), ["frame"], ["z_mm", "pt"]).select("frame", "pt", "place")


@query(f"""WITH RECURSIVE {TICKS}, o AS (SELECT user_id, t_us FROM ticks), k AS (
  SELECT user_id, min(t_us) AS t_us FROM o GROUP BY user_id
  UNION ALL SELECT k.user_id, (SELECT min(o.t_us) FROM o WHERE o.user_id = k.user_id AND o.t_us >= k.t_us + 86400000000) FROM k WHERE k.t_us IS NOT NULL)
SELECT user_id, t_us FROM k WHERE t_us IS NOT NULL""")
def keyframe_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN14, WIN15: a day at least since the last accepted keyframe; a fold per user."""
    return ordered.thinned(ticks(spark, sf_dir), ["user_id"], "t_us", 86_400_000_000)


# Geometry ----------------------------------------------------------------------------------------------------------

MICRO = "CAST(floor(({}) * 1000000 + 0.5) AS BIGINT)"


def _micro(c, name: str):
    return F.floor(c * 1_000_000 + 0.5).cast("long").alias(name)


@query(f"""WITH {POINTS}, k AS (SELECT DISTINCT {key_sql('x_mm', 'y_mm', 'z_mm', 2000)} AS key FROM points)
SELECT key, (key >> 42) - 1048576 AS gx, ((key >> 21) & 2097151) - 1048576 AS gy, (key & 2097151) - 1048576 AS gz FROM k""")
def voxel_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ01, PRJ02, PRJ03: keys made with the range check, and taken apart."""
    k = points(spark, sf_dir).select(G.checked_voxel_key(F.col("x_mm"), F.col("y_mm"), F.col("z_mm"), 2000).alias("key")).distinct()
    x, y, z = G.decode_key("key")
    return k.select("key", x.alias("gx"), y.alias("gy"), z.alias("gz"))


EULER = f"""{TICKS}, a AS (SELECT event_id, (v_cent % 628 - 314) / 200.0 AS r, (v_cent % 314 - 157) / 200.0 AS p, (event_id % 628 - 314) / 100.0 AS y FROM ticks),
h AS (SELECT event_id, cos(r / 2) AS cr, sin(r / 2) AS sr, cos(p / 2) AS cp, sin(p / 2) AS sp, cos(y / 2) AS cy, sin(y / 2) AS sy FROM a),
q AS (SELECT event_id, sr * cp * cy - cr * sp * sy AS qx, cr * sp * cy + sr * cp * sy AS qy, cr * cp * sy - sr * sp * cy AS qz, cr * cp * cy + sr * sp * sy AS qw FROM h)"""


def _rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    q = G.euler_quaternion((F.pmod("v_cent", F.lit(628)) - 314) / 200.0, (F.pmod("v_cent", F.lit(314)) - 157) / 200.0, (F.pmod("event_id", F.lit(628)) - 314) / 100.0)
    return t.select("event_id", "user_id", "t_us", *(c.alias(n) for c, n in zip(q, ("qx", "qy", "qz", "qw"), strict=True)))


@query(f"""WITH {EULER} SELECT event_id, {MICRO.format('1 - 2 * (qy * qy + qz * qz)')} AS r00, {MICRO.format('2 * (qx * qy - qz * qw)')} AS r01, {MICRO.format('2 * (qx * qz + qy * qw)')} AS r02,
  {MICRO.format('(1 - 2 * (qy * qy + qz * qz)) * 3 + 2 * (qx * qy - qz * qw) * 4 + 2 * (qx * qz + qy * qw) * 5 + 1')} AS px FROM q""")
def rigid_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ07, PRJ08, PRJ12: Euler angles to quaternion to matrix, applied to a point."""
    r = _rotations(spark, sf_dir)
    m = G.quaternion_matrix(*(F.col(c) for c in ("qx", "qy", "qz", "qw")))
    p = G.transform(m, [F.lit(1.0)] * 3, [F.lit(3.0), F.lit(4.0), F.lit(5.0)])
    return r.select("event_id", _micro(m[0], "r00"), _micro(m[1], "r01"), _micro(m[2], "r02"), _micro(p[0], "px"))


@query(f"""WITH {EULER}, n AS (SELECT a.event_id, a.qx AS ax, a.qy AS ay, a.qz AS az, a.qw AS aw, b.qx AS bx, b.qy AS "by", b.qz AS bz, b.qw AS bw FROM q a JOIN q b ON b.event_id = a.event_id + 1),
d AS (SELECT *, ax * bx + ay * "by" + az * bz + aw * bw AS raw FROM n), g AS (SELECT *, CASE WHEN raw < 0 THEN -1.0 ELSE 1.0 END AS sg, acos(least(abs(raw), 1.0)) AS th FROM d),
w AS (SELECT *, CASE WHEN sin(th) < 1e-7 THEN 0.7 ELSE sin(0.7 * th) / sin(th) END AS wa, CASE WHEN sin(th) < 1e-7 THEN 0.3 ELSE sin(0.3 * th) / sin(th) END * sg AS wb FROM g),
m AS (SELECT event_id, wa * ax + wb * bx AS x, wa * ay + wb * "by" AS y, wa * az + wb * bz AS z, wa * aw + wb * bw AS w FROM w)
SELECT event_id, {MICRO.format('x / sqrt(x * x + y * y + z * z + w * w)')} AS sx, {MICRO.format('w / sqrt(x * x + y * y + z * z + w * w)')} AS sw FROM m""")
def quaternion_slerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ09."""
    a, b = _rotations(spark, sf_dir).alias("a"), _rotations(spark, sf_dir).alias("b")
    both = a.join(b, F.col("b.event_id") == F.col("a.event_id") + 1)
    m = G.slerp([F.col(f"a.q{k}") for k in "xyzw"], [F.col(f"b.q{k}") for k in "xyzw"], F.lit(0.3))
    return both.select("a.event_id", _micro(m[0], "sx"), _micro(m[3], "sw"))


@query(f"""WITH {TICKS}, a AS (SELECT event_id, (v_cent % 101 - 50) / 40.0 AS x, (v_cent % 37 - 18) / 20.0 AS y, (event_id % 11 - 5) / 10.0 AS z FROM ticks), t AS (SELECT event_id, sqrt(x * x + y * y + z * z) AS th FROM a)
SELECT event_id, CAST(floor(th * 10000 + 0.5) AS BIGINT) AS angle FROM t WHERE th < 3""")
def rotation_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ10, PRJ11, PRJ13: exp, inverse, composition and log of rotations give back the angle."""
    t = ticks(spark, sf_dir).select("event_id", ((F.pmod("v_cent", F.lit(101)) - 50) / 40.0).alias("x"), ((F.pmod("v_cent", F.lit(37)) - 18) / 20.0).alias("y"), ((F.pmod("event_id", F.lit(11)) - 5) / 10.0).alias("z"))
    r = t.where(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")) < 3).select("event_id", F.array(*G.rotation_exp(F.col("x"), F.col("y"), F.col("z"))).alias("r"))
    m = [F.col("r")[k] for k in range(9)]
    zero = [F.lit(0.0)] * 3
    back, _ = G.inverse(m, zero)
    twice, _ = G.compose((m, zero), (m, zero))
    # The angle between r and r r is that of r.
    v = G.rotation_log(m)
    angle = G.rotation_angle(G.compose((back, zero), (twice, zero))[0], [F.lit(float(k % 4 == 0)) for k in range(9)])
    own = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return r.select("event_id", F.floor(F.when(F.abs(angle - own) < 1e-5, own) * 10_000 + 0.5).cast("long").alias("angle"))


CAMERA = f"""{POINTS}, c AS (SELECT frame, pt, y_mm / 1000.0 AS x, z_mm / 1000.0 AS y, (x_mm + 20000) / 1000.0 AS z FROM points),
i AS (SELECT *, CASE WHEN z > 0.5 THEN 700 * x / z + 620 END AS u, CASE WHEN z > 0.5 THEN 700 * y / z + 187 END AS v FROM c)"""


@query(f"""WITH {CAMERA} SELECT frame, pt, coalesce(u BETWEEN 0 AND 1240 AND v BETWEEN 0 AND 375, false) AS inside, CAST(round_even(u, 0) AS INTEGER) AS col,
  CAST(least(greatest(round_even((u + 0.5) * 0.25 - 0.5, 0), 0), 309) AS INTEGER) AS small FROM i WHERE coalesce(u BETWEEN -3000 AND 4000, false)""")
def camera_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ15, PRJ17, PRJ18: pinhole with a depth gate, nearest pixels half to even, pixels of a rescaled image."""
    p = points(spark, sf_dir).select("frame", "pt", (F.col("y_mm") / 1000.0).alias("x"), (F.col("z_mm") / 1000.0).alias("y"), ((F.col("x_mm") + 20000) / 1000.0).alias("z"))
    c = G.pinhole(F.col("x"), F.col("y"), F.col("z"), 700, 700, 620, 187, 1241, 376, 0.5)
    p = p.select("frame", "pt", c["u"].alias("u"), c["inside"].alias("inside")).where("u BETWEEN -3000 AND 4000")
    return p.select("frame", "pt", "inside", F.rint("u").cast("int").alias("col"), G.scaled_pixel(F.col("u"), 0.25, 310).alias("small"))


@query(f"""WITH {CAMERA}, n AS (SELECT frame, pt, x / z AS a, y / z AS b FROM i WHERE z > 0.5), r AS (SELECT *, a * a + b * b AS r2 FROM n WHERE a * a + b * b < 1)
SELECT frame, pt, {MICRO.format('a * (1 + -0.3 * r2 + 0.1 * r2 * r2) + 2 * 0.001 * a * b + -0.0005 * (r2 + 2 * a * a)')} AS du, {MICRO.format('b * (1 + -0.3 * r2 + 0.1 * r2 * r2) + 0.001 * (r2 + 2 * b * b) + 2 * -0.0005 * a * b')} AS dv FROM r""")
def distorted_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ16."""
    p = points(spark, sf_dir).select("frame", "pt", (F.col("y_mm") / 1000.0).alias("x"), (F.col("z_mm") / 1000.0).alias("y"), ((F.col("x_mm") + 20000) / 1000.0).alias("z")).where("z > 0.5")
    n = p.select("frame", "pt", (F.col("x") / F.col("z")).alias("a"), (F.col("y") / F.col("z")).alias("b")).where("a * a + b * b < 1")
    u, v = G.distorted(F.col("a"), F.col("b"), -0.3, 0.1, 0.001, -0.0005)
    return n.select("frame", "pt", _micro(u, "du"), _micro(v, "dv"))


ANGLE = "(atan2(y_mm + 7.3, x_mm + 3.1) + 3.141592653589793) / (2 * 3.141592653589793)"
RANGE = "sqrt((x_mm + 3.1) * (x_mm + 3.1) + (y_mm + 7.3) * (y_mm + 7.3) + (z_mm + 0.9) * (z_mm + 0.9))"


@query(f"""WITH {POINTS} SELECT frame, pt, CAST(CAST(floor({ANGLE} * 360) AS BIGINT) % 360 * 64 + least(CAST(floor((asin((z_mm + 0.9) / {RANGE}) + 3.141592653589793 / 2) / 3.141592653589793 * 64) AS BIGINT), 63) AS BIGINT) AS ray,
  CAST(trunc({ANGLE} * 450) AS BIGINT) % 450 AS col, least(greatest(CAST(trunc(((z_mm + 0.9) / {RANGE} + 0.5) * 64) AS BIGINT), -1), 64) AS "row",
  CAST(least(greatest(ceil(sqrt((x_mm + 3.1) * (x_mm + 3.1) + (y_mm + 7.3) * (y_mm + 7.3)) / 80000 * 20) - 1, 0), 19) AS INTEGER) AS ring, CAST(least(greatest(ceil({ANGLE} * 60) - 1, 0), 59) AS INTEGER) AS sector FROM points""")
def ray_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ20, PRJ21, PRJ22, PRJ23: ray bins, range-image cells and polar descriptor cells."""
    x, y, z = F.col("x_mm") + F.lit(3.1), F.col("y_mm") + F.lit(7.3), F.col("z_mm") + F.lit(0.9)
    c, r = G.range_cell(x, y, z, 450, 64, -0.5, 0.5)
    ring, sector = G.ring_sector(x, y, 20, 60, 80000)
    return points(spark, sf_dir).select("frame", "pt", G.ray_bin(x, y, z, 360, 64).alias("ray"), c.alias("col"), r.alias("row"), ring.alias("ring"), sector.alias("sector"))


def _morton_sql() -> str:
    bits = [f"(((g{a} >> {k}) & 1) << {3 * k + j})" for k in range(10) for j, a in enumerate("zyx")]
    return " | ".join(bits)


@query(f"""WITH {POINTS}, g AS (SELECT DISTINCT CAST(floor(x_mm / 2000.0) AS BIGINT) + 200 AS gx, CAST(floor(y_mm / 2000.0) AS BIGINT) + 200 AS gy, CAST(floor(z_mm / 2000.0) AS BIGINT) + 200 AS gz FROM points)
SELECT gx, gy, gz, {_morton_sql()} AS code FROM g""")
def morton_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ28: interleaved bits as a clustering key."""
    g = points(spark, sf_dir).select(*((G.cell(f"{a}_mm", 2000) + 200).alias(f"g{a}") for a in "xyz")).distinct()
    return g.withColumn("code", G.morton(F.col("gx"), F.col("gy"), F.col("gz")))


@query(f"""WITH {POINTS} SELECT frame, pt, CAST(((cls * 15) << 16) | ((gt + 1) * 20 << 8) | (pt % 256) AS INTEGER) AS rgb, {MICRO.format('1 / (1 + (sqrt(CAST(x_mm * x_mm + y_mm * y_mm AS DOUBLE)) / 30000) * (sqrt(CAST(x_mm * x_mm + y_mm * y_mm AS DOUBLE)) / 30000))')} AS range_w,
  {MICRO.format('w_micro * exp(-(frame % 10) / 1.5)')} AS age_w FROM points""")
def point_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ25, PRJ26, PRJ27, SNK03: packed colour, range reliability, age weight."""
    r = F.sqrt((F.col("x_mm") * F.col("x_mm") + F.col("y_mm") * F.col("y_mm")).cast("double"))
    p = points(spark, sf_dir)
    rgb = G.pack_rgb(F.col("cls") * 15, (F.col("gt") + 1) * 20, F.pmod("pt", F.lit(256)))
    return p.select("frame", "pt", rgb.alias("rgb"), _micro(G.range_weight(r, 30000), "range_w"), _micro(G.age_weight(F.col("w_micro"), F.pmod("frame", F.lit(10)), 1.5), "age_w"))


@query(f"""WITH {POINTS}, b AS (SELECT frame, min(pt) AS lo, max(pt) AS hi FROM points WHERE w_micro >= 950000 GROUP BY frame HAVING count(*) >= 100)
SELECT p.frame, p.pt, CAST(least(greatest(trunc((pt - lo) / CAST(hi - lo AS DOUBLE) * 128), 0), 127) AS INTEGER) AS bin FROM points p JOIN b ON p.frame = b.frame""")
def deskew_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ24, FLT02, FLT03: time bins between the first and last kept point; frames with under 100 kept points go."""
    p = points(spark, sf_dir)
    b = p.where("w_micro >= 950000").groupBy("frame").agg(F.min("pt").alias("lo"), F.max("pt").alias("hi"), F.count("*").alias("n")).where("n >= 100")
    at = ((F.col("pt") - F.col("lo")) / (F.col("hi") - F.col("lo")).cast("double") * 128).cast("int")
    return p.join(b, "frame").select("frame", "pt", F.least(F.greatest(at, F.lit(0)), F.lit(127)).alias("bin"))


# Arrays ------------------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 32).alias("a"), F.slice(F.col("embedding").cast("array<double>"), 33, 32).alias("b"))


VECTORS = "v AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS a, list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings)"
SOFT = f"""{VECTORS}, e AS (SELECT vec_id, list_transform(a, lambda x: exp(x - list_max(a))) AS p, list_transform(b, lambda x: exp(x - list_max(b))) AS q FROM v),
s AS (SELECT vec_id, list_transform(p, lambda x: x / list_sum(p)) AS p, list_transform(q, lambda x: x / list_sum(q)) AS q FROM e)"""


@query(f"""WITH {SOFT} SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS cls, {MICRO.format('list_max(p)')} AS top, {MICRO.format('list_reverse_sort(p)[1] - list_reverse_sort(p)[2]')} AS margin,
  {MICRO.format('-list_sum(list_transform(p, lambda x: x * ln(x)))')} AS entropy, {MICRO.format('-ln(p[vec_id % 16 + 1])')} AS loss FROM s""")
def posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR01, ARR02, ARR03, ARR07, ARR13."""
    p = _vectors(spark, sf_dir).select("vec_id", A.softmax(F.col("a")).alias("p"))
    c = F.col("p")
    return p.select("vec_id", A.argmax(c).alias("cls"), _micro(F.array_max(c), "top"), _micro(A.margin(c), "margin"), _micro(A.entropy(c), "entropy"), _micro(A.cross_entropy(c, F.pmod("vec_id", F.lit(16)).cast("int")), "loss"))


@query(f"""WITH {SOFT}, z AS (SELECT vec_id, p, q, list_zip(p, q) AS z FROM s) SELECT vec_id, {MICRO.format('list_sum(list_transform(z, lambda x: abs(x[1] - x[2])))')} AS l1,
  {MICRO.format('sqrt(greatest(1 - list_sum(list_transform(z, lambda x: sqrt(x[1] * x[2]))), 0))')} AS hellinger, {MICRO.format('list_sum(list_transform(z, lambda x: x[1] * (ln(x[1]) - ln(x[2]))))')} AS kl,
  CAST(list_position(list_transform(z, lambda x: 0.7 * x[1] + 0.3 * x[2]), list_max(list_transform(z, lambda x: 0.7 * x[1] + 0.3 * x[2]))) - 1 AS INTEGER) AS mixed, {MICRO.format('p[1] + p[2] + p[3]')} AS group0 FROM z""")
def posterior_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR04, ARR07, ARR08, ARR09, ARR12."""
    v = _vectors(spark, sf_dir).select("vec_id", A.softmax(F.col("a")).alias("p"), A.softmax(F.col("b")).alias("q"))
    p, q = F.col("p"), F.col("q")
    return v.select(
        "vec_id", _micro(A.l1(p, q), "l1"), _micro(A.hellinger(p, q), "hellinger"), _micro(A.kl_divergence(p, q), "kl"), A.argmax(A.blend(p, q, 0.3)).alias("mixed"), _micro(A.marginal(p, [[0, 1, 2], [3, 4]])[0], "group0")
    )


@query(f"""WITH {VECTORS} SELECT vec_id, {MICRO.format('list_sum(list_transform(list_zip(a, b), lambda x: x[1] * x[2])) / greatest(sqrt(list_sum(list_transform(a, lambda x: x * x))) * sqrt(list_sum(list_transform(b, lambda x: x * x))), 1e-12)')} AS cosine FROM v""")
def feature_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR06."""
    return _vectors(spark, sf_dir).select("vec_id", _micro(A.cosine(F.col("a"), F.col("b")), "cosine"))


@query("""WITH g AS (SELECT label, i, CAST(sum(CAST(floor(CAST(embedding[i] AS DOUBLE) * 1000000 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL)
SELECT label, CAST(i - 1 AS INTEGER) AS place, m AS mean_micro FROM g""")
def group_mean_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR05, AGG35: mean vectors of groups, in long form."""
    long = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("place", "x"))
    return long.groupBy("label", "place").agg((F.sum(F.floor(F.col("x").cast("double") * 1_000_000 + 0.5).cast("long")) / F.count("*")).alias("mean_micro"))


# Selections and sets -----------------------------------------------------------------------------------------------


@query(f"WITH {POINTS} SELECT frame, pt, w_micro FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY w_micro, pt) AS place FROM points WHERE w_micro < 960000) WHERE place <= 20")
def least_confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP06, FLT14, WIN04, WIN20: the least confident points of each frame."""
    return selection.top(points(spark, sf_dir).where("w_micro < 960000"), ["frame"], ["w_micro", "pt"], 20).select("frame", "pt", "w_micro")


@query(f"""WITH {POINTS}, o AS (SELECT frame, pt, row_number() OVER (PARTITION BY frame ORDER BY pt) - 1 AS i, count(*) OVER (PARTITION BY frame) AS n FROM points)
SELECT frame, pt FROM o WHERE n <= 100 OR i IN (SELECT floor(j * n / 100.0) FROM range(100) t(j))""")
def even_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP02, TOP04."""
    return selection.evenly(points(spark, sf_dir), ["frame"], ["pt"], 100).select("frame", "pt")


@query(f"""WITH {POINTS}, v AS (SELECT CAST(floor(x_mm / 2000.0) AS BIGINT) AS gx, CAST(floor(y_mm / 2000.0) AS BIGINT) AS gy, CAST(floor(z_mm / 2000.0) AS BIGINT) AS gz, count(*) AS n FROM points GROUP BY ALL)
SELECT gx, gy, gz, n, row_number() OVER (ORDER BY gx, gy, gz) - 1 AS place FROM v""")
def map_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP01, WIN02: every voxel of the map with its place in the order of x, y, z, over all partitions."""
    grid = [G.cell(f"{a}_mm", 2000).alias(f"g{a}") for a in "xyz"]
    v = points(spark, sf_dir).groupBy(*grid).agg(F.count("*").alias("n"))
    return positions.in_order(v, ["gx", "gy", "gz"], "place")


@query(f"""WITH {POINTS}, o AS (SELECT frame, pt, row_number() OVER (ORDER BY frame, pt) - 1 AS i, count(*) OVER () AS n FROM points)
SELECT frame, pt FROM o WHERE i IN (SELECT floor(j * n / 1000) FROM range(1000) t(j), (SELECT any_value(n) AS n FROM o)) OR n <= 1000""")
def display_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP02, TOP09: a thousand points at even places of the whole cloud's order."""
    return positions.evenly_placed(points(spark, sf_dir).select("frame", "pt"), ["frame", "pt"], 1000).select("frame", "pt")


@query(f"""WITH {POINTS}, p AS (SELECT frame, pt, gt, md5('prio|' || frame || '|' || pt) AS h FROM points), k AS (SELECT frame, count(*) FILTER (gt = 4) AS k FROM points GROUP BY frame)
SELECT frame, pt FROM (SELECT p.*, k, row_number() OVER (PARTITION BY p.frame ORDER BY h, pt) AS place FROM p JOIN k ON p.frame = k.frame) WHERE place <= k""")
def seeded_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP07, PRJ30: as many points as another rule takes in each frame, by frozen priority."""
    p = points(spark, sf_dir)
    k = p.groupBy("frame").agg(F.count_if(F.col("gt") == 4).alias("k"))
    return selection.top_per_count(p.withColumn("h", selection.priority("frame", "pt", salt="prio")), ["frame"], ["h", "pt"], k).select("frame", "pt")


@query("""WITH g AS (SELECT DISTINCT c_nationkey AS log FROM customer), r AS (SELECT log, row_number() OVER (ORDER BY sha256('v1' || CAST(log AS VARCHAR))) AS place FROM g)
SELECT log, CASE WHEN place <= 12 THEN 'train' WHEN place <= 16 THEN 'dev' ELSE 'test' END AS part FROM r WHERE place <= 20""")
def hash_ranked_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP10, SET04: groups ranked by a hash, dealt to disjoint parts."""
    g = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("log"))
    return selection.hash_ranked_split(g, "log", "v1", {"train": 12, "dev": 4, "test": 4})


@query("""WITH c AS (SELECT c_custkey, c_nationkey, CAST(floor(abs(c_acctbal)) AS BIGINT) AS w FROM customer), s AS (SELECT *, sum(w) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS hi, sum(w) OVER (PARTITION BY c_nationkey) AS total FROM c),
d AS (SELECT DISTINCT c_nationkey, draw, ((draw * 7919) % 1000) / 1000.0 AS u FROM customer, (SELECT unnest(range(50)) AS draw)), a AS (SELECT d.*, least(CAST(floor(u * total) AS BIGINT), total - 1) AS at FROM d JOIN (SELECT DISTINCT c_nationkey, total FROM s) USING (c_nationkey))
SELECT a.c_nationkey, draw, c_custkey FROM a JOIN s ON a.c_nationkey = s.c_nationkey AND s.hi - s.w <= a.at AND a.at < s.hi""")
def weighted_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP11: draws with replacement by weight, from given uniforms."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.floor(F.abs("c_acctbal")).alias("w"))
    draws = c.select("c_nationkey").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))))
    draws = draws.withColumn("u", ((F.col("draw") * 7919) % 1000) / 1000.0)
    return selection.weighted_resample(c, ["c_nationkey"], "c_custkey", "w", draws).select("c_nationkey", "draw", "c_custkey")


@query(f"WITH {POINTS} SELECT frame, pt, x_mm, y_mm FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY (x_mm - 5000) * (x_mm - 5000) + (y_mm + 3000) * (y_mm + 3000), pt) AS place FROM points) WHERE place <= 50")
def spatial_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP12, FLT12: the nearest points to a centre."""
    d2 = (F.col("x_mm") - 5000) * (F.col("x_mm") - 5000) + (F.col("y_mm") + 3000) * (F.col("y_mm") + 3000)
    return selection.top(points(spark, sf_dir), ["frame"], [d2, "pt"], 50).select("frame", "pt", "x_mm", "y_mm")


@query(f"""WITH {POINTS} SELECT gt, CAST(sum(n) AS BIGINT) AS n FROM (SELECT gt, count(*) AS n FROM points WHERE frame % 2 = 0 GROUP BY gt UNION ALL SELECT gt, count(*) FROM points WHERE frame % 2 = 1 GROUP BY gt) GROUP BY gt""")
def merged_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET01, SET06."""
    parts = [points(spark, sf_dir).where(F.pmod("frame", F.lit(2)) == k).groupBy("gt").agg(F.count("*").alias("n")) for k in (0, 1)]
    return selection.merged_counts(parts, ["gt"], "n")


@query(f"""WITH {TICKS}, o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t_us) AS k, event_id FROM ticks), old AS (SELECT * FROM o WHERE k <= 5),
n AS (SELECT user_id, k, CASE WHEN user_id % 4 = 0 AND k = 3 THEN -1 ELSE event_id END AS event_id FROM o) SELECT old.user_id, bool_and(old.event_id = n.event_id) AS holds FROM old LEFT JOIN n USING (user_id, k) GROUP BY old.user_id""")
def revision_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET05, STM-06: is the old revision a prefix of the new one."""
    o = ordered.argsorted(ticks(spark, sf_dir), ["user_id"], ["t_us"], "k")
    new = o.withColumn("event_id", F.when((F.pmod("user_id", F.lit(4)) == 0) & (F.col("k") == 2), -1).otherwise(F.col("event_id")))
    return selection.prefix_holds(o.where("k < 5"), new, ["user_id"], "k", "event_id")


@query(f"""WITH {POINTS} SELECT frame, pt, (CASE WHEN abs(y_mm) < x_mm THEN 1 ELSE 0 END | CASE WHEN z_mm < 1000 THEN 2 ELSE 0 END | CASE WHEN cls = pred THEN 4 ELSE 0 END | CASE WHEN x_mm * x_mm + y_mm * y_mm < 2500000000 THEN 8 ELSE 0 END) AS flags
FROM points WHERE frame % 10 = 5 AND gt <> -1 AND w_micro >= 930000""")
def filter_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BIT01, FLT04, FLT05, FLT08, FLT13: clauses as bit flags over the held-out frames, which a specification selects."""
    from pointweave.operators.filters import bit_flags, compiled

    clauses = [F.abs("y_mm") < F.col("x_mm"), F.col("z_mm") < 1000, F.col("cls") == F.col("pred"), F.col("x_mm") * F.col("x_mm") + F.col("y_mm") * F.col("y_mm") < 2_500_000_000]
    spec = {"held_out": True, "labelled": True, "confident": True, "near": False}
    known = {"held_out": F.pmod("frame", F.lit(10)) == 5, "labelled": F.col("gt") != -1, "confident": F.col("w_micro") >= 930_000, "near": clauses[3]}
    p = points(spark, sf_dir).where(compiled(spec, known))
    return p.select("frame", "pt", bit_flags(clauses).alias("flags"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, lpad(CAST(event_id AS VARCHAR), 6, '0') AS stem, sha256(props) AS digest, regexp_matches(event_type, '^[a-f]+$') AS is_hex FROM events""")
def text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR01-03: JSON fields, padded stems, content hashes, patterns."""
    e = table(spark, sf_dir, "events")
    props = F.from_json("props", "k long", {"mode": "FAILFAST"})
    return e.select("event_id", props["k"].alias("k"), F.lpad(F.col("event_id").cast("string"), 6, "0").alias("stem"), F.sha2("props", 256).alias("digest"), F.col("event_type").rlike("^[a-f]+$").alias("is_hex"))


@query("""WITH s AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM s) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM i GROUP BY user_id, session""")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-21 in batch: a new session after a gap of six hours."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "6 hours 1 microsecond").alias("s")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_micros("s.start").alias("start_us"), "n")
