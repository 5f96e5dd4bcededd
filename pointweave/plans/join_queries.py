"""Queries of the temporal, spatial and visibility joins, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.functions import geometry as G
from pointweave.operators.nearest import nearest
from pointweave.operators import joins, ordered, selection
from pointweave.plans.adapters import POINTS, TICKS, TRACKS, key_sql, points, table, ticks, tracks
from pointweave.plans.queries import MAP, VOXEL, query

# Adapters of events as a trajectory: purchases are poses, clicks are sweeps.
SPLIT = f"""{TICKS}, pose AS (SELECT user_id, t_us AS t, min(v_cent) AS v FROM ticks WHERE event_type = 'purchase' GROUP BY ALL),
sweep AS (SELECT event_id, user_id, t_us FROM ticks WHERE event_type = 'click')"""


def _pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).where("event_type = 'purchase'").groupBy("user_id", F.col("t_us").alias("t")).agg(F.min("v_cent").alias("v"))


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).where("event_type = 'click'").select("event_id", "user_id", "t_us")


DAY = 86_400_000_000
SPANS = f"{SPLIT}, span AS (SELECT user_id, t AS t0, v AS v0, lead(t) OVER w AS t1, lead(v) OVER w AS v1, lead(t, 2) OVER w AS t2 FROM pose WINDOW w AS (PARTITION BY user_id ORDER BY t))"


@query(f"""WITH {SPANS} SELECT event_id, CAST(floor(v0 + CAST(v1 - v0 AS DOUBLE) * (t_us - t0) / (t1 - t0)) AS BIGINT) AS v
FROM sweep s LEFT JOIN span p ON s.user_id = p.user_id AND t1 IS NOT NULL AND t0 <= t_us AND (t_us < t1 OR (t2 IS NULL AND t_us = t1))""")
def pose_bracket_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN05, FLT01: interpolation between the poses around a stamp; stamps outside the span have none."""
    out = joins.bracket(_sweep(spark, sf_dir), _pose(spark, sf_dir), "t_us", ["user_id"], 2 * DAY)
    share = (F.col("v1") - F.col("v0")).cast("double") * (F.col("t_us") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    return out.select("event_id", F.floor(F.col("v0") + share).cast("long").alias("v"))


@query(f"""WITH {SPANS}, e AS (SELECT user_id, min(t) AS a, max(t) AS b FROM pose GROUP BY ALL),
c AS (SELECT event_id, s.user_id, least(greatest(t_us, a), b) AS t_us FROM sweep s LEFT JOIN e ON s.user_id = e.user_id)
SELECT event_id, c.t_us, t0, t1 FROM c LEFT JOIN span p ON c.user_id = p.user_id AND t1 IS NOT NULL AND t0 <= t_us AND (t_us < t1 OR (t2 IS NULL AND t_us = t1))""")
def pose_clamped_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN06: queries are clipped to the trajectory's span first."""
    return joins.bracket(_sweep(spark, sf_dir), _pose(spark, sf_dir), "t_us", ["user_id"], 2 * DAY, clamp=True).select("event_id", "t_us", "t0", "t1")


@query(f"""WITH {SPLIT}, n AS (SELECT event_id, t, abs(t_us - t) AS d, row_number() OVER (PARTITION BY event_id ORDER BY abs(t_us - t), t) AS place
  FROM sweep s JOIN pose p ON s.user_id = p.user_id AND abs(t_us - t) <= 21600000000) SELECT event_id, t, d FROM n WHERE place = 1""")
def nearest_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN07, JOIN08, SRC20: the nearest pose within six hours, the earliest on ties."""
    out = joins.nearest(_sweep(spark, sf_dir), _pose(spark, sf_dir), ["user_id"], "event_id", "t_us", "t", 21_600_000_000)
    return out.select("event_id", "t", F.abs(F.col("t_us") - F.col("t")).alias("d"))


@query(f"""WITH {SPLIT}, n AS (SELECT event_id, max(t) AS v_t FROM sweep s JOIN pose p ON s.user_id = p.user_id AND t <= t_us GROUP BY event_id)
SELECT s.event_id, CASE WHEN t_us - v_t <= {DAY} THEN v_t END AS v_t, CASE WHEN t_us - v_t <= {DAY} THEN v END AS v
FROM sweep s LEFT JOIN n ON s.event_id = n.event_id LEFT JOIN pose p ON p.user_id = s.user_id AND p.t = n.v_t""")
def latest_not_future_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN09, FLT16, STM-20: the newest pose not after the stamp, at most a day old."""
    pose = _pose(spark, sf_dir).withColumnRenamed("t", "t_us")
    return joins.latest_before(_sweep(spark, sf_dir), pose, ["user_id"], "t_us", "v", DAY).select("event_id", "v", "v_t")


@query(f"""WITH {TICKS}, a AS (SELECT DISTINCT user_id, CAST(floor(t_us / 3600000000) AS BIGINT) AS stamp FROM ticks WHERE event_type = 'view'),
b AS (SELECT DISTINCT user_id, CAST(floor(t_us / 3600000000) AS BIGINT) AS stamp FROM ticks WHERE event_type = 'error') SELECT user_id, stamp FROM a JOIN b USING (user_id, stamp)""")
def exact_stamp_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN10 in batch."""
    t = ticks(spark, sf_dir).withColumn("stamp", F.floor(F.col("t_us") / 3_600_000_000))
    a, b = (t.where(F.col("event_type") == k).select("user_id", "stamp").distinct() for k in ("view", "error"))
    return a.join(b, ["user_id", "stamp"])


@query(f"""WITH RECURSIVE {TICKS}, p AS (SELECT event_id AS id, user_id AS hash, t_us AS ready, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS k FROM ticks WHERE event_type = 'signup'),
r AS (SELECT user_id AS hash, t_us AS received, row_number() OVER (PARTITION BY user_id ORDER BY t_us) AS j FROM ticks WHERE event_type = 'purchase'),
c AS (SELECT p.*, (SELECT count(*) FROM r WHERE r.hash = p.hash AND r.received < p.ready) AS before FROM p),
g AS (SELECT id, hash, ready, k, before + 1 AS j FROM c WHERE k = 1 UNION ALL SELECT c.id, c.hash, c.ready, c.k, greatest(g.j + 1, c.before + 1) FROM g JOIN c ON c.hash = g.hash AND c.k = g.k + 1)
SELECT id, g.hash, ready, received FROM g JOIN r ON r.hash = g.hash AND r.j = g.j""")
def delivery_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN11: each publication takes the earliest unused reception of its hash that is not before it."""
    t = ticks(spark, sf_dir)
    p = t.where("event_type = 'signup'").select(F.col("event_id").alias("id"), F.col("user_id").alias("hash"), F.col("t_us").alias("ready"))
    r = t.where("event_type = 'purchase'").select(F.col("user_id").alias("hash"), F.col("t_us").alias("received"))
    return joins.delivery(p, r)


@query(f"""WITH {POINTS}, a AS (SELECT x_mm, y_mm, z_mm, count(*) AS n, min(cls) AS cls FROM points WHERE frame % 2 = 0 GROUP BY ALL), b AS (SELECT x_mm, y_mm, z_mm, count(*) AS n, min(cls) AS cls FROM points WHERE frame % 2 = 1 GROUP BY ALL)
SELECT x_mm, y_mm, z_mm, a.cls AS cls_a, b.cls AS cls_b FROM a JOIN b USING (x_mm, y_mm, z_mm) WHERE a.n = 1 AND b.n = 1""")
def identity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN12: rows identified by exact coordinates; ambiguous coordinates are left out (checked by identity_is_unique)."""
    at = ["x_mm", "y_mm", "z_mm"]
    p = points(spark, sf_dir)
    a, b = (p.where(F.pmod("frame", F.lit(k)) == r).groupBy(*at).agg(F.count("*").alias("n"), F.min("cls").alias(c)).where("n = 1").drop("n") for k, r, c in ((2, 0, "cls_a"), (2, 1, "cls_b")))
    return a.join(b, at)


def _clouds(spark: SparkSession, sf_dir: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Every sweep, and as its past the sweep before it in all points, under the later one's frame number."""
    p = points(spark, sf_dir)
    at = [F.col("x_mm").alias("x"), F.col("y_mm").alias("y"), F.col("z_mm").alias("z"), "cls"]
    key = lambda d: d.withColumn("key", G.voxel_key(F.col("x"), F.col("y"), F.col("z"), size))
    own = (F.col("frame").cast("long") * 1_000_000 + F.col("pt")).alias("id")
    return key(p.select("frame", own, *at)), key(p.select((F.col("frame") + 1).alias("frame"), own, *at))


def _near_sql(past: str = "SELECT frame + 1 AS frame, CAST(frame AS BIGINT) * 1000000 + pt AS id, x_mm AS x, y_mm AS y, z_mm AS z, cls, 0 AS tx, 0 AS ty, 0 AS tz FROM points") -> str:
    """Pairs within 1.2 m, by cells of that width: the box of 27 cells is an equi-join that any engine can hash."""
    cell = ", ".join(f"CAST(floor({v} / 1200.0) AS BIGINT) AS g{v}" for v in "xyz")
    return f"""{POINTS}, a AS (SELECT frame, CAST(frame AS BIGINT) * 1000000 + pt AS id, x_mm AS x, y_mm AS y, z_mm AS z, cls, {cell.replace('x /', 'x_mm /').replace('y /', 'y_mm /').replace('z /', 'z_mm /')} FROM points),
past AS ({past}), b AS (SELECT *, {cell} FROM past), o AS (SELECT i.v AS i, j.v AS j, k.v AS k FROM (VALUES (-1), (0), (1)) i(v), (VALUES (-1), (0), (1)) j(v), (VALUES (-1), (0), (1)) k(v)),
spread AS (SELECT a.frame, id, x, y, z, cls, gx + i AS gx, gy + j AS gy, gz + k AS gz FROM a, o),
near AS (SELECT a.id AS id_a, b.id AS id_b, a.cls AS cls_a, b.cls AS cls_b, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, tx, ty, tz, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2
  FROM spread a JOIN b USING (frame, gx, gy, gz) WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 1440000)"""


# A sweep's past, seen from its own sensor: turned by a right angle in every other frame, and shifted.
TURNED = """SELECT frame + 1 AS frame, CAST(frame AS BIGINT) * 1000000 + pt AS id, CASE WHEN frame % 2 = 0 THEN -y_mm ELSE x_mm END + 300 * (frame % 3) AS x, CASE WHEN frame % 2 = 0 THEN x_mm ELSE y_mm END - 200 AS y, z_mm + 100 AS z, cls, 300 * (frame % 3) AS tx, -200 AS ty, 100 AS tz FROM points"""


@query(f"""WITH {_near_sql(TURNED)}, f AS (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY d2, id_b) AS pa, row_number() OVER (PARTITION BY id_b ORDER BY d2, id_a) AS pb FROM near)
SELECT id_a, id_b, CAST(d2 AS BIGINT) AS d2 FROM f WHERE pa = 1 AND pb = 1 AND ax * ax + ay * ay + az * az > 0 AND (bx - tx) * (bx - tx) + (by_ - ty) * (by_ - ty) + (bz - tz) * (bz - tz) > 0
AND abs((ax - bx) * ax + (ay - by_) * ay + (az - bz) * az) <= 600 * sqrt(CAST(ax * ax + ay * ay + az * az AS DOUBLE))
AND abs((ax - bx) * (bx - tx) + (ay - by_) * (by_ - ty) + (az - bz) * (bz - tz)) <= 600 * sqrt(CAST((bx - tx) * (bx - tx) + (by_ - ty) * (by_ - ty) + (bz - tz) * (bz - tz) AS DOUBLE))""")
def reciprocal_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN13: points of a sweep and of the one before it, moved by the relative pose, that are each other's nearest within
    1.2 m and apart by at most 0.6 m along either ray."""
    current, past = _clouds(spark, sf_dir, 1200)
    even = F.pmod(F.col("frame") - 1, F.lit(2)) == 0
    turn = {"r11": F.when(even, 0).otherwise(1), "r12": F.when(even, -1).otherwise(0), "r13": F.lit(0), "r21": F.when(even, 1).otherwise(0), "r22": F.when(even, 0).otherwise(1), "r23": F.lit(0), "r31": F.lit(0), "r32": F.lit(0), "r33": F.lit(1)}
    shift = {"tx": 300 * F.pmod(F.col("frame") - 1, F.lit(3)), "ty": F.lit(-200), "tz": F.lit(100)}
    relative = past.select("frame").distinct().withColumns({k: c.cast("long") for k, c in (turn | shift).items()})
    past = joins.moved(past.drop("key"), relative).withColumn("key", G.voxel_key(F.col("x"), F.col("y"), F.col("z"), 1200))
    return joins.associate(current, past, 1_440_000, 600).select("id_a", "id_b", "d2")


@query(f"""WITH {_near_sql()}, k AS (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY d2, id_b) AS place FROM near)
SELECT id_a, count(*) AS n, bool_or(cls_a <> cls_b) AS boundary FROM k WHERE place <= 4 GROUP BY id_a""")
def semantic_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN14, TOP05: is any of the four nearest points of the sweep before within the radius of another class."""
    k = joins.nearest_neighbours(*_clouds(spark, sf_dir, 1200), 1_440_000, 4, ("frame",))
    return k.groupBy("id_a").agg(F.count("*").alias("n"), F.bool_or(F.col("cls_a") != F.col("cls_b")).alias("boundary"))


#: All pairs of a sweep's points and those of the one before.
ALL_PAIRS = f"""{POINTS}, far AS (SELECT a.frame, CAST(a.frame AS BIGINT) * 1000000 + a.pt AS id_a, CAST(b.frame AS BIGINT) * 1000000 + b.pt AS id_b,
  (a.x_mm - b.x_mm) * (a.x_mm - b.x_mm) + (a.y_mm - b.y_mm) * (a.y_mm - b.y_mm) + (a.z_mm - b.z_mm) * (a.z_mm - b.z_mm) AS d2 FROM points a JOIN points b ON b.frame = a.frame - 1)"""


@query(f"""WITH {ALL_PAIRS} SELECT id_a, CAST(min(d2) AS BIGINT) AS d2 FROM far GROUP BY id_a""")
def cloud_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN27: squared distance from each point to the nearest of the sweep before, however far that is."""
    current, past = (d.drop("key") for d in _clouds(spark, sf_dir, 1200))
    return nearest(current, past, ("frame",), 1200).select("id_a", "d2")


@query(f"""WITH {ALL_PAIRS}, f AS (SELECT frame, avg(d2) AS m, count(*) FILTER (d2 <= 1440000) AS n FROM (SELECT frame, id_a, min(d2) AS d2 FROM far GROUP BY ALL) GROUP BY frame),
g AS (SELECT frame, avg(d2) AS m FROM (SELECT frame, id_b, min(d2) AS d2 FROM far GROUP BY ALL) GROUP BY frame), c AS (SELECT frame, count(*) AS own FROM points GROUP BY frame)
SELECT CAST(f.frame AS BIGINT) AS frame, f.m + g.m AS chamfer2, CAST(f.n AS DOUBLE) / c.own AS matched FROM f JOIN g USING (frame) JOIN c USING (frame)""")
def chamfer_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN28: both ways, the mean squared nearest distance of a sweep and the one before, over all their points; and the
    share of points that have one within 1.2 m."""
    current, past = (d.drop("key") for d in _clouds(spark, sf_dir, 1200))
    near = nearest(current, past, ("frame",), 1200, both=True)
    way = {name: F.when(F.col("back") == back, F.col("d2")) for name, back in (("there", False), ("back", True))}
    sums = near.groupBy("frame").agg(*((F.sum(d) / F.count(d)).alias(name) for name, d in way.items()), F.count_if(way["there"] <= 1_440_000).alias("n"), F.count(way["there"]).alias("own"))
    return sums.select(F.col("frame").cast("long").alias("frame"), (F.col("there") + F.col("back")).alias("chamfer2"), (F.col("n") / F.col("own")).alias("matched"))


RECORDS = f"""{POINTS}, rec AS (SELECT frame, arg_min(CAST(frame AS BIGINT) * 1000000 + pt, pt) AS id, arg_min(x_mm, pt) AS x, arg_min(y_mm, pt) AS y, arg_min(z_mm, pt) AS z, arg_min(cls, pt) AS cls, gx, gy, gz
  FROM (SELECT *, CAST(floor(x_mm / 2000.0) AS BIGINT) AS gx, CAST(floor(y_mm / 2000.0) AS BIGINT) AS gy, CAST(floor(z_mm / 2000.0) AS BIGINT) AS gz FROM points) GROUP BY frame, gx, gy, gz)"""


@query(f"""WITH {RECORDS}, life AS (SELECT *, lead(frame, 3) OVER (PARTITION BY gx, gy, gz ORDER BY frame) AS gone FROM rec),
alive AS (SELECT l.*, f.frame AS seen_at FROM life l JOIN (SELECT unnest(range(1, 5)) AS step) s ON true JOIN (SELECT DISTINCT frame FROM points) f ON f.frame = l.frame + s.step AND (gone IS NULL OR gone >= f.frame)),
o AS (SELECT i.v AS i, j.v AS j, k.v AS k FROM (VALUES (-1), (0), (1)) i(v), (VALUES (-1), (0), (1)) j(v), (VALUES (-1), (0), (1)) k(v)),
q AS (SELECT frame AS seen_at, id, x, y, z, cls, gx + i AS gx, gy + j AS gy, gz + k AS gz FROM rec, o),
n AS (SELECT q.id AS id_a, a.id AS id_b, q.cls AS ca, a.cls AS cb, q.seen_at - a.frame AS age, (q.x - a.x) * (q.x - a.x) + (q.y - a.y) * (q.y - a.y) + (q.z - a.z) * (q.z - a.z) AS d2 FROM q JOIN alive a USING (seen_at, gx, gy, gz)),
k AS (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY d2, id_b) AS place FROM n WHERE d2 <= 4000000)
SELECT id_a, id_b, CAST(d2 AS BIGINT) AS d2, CAST(age AS INTEGER) AS age FROM k WHERE place <= 3 AND CAST(16 - abs(ca - cb) AS DOUBLE) / 16 >= 0.7""")
def memory_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN15: the three nearest records of a bounded memory first, the similarity filter after, so fewer may remain.

    One record per cell and frame; a record leaves its cell when three newer ones are in it, or after four frames.
    """
    from pointweave.operators import memory

    rec = memory.records(points(spark, sf_dir).withColumns({"x": F.col("x_mm"), "y": F.col("y_mm"), "z": F.col("z_mm"), "id": F.col("frame").cast("long") * 1_000_000 + F.col("pt")}), 2000, ["pt"], ["id", "x", "y", "z", "cls"])
    near = memory.retrieved_alive(rec, 3, 4, 4_000_000, 3)
    return near.where((16 - F.abs(F.col("cls_a") - F.col("cls_b"))) / 16 >= 0.7).select("id_a", "id_b", "d2", "age")


@query(f"""WITH {RECORDS}, life AS (SELECT *, CAST(floor(x / 2500.0) AS BIGINT) * 1000 + CAST(floor(y / 2500.0) AS BIGINT) AS ray, CAST(z + 3000 AS BIGINT) AS r FROM rec),
front AS (SELECT frame AS seen_at, CAST(floor(x_mm / 2500.0) AS BIGINT) * 1000 + CAST(floor(y_mm / 2500.0) AS BIGINT) AS ray, min(z_mm + 3000) AS front FROM points GROUP BY ALL),
t AS (SELECT id, min(seen_at) AS through FROM life JOIN front USING (ray) WHERE seen_at BETWEEN frame + 1 AND frame + 4 AND r < front - 300 GROUP BY id),
e AS (SELECT life.*, through, least(frame + 4, coalesce(through - 1, frame + 4)) AS ends FROM life LEFT JOIN t USING (id)),
g AS (SELECT id, min(written) AS gone FROM (SELECT i.id, j.frame AS written FROM e i JOIN e j ON (i.gx, i.gy, i.gz) = (j.gx, j.gy, j.gz) AND j.frame > i.frame AND j.frame <= i.ends
  JOIN e k ON (i.gx, i.gy, i.gz) = (k.gx, k.gy, k.gz) AND k.frame > i.frame AND k.frame <= j.frame AND k.ends >= j.frame GROUP BY i.id, j.frame HAVING count(*) >= 3) GROUP BY id),
h AS (SELECT e.*, least(ends, coalesce(gone, ends)) AS last, CASE WHEN gone IS NULL THEN through END AS revoked_at FROM e LEFT JOIN g USING (id)),
a AS (SELECT h.*, f.frame AS seen_at FROM h JOIN (SELECT unnest(range(1, 5)) AS step) s ON true JOIN (SELECT DISTINCT frame FROM points) f ON f.frame = h.frame + s.step AND f.frame <= coalesce(revoked_at, last)),
v AS (SELECT a.*, seen_at > last AS revoked, coalesce(r > front + 300, false) AS hidden FROM a LEFT JOIN front USING (seen_at, ray))
SELECT seen_at AS frame, count(*) FILTER (NOT revoked) AS held, count(*) FILTER (NOT revoked AND NOT hidden) AS readable, count(*) FILTER (revoked) AS revoked FROM v GROUP BY seen_at""")
def evidence_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-10, STM-11: what the bounded memory holds at each frame: revoked where a sweep sees through, which frees a place,
    unreadable where occluded."""
    from pointweave.operators import memory

    p = points(spark, sf_dir).withColumns({"x": F.col("x_mm"), "y": F.col("y_mm"), "z": F.col("z_mm"), "id": F.col("frame").cast("long") * 1_000_000 + F.col("pt")})
    p = p.withColumns({"ray": G.cell("x_mm", 2500) * 1000 + G.cell("y_mm", 2500), "r": F.col("z_mm") + 3000})
    fronts = p.groupBy(F.col("frame").alias("at"), "ray").agg(F.min("r").alias("front"))
    held = memory.evidence(memory.records(p, 2000, ["pt"], ["id", "ray", "r"]), fronts, 300, 3, 4)
    held = held.join(p.select(F.col("frame").alias("at")).distinct(), "at")
    return held.groupBy(F.col("at").alias("frame")).agg(F.count_if(~F.col("revoked")).alias("held"), F.count_if("readable").alias("readable"), F.count_if("revoked").alias("revoked"))


RAYS = f"""{POINTS}, r AS (SELECT frame, pt, CAST(floor(x_mm / 2500.0) AS BIGINT) * 1000 + CAST(floor(y_mm / 2500.0) AS BIGINT) AS ray, CAST(z_mm + 3000 AS BIGINT) AS r FROM points)"""


@query(f"""WITH {RAYS}, f AS (SELECT ray, min(r) AS front FROM r WHERE frame % 2 = 0 GROUP BY ray)
SELECT frame, pt, r.ray, r.r, front, CAST(CASE WHEN front IS NULL THEN 0 WHEN abs(r.r - front) <= 300 THEN 1 WHEN r.r > front THEN 2 ELSE 3 END AS INTEGER) AS state FROM r LEFT JOIN f ON r.ray = f.ray WHERE frame % 2 = 1""")
def memory_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN16, AGG19: remembered points against the nearest return of their ray bin."""
    ray = G.cell("x_mm", 2500) * 1000 + G.cell("y_mm", 2500)
    r = points(spark, sf_dir).select("frame", "pt", ray.alias("ray"), (F.col("z_mm") + 3000).alias("r"))
    return joins.ray_visibility(r.where("frame % 2 = 1"), r.where("frame % 2 = 0"), 300)


PIXELS = f"""{POINTS}, px AS (SELECT frame, pt, CAST(floor(x_mm / 500.0) AS BIGINT) AS u, CAST(floor(y_mm / 500.0) AS BIGINT) AS v, CAST(z_mm + 3000 AS BIGINT) AS z FROM points)"""


@query(f"""WITH {PIXELS}, w AS (SELECT a.frame, a.pt, any_value(a.u) AS u, any_value(a.v) AS v, any_value(a.z) AS z, min(b.z) AS lo, max(b.z) AS hi FROM px a JOIN px b ON a.frame = b.frame AND abs(a.u - b.u) <= 3 AND abs(a.v - b.v) <= 3 GROUP BY ALL)
SELECT frame, pt, u, v, z, z <= lo + 500 AS visible, hi - lo > 500 AS edge FROM w""")
def dilated_z_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN17, JOIN18, WIN19: visibility and depth edges in a dilated pixel window."""
    px = points(spark, sf_dir).select("frame", "pt", G.cell("x_mm", 500).alias("u"), G.cell("y_mm", 500).alias("v"), (F.col("z_mm") + 3000).alias("z"))
    return joins.z_buffer(px, 3, 500)


@query(f"WITH {PIXELS} SELECT frame, pt, z, z = min(z) OVER (PARTITION BY frame, CAST(floor(u / 3.0) AS BIGINT), CAST(floor(v / 3.0) AS BIGINT)) AS nearest FROM px")
def cell_z_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN19: the nearest point of each coarse cell, by a window."""
    from pyspark.sql import Window as W

    px = points(spark, sf_dir).select("frame", "pt", G.cell("x_mm", 500).alias("u"), G.cell("y_mm", 500).alias("v"), (F.col("z_mm") + 3000).alias("z"))
    w = W.partitionBy("frame", G.cell("u", 3), G.cell("v", 3))
    return px.select("frame", "pt", "z", (F.col("z") == F.min("z").over(w)).alias("nearest"))


# A sweep's sensor wanders over the scene; it moves 50 mm in each of its four time bins and turns by a ratio of 3 to 4.
ORIGIN = {"ox": "((frame * 7919) % 80 - 40) * 1000 + bin * 50", "oy": "((frame * 31) % 40 - 20) * 1000", "oz": "0"}
CARVED = f"""{MAP}, vox AS (SELECT key, CAST((((key >> 42) & 2097151) - 1048576) * {VOXEL} + {VOXEL // 2} AS DOUBLE) AS x, CAST((((key >> 21) & 2097151) - 1048576) * {VOXEL} + {VOXEL // 2} AS DOUBLE) AS y, CAST(((key & 2097151) - 1048576) * {VOXEL} + {VOXEL // 2} AS DOUBLE) AS z FROM fused WHERE cls IN (1, 2, 3, 4, 5, 6, 8, 9)),
org AS (SELECT frame, CAST(bin AS INTEGER) AS bin, CAST({ORIGIN["ox"]} AS DOUBLE) AS ox, CAST({ORIGIN["oy"]} AS DOUBLE) AS oy, CAST(0 AS DOUBLE) AS oz, 0.6 AS c, 0.8 AS s FROM (SELECT DISTINCT frame FROM points), range(4) t(bin)),
raw AS (SELECT p.frame, 0.6 * (x_mm - ox) + 0.8 * (y_mm - oy) AS x, 0.6 * (y_mm - oy) - 0.8 * (x_mm - ox) AS y, CAST(z_mm AS DOUBLE) - oz AS z FROM points p JOIN org o ON p.frame = o.frame AND o.bin = 2),
px AS (SELECT frame, r, CAST(floor((z / greatest(r, 0.001) - (-0.5)) * 32.0) AS INTEGER) AS row, CAST(least(floor((atan2(y, x) + 3.141592653589793) * (360 / (2 * 3.141592653589793))), 359) AS INTEGER) AS col FROM (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM raw)),
base AS (SELECT frame, row, col, min(r) AS here FROM px WHERE row BETWEEN 0 AND 31 GROUP BY ALL),
img AS (SELECT frame, row + i AS row, (col + j + 360) % 360 AS col, min(CASE WHEN i = 0 AND j = 0 THEN here END) AS here, min(here) AS near FROM base, (VALUES (-1), (0), (1)) x(i), (VALUES (-1), (0), (1)) y(j) WHERE row + i >= 0 GROUP BY ALL),
mid AS (SELECT *, CAST(floor(ox / 20000.0) AS BIGINT) + i AS tx, CAST(floor(oy / 20000.0) AS BIGINT) + j AS ty FROM org, (VALUES (-1), (0), (1)) x(i), (VALUES (-1), (0), (1)) y(j) WHERE bin = 2),
cand AS (SELECT v.key, v.x, v.y, v.z, m.frame, CAST(least(floor((atan2(c * (y - oy) - s * (x - ox), c * (x - ox) + s * (y - oy)) + 3.141592653589793) * (4 / (2 * 3.141592653589793))), 3) AS INTEGER) AS bin
  FROM vox v JOIN mid m ON CAST(floor(v.x / 20000.0) AS BIGINT) = m.tx AND CAST(floor(v.y / 20000.0) AS BIGINT) = m.ty WHERE abs(x - ox) < 20000 AND abs(y - oy) < 20000 AND abs(z - oz) < 20000),
loc AS (SELECT d.key, d.frame, c * (x - ox) + s * (y - oy) AS x, c * (y - oy) - s * (x - ox) AS y, z - oz AS z FROM cand d JOIN org USING (frame, bin)),
put AS (SELECT key, frame, r, CAST(floor((z / greatest(r, 0.001) - (-0.5)) * 32.0) AS INTEGER) AS row, CAST(least(floor((atan2(y, x) + 3.141592653589793) * (360 / (2 * 3.141592653589793))), 359) AS INTEGER) AS col FROM (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM loc) WHERE r BETWEEN 500 AND 20000),
look AS (SELECT key, frame, near > r + 500 AS free, abs(here - r) <= 500 AS seen FROM put JOIN img USING (frame, row, col) WHERE here IS NOT NULL)"""


def _looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointweave.operators import carving
    from pointweave.operators.fusion import vote_map

    p, image = points(spark, sf_dir), carving.SweepImage()
    key = G.voxel_key(F.col("x_mm"), F.col("y_mm"), F.col("z_mm"), VOXEL)
    movable = vote_map(p, key).where(F.col("cls").isin(1, 2, 3, 4, 5, 6, 8, 9))
    voxels = movable.select("key", *(((c * VOXEL) + VOXEL // 2).cast("double").alias(a) for a, c in zip("xyz", G.decode_key("key"), strict=True)))
    bins = p.select("frame").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(3))))
    origins = bins.select("frame", "bin", *(F.expr(e).cast("double").alias(c) for c, e in ORIGIN.items()), F.lit(0.6).alias("cos"), F.lit(0.8).alias("sin"))
    raw = p.join(origins.where("bin = 2"), "frame").selectExpr("frame", "cos * (x_mm - ox) + sin * (y_mm - oy) AS x", "cos * (y_mm - oy) - sin * (x_mm - ox) AS y", "z_mm - oz AS z")
    return carving.carve(voxels, origins, carving.sweep_image(raw, image), image, 4)


@query(f"WITH {CARVED} SELECT key, count(*) FILTER (free) AS n_free, count(*) FILTER (seen) AS n_seen, count(*) AS n_tested FROM look GROUP BY key")
def free_space_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN20, FLT09: movable voxels within reach of each sweep against its range image, in two passes over its time bins; cumulative votes."""
    from pointweave.operators import carving

    return carving.carve_votes(_looks(spark, sf_dir))


@query(f"""WITH {CARVED}, l AS (SELECT *, max(CASE WHEN seen THEN frame END) OVER (PARTITION BY key) AS last FROM look)
SELECT key, count(*) FILTER (free AND (last IS NULL OR frame > last)) AS n_free, count(*) FILTER (seen) AS n_seen, count(*) AS n_tested FROM l GROUP BY key""")
def consecutive_free_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-12: votes since the voxel was last seen."""
    from pointweave.operators import carving

    return carving.carve_votes(_looks(spark, sf_dir), reset_on_seen=True)


BOXES = """box AS (SELECT CAST(floor(o_orderkey / 250) AS INTEGER) AS frame, o_orderkey AS box, CAST(o_custkey % 16 AS INTEGER) AS label, o_custkey % 9 AS annotated, CAST((o_custkey % 20 - 10) * 5000 AS DOUBLE) AS cx, CAST((o_custkey % 10 - 5) * 5000 AS DOUBLE) AS cy, 0.0 AS cz,
  CASE o_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.6 END AS qw, CASE o_custkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.6 ELSE 0.8 END AS qz, CAST(16000 + o_custkey % 7 * 1000 AS DOUBLE) AS length, 12000.0 AS width, 4000.0 AS height FROM orders),
reach AS (SELECT *, sqrt(length * length + width * width + height * height) / 2 + 0.01 AS radius FROM box WHERE annotated >= 5),
near AS (SELECT frame, box, label, cx, cy, cz, qw, qz, length, width, height, CAST(floor((cx - radius) / 10000.0) AS BIGINT) AS x0, CAST(floor((cx + radius) / 10000.0) AS BIGINT) AS x1, CAST(floor((cy - radius) / 10000.0) AS BIGINT) AS y0, CAST(floor((cy + radius) / 10000.0) AS BIGINT) AS y1 FROM reach),
cell AS (SELECT frame, box, label, cx, cy, cz, qw, qz, length, width, height, x0 + i.k AS gx, y0 + j.k AS gy FROM near, (VALUES (0), (1), (2), (3)) i(k), (VALUES (0), (1), (2), (3)) j(k) WHERE x0 + i.k <= x1 AND y0 + j.k <= y1),
p AS (SELECT frame, pt, x_mm, y_mm, z_mm, cls, CAST(floor(x_mm / 10000.0) AS BIGINT) AS gx, CAST(floor(y_mm / 10000.0) AS BIGINT) AS gy FROM points),
h AS (SELECT p.frame, p.pt, count(*) AS n, min(box) AS box FROM p JOIN cell c ON p.frame = c.frame AND p.gx = c.gx AND p.gy = c.gy AND p.cls = c.label
  WHERE abs((x_mm - cx) * (1 - 2 * (qz * qz)) + (y_mm - cy) * (2 * qz * qw)) <= length / 2 + 0.01 AND abs((y_mm - cy) * (1 - 2 * (qz * qz)) - (x_mm - cx) * (2 * qz * qw)) <= width / 2 + 0.01 AND abs(z_mm - cz) <= height / 2 + 0.01 GROUP BY ALL),
owned AS (SELECT p.frame, p.pt AS id, x_mm AS x, y_mm AS y, z_mm AS z, cls, CASE WHEN n > 1 THEN -2 ELSE box END AS owner FROM points p LEFT JOIN h ON p.frame = h.frame AND p.pt = h.pt)"""


def _owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = lambda a, b, c: F.when(F.col("o_custkey") % 3 == 0, a).when(F.col("o_custkey") % 3 == 1, b).otherwise(c)
    boxes = table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_orderkey") / 250).cast("int").alias("frame"), F.col("o_orderkey").alias("box"), (F.col("o_custkey") % 16).cast("int").alias("label"), (F.col("o_custkey") % 9).alias("annotated"),
        ((F.col("o_custkey") % 20 - 10) * 5000).cast("double").alias("cx"), ((F.col("o_custkey") % 10 - 5) * 5000).cast("double").alias("cy"), F.lit(0.0).alias("cz"),
        turn(1.0, 0.8, 0.6).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), turn(0.0, 0.6, 0.8).alias("qz"),
        (16000 + F.col("o_custkey") % 7 * 1000).cast("double").alias("length"), F.lit(12000.0).alias("width"), F.lit(4000.0).alias("height"),
    )
    p = points(spark, sf_dir).select("frame", F.col("pt").alias("id"), F.col("x_mm").alias("x"), F.col("y_mm").alias("y"), F.col("z_mm").alias("z"), "cls")
    return joins.points_in_boxes(p, boxes, 10_000)


@query(f"WITH {POINTS}, {BOXES} SELECT frame, id, x, y, z, cls, owner FROM owned")
def point_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN21, PRJ33: the turned annotation box of a point's own class that holds it; several are ambiguous."""
    return _owned(spark, sf_dir)


@query(f"WITH {POINTS}, {BOXES} SELECT frame, owner, count(*) AS n FROM owned WHERE owner IS NOT NULL AND owner <> -2 GROUP BY ALL HAVING count(*) >= 5")
def box_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN21: objects of five points or more."""
    return joins.box_groups(_owned(spark, sf_dir))


@query(f"""WITH {TRACKS}, p AS (SELECT *, lag(frame) OVER w = frame - 1 AND stamp_us - lag(stamp_us) OVER w <= 30000000000 AS next, lag(base) OVER w AS lb, lag(temporal) OVER w AS lt FROM tracks WINDOW w AS (PARTITION BY user_id, event_type ORDER BY frame))
SELECT user_id, event_type, frame, CASE WHEN next THEN lb END AS prev_base, NOT base AND coalesce(next AND lb, false) AS opportunity, coalesce(next AND lt <> temporal, false) AS changed FROM p""")
def previous_frame_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN22, JOIN23, WIN10: the same track exactly one frame before and at most so long ago, errors that it could have repaired, and changes of class."""
    p = ordered.previous(tracks(spark, sf_dir), ["user_id", "event_type"], "frame", ["base", "temporal", "stamp_us"])
    fresh = F.coalesce(F.col("stamp_us") - F.col("prev_stamp_us") <= 30_000_000_000, F.lit(False))
    changed = F.coalesce(fresh & (F.col("prev_temporal") != F.col("temporal")), F.lit(False))
    return p.select("user_id", "event_type", "frame", F.when(fresh, F.col("prev_base")).alias("prev_base"), (~F.col("base") & fresh & F.coalesce("prev_base", F.lit(False))).alias("opportunity"), changed.alias("changed"))


@query(f"""WITH {POINTS}, a AS (SELECT {key_sql('x_mm', 'y_mm', 'z_mm', VOXEL)} AS key, max(cls) AS cls FROM points WHERE frame % 2 = 0 GROUP BY 1), b AS (SELECT {key_sql('x_mm', 'y_mm', 'z_mm', VOXEL)} AS key, max(cls) AS cls FROM points WHERE frame % 2 = 1 GROUP BY 1)
SELECT key, a.cls AS a, b.cls AS b, CASE WHEN a.cls IS NULL THEN 'b_only' WHEN b.cls IS NULL THEN 'a_only' ELSE 'shared' END AS side FROM a FULL OUTER JOIN b USING (key)""")
def map_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN03: shared keys and those of one map only."""
    key = G.voxel_key(F.col("x_mm"), F.col("y_mm"), F.col("z_mm"), VOXEL)
    a, b = (points(spark, sf_dir).where(F.pmod("frame", F.lit(2)) == k).groupBy(key.alias("key")).agg(F.max("cls").alias("cls")) for k in (0, 1))
    return joins.compare_maps(a, b)


@query(f"""WITH {POINTS}, k AS (SELECT {key_sql('x_mm', 'y_mm', 'z_mm', VOXEL)} AS key, frame, gt, cls FROM points), base AS (SELECT DISTINCT key FROM k WHERE frame % 3 = 0),
g AS (SELECT key, max(gt) AS gt FROM k WHERE frame % 3 = 1 AND gt >= 0 GROUP BY key), c AS (SELECT key, min(cls) AS cls FROM k WHERE frame % 3 = 2 GROUP BY key)
SELECT key, gt, cls, gt IS NOT NULL AND cls IS NOT NULL AS confirmed FROM base LEFT JOIN g USING (key) LEFT JOIN c USING (key)""")
def confirmation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN24: two left joins onto the map's keys."""
    k = points(spark, sf_dir).select(G.voxel_key(F.col("x_mm"), F.col("y_mm"), F.col("z_mm"), VOXEL).alias("key"), "frame", "gt", "cls")
    g = k.where("frame % 3 = 1 AND gt >= 0").groupBy("key").agg(F.max("gt").alias("gt"))
    c = k.where("frame % 3 = 2").groupBy("key").agg(F.min("cls").alias("cls"))
    out = k.where("frame % 3 = 0").select("key").distinct().join(g, "key", "left").join(c, "key", "left")
    return out.withColumn("confirmed", F.col("gt").isNotNull() & F.col("cls").isNotNull())


KEYFRAMES = """k AS (SELECT o_orderkey AS id, o_orderkey * 3 AS t, o_custkey * 40 AS x, CAST(floor(o_totalprice / 10) AS BIGINT) AS y FROM orders)"""


@query(f"""WITH {KEYFRAMES} SELECT i.id AS i, j.id AS j, (i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y) AS d2 FROM k i JOIN k j
ON j.t - i.t > 30 AND abs(i.x - j.x) < 200 AND abs(i.y - j.y) < 200 WHERE d2 < 40000""")
def loop_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN25: keyframes near in place and far in time."""
    o = table(spark, sf_dir, "orders")
    k = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 3).alias("t"), (F.col("o_custkey") * 40).alias("x"), F.floor(F.col("o_totalprice") / 10).alias("y"))
    return joins.loop_candidates(k, 200, 30, 40_000)


@query("""WITH e AS (SELECT DISTINCT doc_id FROM documents), f AS (SELECT DISTINCT doc_id + CASE WHEN doc_id % 7 = 0 THEN 100000000 ELSE 0 END AS doc_id FROM labels)
SELECT doc_id, 'missing' AS kind FROM e WHERE doc_id NOT IN (SELECT doc_id FROM f) UNION ALL SELECT doc_id, 'extra' FROM f WHERE doc_id NOT IN (SELECT doc_id FROM e)""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN26, SNK07: anti joins both ways."""
    f = table(spark, sf_dir, "labels").select((F.col("doc_id") + F.when(F.col("doc_id") % 7 == 0, 100_000_000).otherwise(0)).alias("doc_id"))
    return joins.keep_unmatched(table(spark, sf_dir, "documents"), f, "doc_id")


@query(f"""WITH {POINTS}, lut AS (SELECT * FROM (VALUES (0, 'road'), (1, 'car'), (2, 'truck'), (3, 'person'), (4, 'vegetation'), (5, 'building')) t(cls, name))
SELECT coalesce(name, 'unmapped') AS name, count(*) AS n FROM points LEFT JOIN lut USING (cls) GROUP BY 1""")
def label_space_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN01: a label space as a dimension table of fixed size; classes outside it get the sentinel."""
    lut = spark.createDataFrame([(0, "road"), (1, "car"), (2, "truck"), (3, "person"), (4, "vegetation"), (5, "building")], "cls int, name string")
    return points(spark, sf_dir).join(F.broadcast(lut), "cls", "left").groupBy(F.coalesce("name", F.lit("unmapped")).alias("name")).agg(F.count("*").alias("n"))
