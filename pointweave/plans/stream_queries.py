"""Queries of the streaming operators, clusters, consistency and solvers, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.functions import geometry as G
from pointweave.operators import clusters, solvers
from pointweave.operators.consistency import ConsistencyRules, consistent
from pointweave.operators.tables import new_path
from pointweave.plans.adapters import POINTS, TICKS, key_sql, points, table, ticks
from pointweave.plans.queries import ORACLE_SQL, query
from pointweave.streaming import machines, maps, runs

DAY = 86_400_000_000


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = runs.stream_of(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "ts", F.unix_micros("ts").alias("t_us"), F.round(F.col("value") * 100).cast("long").alias("v_cent"))


@query(ORACLE_SQL["gap_sessions"])
def stream_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-21: session windows over a stream, complete mode."""
    s = _event_stream(spark, sf_dir).groupBy("user_id", F.session_window("ts", "6 hours 1 microsecond").alias("s")).agg(F.count("*").alias("n"))
    return runs.complete_all(s.select("user_id", F.unix_micros("s.start").alias("start_us"), "n"), "sessions")


@query(ORACLE_SQL["exact_stamp_pairs"])
def stream_exact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-03, JOIN10: two streams joined on equal stamps, state bounded by watermarks, duplicates dropped within them."""
    t = _event_stream(spark, sf_dir).withColumns({"stamp": F.floor(F.col("t_us") / 3_600_000_000), "hour": F.date_trunc("hour", "ts")})

    def side(kind: str) -> DataFrame:
        rows = t.where(F.col("event_type") == kind).withWatermark("hour", "40 days")
        return rows.select("user_id", "stamp", "hour").dropDuplicates(["user_id", "stamp", "hour"])

    a, b = side("view"), side("error").withColumnRenamed("hour", "hour_b")
    pairs = a.join(b, (a.user_id == b.user_id) & (a.stamp == b.stamp) & (a.hour == b.hour_b)).select(a.user_id, a.stamp)
    return runs.append_all(pairs, "pairs")


@query(ORACLE_SQL["keyframe_thinning"])
def stream_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-04, WIN14: keyframes selected by a stateful fold per user."""
    rows = _event_stream(spark, sf_dir).select("user_id", "ts", "t_us")
    out = machines.fold_stream(rows, ["user_id"], ["t_us"], lambda: machines.Keyframes("user_id", DAY), "user_id long, t_us long, status string")
    return runs.append_all(out, "keyframes").where("status = 'accepted'").select("user_id", "t_us")


@query("SELECT event_id, user_id FROM events")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-14: an at-least-once stream, every event delivered twice, made exact within a watermark."""
    e = _event_stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withWatermark("ts", "40 days")
    return runs.append_all(e.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id"), "unique")


@query(f"""WITH {POINTS}, k AS (SELECT {key_sql('x_mm', 'y_mm', 'z_mm', 2000)} AS key, cls, CAST(sum(w_micro) AS BIGINT) AS w, count(*) AS n FROM (
  SELECT (l_partkey - 1000) * 50 AS x_mm, (l_suppkey - 50) * 500 AS y_mm, (CAST(l_quantity AS BIGINT) - 25) * 100 AS z_mm, CAST((l_partkey + l_linenumber) % 16 AS INTEGER) AS cls, 1000000 - CAST(round(l_discount * 100) AS BIGINT) * 10000 AS w_micro FROM lineitem) GROUP BY ALL)
SELECT key, cls, w, n FROM k""")
def stream_vote_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-05, STM-16: the vote table kept up to date by micro-batches, each of which writes only the tiles it touches."""
    line = runs.stream_of(spark, sf_dir, "lineitem")
    at = {"x": (F.col("l_partkey") - 1000) * 50, "y": (F.col("l_suppkey") - 50) * 500, "z": (F.col("l_quantity").cast("long") - 25) * 100}
    rows = line.select(
        G.voxel_key(*at.values(), 2000).alias("key"), F.pmod(F.col("l_partkey") + F.col("l_linenumber"), F.lit(16)).cast("int").alias("cls"),
        (1_000_000 - F.round(F.col("l_discount") * 100).cast("long") * 10_000).alias("w"), F.lit(1).cast("long").alias("n"), G.voxel_key(*at.values(), 16_000).alias("tile"),
    )
    kept = maps.IncrementalMap(spark, new_path(spark, "votes"), ["key", "cls"], ["w", "n"], "tile")
    return maps.follow(rows, kept).select("key", "cls", "w", "n")


@query(f"""WITH {TICKS}, r AS (SELECT user_id, event_id, t_us, v_cent, event_type = 'purchase' AS pose FROM ticks WHERE event_type IN ('purchase', 'click')),
q AS (SELECT *, max(CASE WHEN pose THEN t_us END) OVER w AS t0 FROM r WINDOW w AS (PARTITION BY user_id ORDER BY t_us ROWS UNBOUNDED PRECEDING))
SELECT q.user_id, q.event_id, CASE WHEN t0 IS NOT NULL AND q.t_us - t0 <= {DAY} THEN 'held' ELSE 'none' END AS mode, CASE WHEN q.t_us - t0 <= {DAY} THEN p.v_cent END AS v
FROM q LEFT JOIN r p ON p.user_id = q.user_id AND p.pose AND p.t_us = q.t0 WHERE NOT q.pose""")
def causal_pose_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-02, STM-19, STM-20: a live buffer answers only from poses that came before; held for a day at most."""
    t = ticks(spark, sf_dir).where("event_type IN ('purchase', 'click')").withColumn("kind", F.when(F.col("event_type") == "purchase", "pose").otherwise("query"))
    return machines.fold(t.select("user_id", "event_id", "t_us", "v_cent", "kind"), ["user_id"], ["t_us"], lambda: machines.PoseBuffer("user_id", DAY), "user_id long, event_id long, mode string, v long")


@query(f"""WITH {TICKS}, s AS (SELECT user_id, event_id, t_us, event_type AS session, min(t_us) OVER (PARTITION BY user_id, event_type) AS born FROM ticks),
m AS (SELECT *, max(born) OVER (PARTITION BY user_id ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS newest FROM s)
SELECT user_id, event_id, session, born = newest AS accepted FROM m""")
def session_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-13: a session that a newer one replaced is retired; its later rows are rejected."""
    t = ticks(spark, sf_dir).select("user_id", "event_id", "t_us", F.col("event_type").alias("session"))
    return machines.fold(t, ["user_id"], ["t_us"], lambda: machines.Sessions("user_id"), "user_id long, event_id long, session string, accepted boolean")


def stream_sql_ledger() -> str:
    votes = ", ".join(f"lag(t_us, {k}) OVER w AS t{k}, lag(label, {k}) OVER w AS l{k}" for k in (1, 2, 3))
    live = " UNION ALL ".join(f"SELECT user_id, event_id, l{k} AS label FROM h WHERE t{k} IS NOT NULL AND t_us - t{k} <= {DAY}" for k in (1, 2, 3))
    return f"""WITH {TICKS}, b AS (SELECT user_id, event_id, t_us, v_cent % 4 AS label FROM ticks), h AS (SELECT *, {votes} FROM b WINDOW w AS (PARTITION BY user_id ORDER BY t_us)), v AS ({live}),
c AS (SELECT user_id, event_id, label, count(*) AS n FROM v GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id, event_id) AS evidence, row_number() OVER (PARTITION BY user_id, event_id ORDER BY n DESC, label) AS place FROM c)
SELECT b.user_id, b.event_id, CAST(coalesce(r.evidence, 0) AS BIGINT) AS evidence, CAST(coalesce(r.label, -1) AS INTEGER) AS label FROM b LEFT JOIN r ON r.user_id = b.user_id AND r.event_id = b.event_id AND place = 1"""


@query(stream_sql_ledger())
def evidence_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-15, FLT15: three newest raw votes, valid up to a day inclusive, read before the row's own is written."""
    t = ticks(spark, sf_dir).select("user_id", "event_id", "t_us", F.pmod("v_cent", F.lit(4)).alias("label"))
    return machines.fold(t, ["user_id"], ["t_us"], lambda: machines.Ledger("user_id", 3, DAY), "user_id long, event_id long, evidence long, label int")


@query(ORACLE_SQL["causal_pose_buffer"])
def stream_pose_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-02 in a stream: the buffer lives in each key's state."""
    t = _event_stream(spark, sf_dir).where("event_type IN ('purchase', 'click')").withColumn("kind", F.when(F.col("event_type") == "purchase", "pose").otherwise("query"))
    out = machines.fold_stream(t.select("user_id", "ts", "event_id", "t_us", "v_cent", "kind"), ["user_id"], ["t_us"], lambda: machines.PoseBuffer("user_id", DAY), "user_id long, event_id long, mode string, v long")
    return runs.append_all(out, "poses")


@query(ORACLE_SQL["session_restarts"])
def stream_session_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-13 in a stream."""
    t = _event_stream(spark, sf_dir).select("user_id", "ts", "event_id", "t_us", F.col("event_type").alias("session"))
    out = machines.fold_stream(t, ["user_id"], ["t_us"], lambda: machines.Sessions("user_id"), "user_id long, event_id long, session string, accepted boolean")
    return runs.append_all(out, "restarts")


@query(ORACLE_SQL["evidence_ledger"])
def stream_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-15 in a stream."""
    t = _event_stream(spark, sf_dir).select("user_id", "ts", "event_id", "t_us", F.pmod("v_cent", F.lit(4)).alias("label"))
    out = machines.fold_stream(t, ["user_id"], ["t_us"], lambda: machines.Ledger("user_id", 3, DAY), "user_id long, event_id long, evidence long, label int")
    return runs.append_all(out, "evidence")


@query()
def stream_packet_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-07 in a stream; equals packet_claims."""
    t = _event_stream(spark, sf_dir).where("event_type IN ('view', 'signup')").withColumn("kind", F.when(F.col("event_type") == "signup", "graph").otherwise("packet"))
    rows = t.select("user_id", "ts", "t_us", F.floor(F.col("t_us") / 1_000_000).alias("stamp"), "kind")
    out = machines.fold_stream(rows, ["user_id"], ["t_us"], lambda: machines.Claims("user_id", 3, 432_000), "user_id long, claimed array<long>, evicted array<long>")
    return runs.append_all(out, "claims")


INSTANCE = "user_id long, track int, t double, epoch int, reason string, label int"


def _observations(t: DataFrame) -> DataFrame:
    k = F.pmod("v_cent", F.lit(3))
    p = F.array(*(F.when(k == c, 0.7).otherwise(0.15) for c in range(3)))
    time = ["ts"] if "ts" in t.columns else []
    return t.select("user_id", *time, F.lit("s").alias("session"), (F.col("t_us") / 1e12).alias("t"), F.pmod("event_id", F.lit(4)).alias("track"), (F.col("v_cent") % 50 / 100.0).alias("x"), p.alias("p"))


@query()
def instance_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-08, EVL09: the instance state machine over observations; its rules are tested on small fixtures."""
    return machines.fold(_observations(ticks(spark, sf_dir)), ["user_id"], ["t", "track"], lambda: machines.Instances("user_id"), INSTANCE)


@query()
def stream_instance_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-08 in a stream; equals instance_semantics."""
    out = machines.fold_stream(_observations(_event_stream(spark, sf_dir)), ["user_id"], ["t", "track"], lambda: machines.Instances("user_id"), INSTANCE)
    return runs.append_all(out, "instances")


@query(f"""WITH RECURSIVE {POINTS}, c AS (SELECT DISTINCT frame, cls, {key_sql('x_mm', 'y_mm', 'z_mm', 2500)} AS key, CAST(floor(x_mm / 2500.0) AS BIGINT) AS x, CAST(floor(y_mm / 2500.0) AS BIGINT) AS y, CAST(floor(z_mm / 2500.0) AS BIGINT) AS z FROM points),
e AS (SELECT a.frame, a.cls, a.key, b.key AS near FROM c a JOIN c b ON a.frame = b.frame AND a.cls = b.cls AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1),
r AS (SELECT frame, cls, key, key AS other FROM c UNION SELECT r.frame, r.cls, r.key, e.near FROM r JOIN e ON e.frame = r.frame AND e.cls = r.cls AND e.key = r.other),
l AS (SELECT frame, cls, key, min(other) AS cluster FROM r GROUP BY ALL)
SELECT frame, cls, cluster, count(*) AS cells, max(x) - min(x) + 1 AS extent_x, max(y) - min(y) + 1 AS extent_y, max(z) - min(z) + 1 AS extent_z FROM l JOIN c USING (frame, cls, key) GROUP BY frame, cls, cluster HAVING count(*) >= 2""")
def cell_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF01, FLT19: 26-connected clusters of the cells that each class occupies in a frame."""
    key = G.voxel_key(F.col("x_mm"), F.col("y_mm"), F.col("z_mm"), 2500)
    found = clusters.connected_cells(points(spark, sf_dir).select("frame", "cls", key.alias("key")), ["frame", "cls"])
    return clusters.cluster_sizes(found, ["frame", "cls"], 2)


@query(f"""WITH RECURSIVE {POINTS}, p AS (SELECT frame, cls, pt, x_mm / 40000.0 AS x, y_mm / 40000.0 AS y, z_mm / 40000.0 AS z FROM points),
s AS (SELECT frame, cls, count(*) AS n, least(1.0, greatest(0.25, median(sqrt(x * x + y * y + z * z)) * 0.025)) AS radius FROM p GROUP BY ALL HAVING count(*) BETWEEN 6 AND 2048),
m AS (SELECT a.frame, a.cls, a.pt, b.pt AS near, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2, radius FROM p a JOIN s USING (frame, cls) JOIN p b ON b.frame = a.frame AND b.cls = a.cls AND b.pt <> a.pt),
l AS (SELECT frame, cls, pt, near FROM m WHERE sqrt(d2) < radius QUALIFY row_number() OVER (PARTITION BY frame, cls, pt ORDER BY d2, near) <= 11),
e AS (SELECT * FROM l UNION SELECT frame, cls, near, pt FROM l),
r AS (SELECT frame, cls, pt, pt AS other FROM p JOIN s USING (frame, cls) UNION SELECT r.frame, r.cls, r.pt, e.near FROM r JOIN e ON e.frame = r.frame AND e.cls = r.cls AND e.pt = r.other),
c AS (SELECT frame, cls, pt, min(other) AS cluster FROM r GROUP BY ALL), k AS (SELECT frame, cls, cluster, count(*) AS size FROM c GROUP BY ALL),
b AS (SELECT k.* FROM k JOIN s USING (frame, cls) WHERE size >= 6 AND size >= 0.6 * n QUALIFY row_number() OVER (PARTITION BY frame, cls ORDER BY size DESC, cluster) = 1)
SELECT p.frame, p.cls, p.pt, p.x, p.y, p.z FROM p JOIN c USING (frame, cls, pt) JOIN b USING (frame, cls, cluster)""")
def main_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF02: the points of each object's largest surface, by links to nearest neighbours, objects being the points of one class in a frame."""
    p = points(spark, sf_dir).select("frame", "cls", "pt", *((F.col(f"{a}_mm") / 40000.0).alias(a) for a in "xyz"))
    return clusters.main_surface(p, ["frame", "cls"], "pt")


@query()
def causal_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-09: points of consecutive frames, moved by the relative pose, matched within bounds along their rays, and mixed."""
    p = points(spark, sf_dir)
    top = 0.4 + F.pmod("w_micro", F.lit(7)) / 10.0 * 0.9
    posterior = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.when(k == F.col("cls"), top).otherwise((1 - top) / 15))
    rows = p.select(F.lit(0).alias("stream"), "frame", (F.col("frame") * 0.5).alias("stamp"), "pt", *((F.col(f"{a}_mm") / 1000.0).alias(a) for a in "xyz"), posterior.alias("p"))
    turn = {f"r{i}{j}": F.lit(1.0 if i == j else 0.0) for i in (1, 2, 3) for j in (1, 2, 3)}
    relative = rows.select("stream", "frame").distinct().withColumns({**turn, "tx": F.pmod("frame", F.lit(3)) * 0.3, "ty": F.lit(-0.2), "tz": F.lit(0.0)})
    return consistent(rows, ConsistencyRules(radius=2.0, radial=0.8), relative)


@query()
def principal_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG26: extent of each class of a frame along its principal axis."""
    return solvers.principal_extents(points(spark, sf_dir), ["frame", "cls"])


@query()
def surface_eigenvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SOL05: closed-form eigenvalues of cell covariances."""
    c = solvers.cell_covariances(points(spark, sf_dir), 16000)
    e = solvers.eigenvalues({k: F.col(k) for k in ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")})
    return c.select("gx", "gy", *(x.alias(f"e{k}") for k, x in enumerate(e)))


@query()
def trajectory_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SOL04, AGG41 (ATE): error after rigid alignment of two trajectories, here one turned, shifted and jittered."""
    t = ticks(spark, sf_dir).where("event_type = 'purchase'")
    x, y = F.col("v_cent") / 100.0, (F.col("event_id") % 100).cast("double")
    jitter = F.pmod("v_cent", F.lit(5)) / 50.0
    rows = t.select(F.col("user_id").alias("track"), F.col("t_us").alias("t"), x.alias("ax"), y.alias("ay"), F.lit(0.0).alias("az"), (-y + 3 + jitter).alias("bx"), (x - 2).alias("by"), F.lit(1.0).alias("bz"))
    return solvers.trajectory_error(rows)


@query()
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG40: percentile interval of a rate by 5,000 resamples of whole scenes; draws come from a hash, so reruns agree."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    scenes = o.groupBy(F.col("c_nationkey").alias("scene")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("hit"), F.count("*").alias("n"))
    rate = solvers.resampled_rates(scenes, ["scene"], "hit", "n", 5_000)
    q = F.percentile("rate", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return rate.agg(q.alias("q")).select(*(F.col("q")[k].alias(n) for k, n in enumerate(("low", "middle", "high"))))


@query()
def pose_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SOL02, SOL03, GRF03: each user's walk as a pose graph of odometry and loops, solved again at every loop."""
    w = W.partitionBy("user_id").orderBy("t_us", "event_id")
    t = ticks(spark, sf_dir).withColumn("k", F.row_number().over(w) - 1).withColumn("log", F.floor(F.col("k") / 50).cast("int"))
    t = t.withColumn("k", (F.col("k") % 50).cast("int"))
    step = {"x": 1 + F.pmod("v_cent", F.lit(7)) / 10.0, "y": F.pmod("v_cent", F.lit(5)) / 10.0 - 0.2, "angle": (F.pmod("v_cent", F.lit(9)) - 4) / 10.0}
    odometry = t.where("k > 0").select("user_id", "log", (F.col("k") - 1).alias("i"), F.col("k").alias("j"), *(c.alias(n) for n, c in step.items()), F.lit(1.0).alias("weight"))
    loops = t.where("k % 16 = 15").select("user_id", "log", (F.col("k") - 12).alias("i"), F.col("k").alias("j"), F.lit(0.5).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("angle"), F.lit(10.0).alias("weight"))
    return solvers.graph_corrections(odometry.unionByName(loops), ["user_id", "log"], most=50)


def _costs(t: DataFrame) -> DataFrame:
    return t.select("user_id", "ts", "event_id", "t_us", (F.col("v_cent") * 3_000_000).alias("cost"))


@query()
def queue_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-01: a worker with two waiting rows at most; later ones are dropped and counted."""
    rows = _costs(_event_stream(spark, sf_dir))
    out = machines.fold_stream(rows, ["user_id"], ["t_us", "event_id"], lambda: machines.BoundedQueue("user_id", 2), "user_id long, event_id long, served boolean, wait long, dropped long")
    return runs.append_all(out, "queue")


@query(f"""WITH RECURSIVE {TICKS}, r AS (SELECT user_id, event_id, t_us, least(greatest(2 * v_cent * 3000000, 3600000000), {DAY}) AS pause, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS k FROM ticks),
f AS (SELECT user_id, k, event_id, true AS published, t_us + pause AS due FROM r WHERE k = 1
UNION ALL SELECT r.user_id, r.k, r.event_id, r.t_us >= f.due, CASE WHEN r.t_us >= f.due THEN r.t_us + r.pause ELSE f.due END FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1)
SELECT user_id, event_id, published FROM f""")
def snapshot_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-17: snapshots no more often than their cost allows."""
    out = machines.fold_stream(_costs(_event_stream(spark, sf_dir)), ["user_id"], ["t_us", "event_id"], lambda: machines.Throttle("user_id", 2, 3_600_000_000, DAY), "user_id long, event_id long, published boolean")
    return runs.append_all(out, "throttled")
