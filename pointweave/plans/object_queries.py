"""Queries of objects, masks, fields, descriptors and the remaining machines, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.functions import geometry as G
from pointweave.operators import joins, objects, ordered
from pointweave.plans.adapters import PLACES, POINTS, TICKS, key_sql, places, points, table, ticks
from pointweave.plans.queries import query
from pointweave.streaming import machines


@query(f"""WITH {POINTS}, s AS (SELECT frame, pt AS id, (x_mm + 50000) / 10000.0 AS u, (y_mm + 25000) / 10000.0 AS v FROM points),
f AS (SELECT frame, CAST(floor((x_mm + 50000) / 10000.0) AS INTEGER) AS iu, CAST(floor((y_mm + 25000) / 10000.0) AS INTEGER) AS iv, cls, CAST(count(*) AS DOUBLE) AS p FROM points GROUP BY ALL),
c AS (SELECT frame, id, least(greatest(CAST(floor(u) AS INTEGER) + a, 0), 9) AS iu, least(greatest(CAST(floor(v) AS INTEGER) + b, 0), 4) AS iv,
  (CASE WHEN a = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN b = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS w FROM s, (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b)),
m AS (SELECT c.frame, id, cls, CAST(sum(CAST(floor(w * p * 1000000 + 0.5) AS BIGINT)) AS BIGINT) AS p FROM c JOIN f ON c.frame = f.frame AND c.iu = f.iu AND c.iv = f.iv GROUP BY ALL)
SELECT frame, id, cls, p FROM (SELECT *, row_number() OVER (PARTITION BY frame, id ORDER BY p DESC, cls) AS place FROM m) WHERE place = 1""")
def bilinear_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ19: a probability field sampled between its places, argmax after."""
    p = points(spark, sf_dir).withColumns({"u": (F.col("x_mm") + 50000) / 10000.0, "v": (F.col("y_mm") + 25000) / 10000.0})
    field = p.groupBy("frame", F.floor("u").cast("int").alias("iu"), F.floor("v").cast("int").alias("iv"), "cls").agg(F.count("*").cast("double").alias("p"))
    return objects.bilinear(p.select("frame", F.col("pt").alias("id"), "u", "v"), field, 10, 5)


@query(f"""WITH {POINTS}, m AS (SELECT DISTINCT frame, CAST(floor(x_mm / 10000.0) AS BIGINT) AS u, CAST(floor(y_mm / 10000.0) AS BIGINT) AS v, CAST(floor(x_mm / 60000.0) AS BIGINT) AS id FROM points),
s AS (SELECT frame, u, v, min(id) AS id FROM m GROUP BY ALL HAVING min(id) = max(id))
SELECT a.frame, a.u, a.v, a.id FROM s a JOIN s b ON a.frame = b.frame AND a.id = b.id AND abs(a.u - b.u) <= 1 AND abs(a.v - b.v) <= 1 GROUP BY ALL HAVING count(*) = 9""")
def mask_interior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT17: eroded masks without overlaps, separably."""
    m = points(spark, sf_dir).select("frame", G.cell("x_mm", 10000).alias("u"), G.cell("y_mm", 10000).alias("v"), G.cell("x_mm", 60000).alias("id")).distinct()
    return objects.interior(m, 1)


@query(f"""WITH {TICKS}, b AS (SELECT user_id, CAST(least(greatest(floor(v_cent / 30000.0 * 24), 0), 23) AS INTEGER) AS bin, count(*) AS n FROM ticks GROUP BY ALL), f AS (SELECT DISTINCT user_id, i AS bin FROM ticks, range(24) t(i))
SELECT f.user_id, CAST(f.bin AS INTEGER) AS bin, (coalesce(n, 0) + 0.001) / (sum(coalesce(n, 0)) OVER (PARTITION BY f.user_id) + 0.024) AS share FROM f LEFT JOIN b ON f.user_id = b.user_id AND f.bin = b.bin""")
def smoothed_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR11: 24 smoothed bins, all present."""
    return objects.histogram(ticks(spark, sf_dir), ["user_id"], F.col("v_cent"), 0, 30000, 24, 0.001)


@query(f"""WITH {TICKS}, q AS (SELECT event_id AS q, user_id, t_us FROM ticks WHERE event_type = 'click'), p AS (SELECT q, event_id AS k, -(q.t_us - t.t_us) / 86400000000.0 AS s FROM q JOIN ticks t ON t.user_id = q.user_id AND t.event_type = 'purchase' AND t.t_us < q.t_us AND q.t_us - t.t_us <= 172800000000),
e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY q)) AS e FROM p) SELECT q, k, CAST(floor(e / sum(e) OVER (PARTITION BY q) * 1000000 + 0.5) AS BIGINT) AS weight FROM e UNION ALL SELECT q, NULL, 0 FROM q WHERE q NOT IN (SELECT q FROM p)""")
def attention_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR14: softmax over a query's candidates, explicit rows for queries without any."""
    t = ticks(spark, sf_dir)
    q = t.where("event_type = 'click'").select(F.col("event_id").alias("q"), "user_id", F.col("t_us").alias("tq"))
    near = joins.recent(q, t.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("k"), "t_us"), ["user_id"], "tq", "t_us", 172_800_000_000)
    out = objects.attention(q, near.select("q", "k", "tq", "t_us"), "q", -(F.col("tq") - F.col("t_us")) / 86_400_000_000.0)
    return out.select("q", "k", F.floor(F.col("weight") * 1_000_000 + 0.5).cast("long").alias("weight"))


DESCRIPTOR = f"""{POINTS}, {PLACES}, d AS (SELECT frame, CAST(pt % 12 AS INTEGER) AS sector, CAST(cls % 5 AS INTEGER) AS ring, max(z_mm + 3000) AS h FROM points GROUP BY ALL), n AS (SELECT frame, sector, sum(h * h) AS hh FROM d GROUP BY ALL),
x AS (SELECT a.frame AS i, b.frame AS j, a.sector AS sa, b.sector AS sb, (a.sector - b.sector + 12) % 12 AS shift, sum(a.h * b.h) AS ab FROM d a JOIN loops ON a.frame = loops.i JOIN d b ON b.frame = loops.j AND a.ring = b.ring GROUP BY ALL)"""


@query(f"""WITH {DESCRIPTOR}, p AS (SELECT i, j, shift, CAST(sum(CAST(floor((1 - ab / (sqrt(CAST(na.hh AS DOUBLE)) * sqrt(CAST(nb.hh AS DOUBLE)))) * 1000000 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 1000000 AS distance FROM x JOIN n na ON na.frame = i AND na.sector = sa JOIN n nb ON nb.frame = j AND nb.sector = sb GROUP BY ALL)
SELECT i, j, distance, CAST(shift AS INTEGER) AS shift FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY distance, shift) AS place FROM p) WHERE place = 1""")
def yaw_shift_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR10, GRF (loop search): the turn that brings two descriptors closest, of all sweeps near in place and apart in time."""
    d = points(spark, sf_dir).groupBy("frame", F.pmod("pt", F.lit(12)).alias("sector"), F.pmod("cls", F.lit(5)).alias("ring")).agg(F.max(F.col("z_mm") + 3000).alias("h"))
    return objects.loop_yaws(places(spark, sf_dir), d, 30_000, 3, 900_000_000, 12)


@query(f"""WITH {POINTS} SELECT frame, {key_sql('x_mm', 'y_mm', 'z_mm', 8000)} AS key, CAST(sum(x_mm) AS DOUBLE) / count(*) AS x, CAST(sum(y_mm) AS DOUBLE) / count(*) AS y, CAST(sum(z_mm) AS DOUBLE) / count(*) AS z FROM points GROUP BY ALL""")
def centroid_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG38."""
    key = G.voxel_key(F.col("x_mm"), F.col("y_mm"), F.col("z_mm"), 8000)
    return points(spark, sf_dir).groupBy("frame", key.alias("key")).agg(*((F.sum(f"{a}_mm") / F.count("*")).alias(a) for a in "xyz"))


@query(f"""WITH {POINTS} SELECT frame, cls, count(*) AS n, CAST(count(*) FILTER (gt = pred) AS DOUBLE) / count(*) AS correct_fraction FROM points WHERE gt <> -1 GROUP BY ALL HAVING count(*) >= 5""")
def object_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG39."""
    o = points(spark, sf_dir).where("gt <> -1").groupBy("frame", "cls").agg(F.count("*").alias("n"), F.count_if(F.col("gt") == F.col("pred")).alias("hit"))
    return o.where("n >= 5").select("frame", "cls", "n", (F.col("hit") / F.col("n")).alias("correct_fraction"))


@query(f"""WITH {TICKS}, w AS (SELECT event_id, t_us / 1e11 AS t, v_cent / 100.0 AS v, user_id FROM ticks), l AS (SELECT event_id, t, {", ".join(f"lag(t, {k}) OVER o AS t{k}, lag(v, {k}) OVER o AS v{k}" for k in range(1, 5))} FROM w WINDOW o AS (PARTITION BY user_id ORDER BY t)),
s AS (SELECT event_id, {" + ".join(f"coalesce(exp(-(t - t{k}) / 1.5), 0)" for k in range(1, 5))} AS total, {" + ".join(f"coalesce(exp(-(t - t{k}) / 1.5) * v{k}, 0)" for k in range(1, 5))} AS mean FROM l) SELECT event_id, CAST(floor(mean / greatest(total, 1.0) * 10000 + 0.5) AS BIGINT) AS history FROM s""")
def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN12, PRJ26: four earlier values, age-weighted, worth one at most."""
    t = ticks(spark, sf_dir).select("event_id", "user_id", (F.col("t_us") / 1e11).alias("t"), (F.col("v_cent") / 100.0).alias("v"))
    return ordered.history_weights(t, ["user_id"], "t", "v", 1.5).select("event_id", F.floor(F.col("history") * 10_000 + 0.5).cast("long").alias("history"))


@query(f"""WITH {POINTS}, o AS (SELECT frame, pt, x_mm, y_mm, z_mm, row_number() OVER (PARTITION BY frame ORDER BY pt) - 1 + frame % 7 AS n FROM points) SELECT frame, pt, x_mm, y_mm, z_mm FROM o WHERE n % 7 = 0""")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP01, TOP09: every seventh point of a frame from a running offset."""
    o = ordered.argsorted(points(spark, sf_dir), ["frame"], ["pt"], "n")
    return o.where(F.pmod(F.col("n") + F.pmod("frame", F.lit(7)), F.lit(7)) == 0).select("frame", "pt", "x_mm", "y_mm", "z_mm")


@query(f"""WITH {POINTS}, v AS (SELECT {key_sql('x_mm', 'y_mm', 'z_mm', 2000)} AS key, frame, gt, pred FROM points WHERE gt <> -1), s AS (SELECT key, count(DISTINCT frame % 2) AS visits FROM v GROUP BY key)
SELECT CAST(visits AS INTEGER) AS visits, count(*) AS n, count(*) FILTER (gt = pred) AS correct FROM v JOIN s USING (key) GROUP BY visits""")
def visit_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL06: points of voxels that one visit saw apart from those that both saw."""
    key = G.voxel_key(F.col("x_mm"), F.col("y_mm"), F.col("z_mm"), 2000)
    v = points(spark, sf_dir).where("gt <> -1").select(key.alias("key"), F.pmod("frame", F.lit(2)).alias("visit"), "gt", "pred")
    s = v.groupBy("key").agg((F.max("visit") - F.min("visit") + 1).cast("int").alias("visits"))
    return v.join(s, "key").groupBy("visits").agg(F.count("*").alias("n"), F.count_if(F.col("gt") == F.col("pred")).alias("correct"))


@query(f"""WITH {POINTS}, c AS (SELECT frame, cls, gt, count(*) AS n FROM points WHERE gt <> -1 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY frame, cls ORDER BY n DESC, gt) AS place, sum(n) OVER (PARTITION BY frame, cls) AS total FROM c),
t AS (SELECT frame, cls, max(CASE WHEN place = 1 THEN gt END) AS gt, max(CASE WHEN place = 1 THEN n END) AS n1, coalesce(max(CASE WHEN place = 2 THEN n END), 0) AS n2, max(total) AS total FROM r GROUP BY ALL)
SELECT frame, cls, gt, n1 = n2 AS tied, 2 * n1 >= total AS strong FROM t""")
def identity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL09: each track's voted identity, ties and strong support flagged."""
    c = points(spark, sf_dir).where("gt <> -1").groupBy("frame", "cls", "gt").agg(F.count("*").alias("n"))
    t = c.groupBy("frame", "cls").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "gt"))).alias("r"), F.sum("n").alias("total"))  # at most one entry per class
    first, second = -F.col("r")[0]["m"], F.coalesce(-F.get("r", F.lit(1))["m"], F.lit(0))
    return t.select("frame", "cls", F.col("r")[0]["gt"].alias("gt"), (first == second).alias("tied"), (2 * first >= F.col("total")).alias("strong"))


@query(f"""WITH {POINTS}, f AS (SELECT frame, cls, count(DISTINCT {key_sql('x_mm', 'y_mm', 'z_mm', 4000)}) AS cells FROM points WHERE cls IN (1, 2, 3) GROUP BY ALL), a AS (SELECT cls, count(DISTINCT {key_sql('x_mm', 'y_mm', 'z_mm', 4000)}) AS ribbon FROM points WHERE cls IN (1, 2, 3) GROUP BY ALL)
SELECT a.cls, ribbon, CAST(max(cells) AS BIGINT) AS footprint, CAST(ribbon AS DOUBLE) / max(cells) AS ratio FROM a JOIN f USING (cls) GROUP BY a.cls, ribbon""")
def dynamic_ribbons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL10: cells that a mover smears over all sweeps against its largest footprint in one."""
    p = points(spark, sf_dir).where("cls IN (1, 2, 3)").select("frame", "cls", G.voxel_key(F.col("x_mm"), F.col("y_mm"), F.col("z_mm"), 4000).alias("key"))
    one = p.groupBy("cls", "frame").agg(F.countDistinct("key").alias("cells")).groupBy("cls").agg(F.max("cells").alias("footprint"))
    return p.groupBy("cls").agg(F.countDistinct("key").alias("ribbon")).join(one, "cls").withColumn("ratio", F.col("ribbon") / F.col("footprint"))


@query("""WITH d AS (SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS published, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS found FROM documents GROUP BY source) SELECT source, n, published, found, published = found AS agrees FROM d""")
def published_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL12: totals that a table publishes beside its rows, recomputed from the rows."""
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("published"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("found"))
    return d.select("source", "n", "published", "found", (F.col("published") == F.col("found")).alias("agrees"))


@query()
def hilbert_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ28: cells by their place on a Hilbert curve; tested for being a curve."""
    g = points(spark, sf_dir).select(*((G.cell(f"{a}_mm", 4000) + 16).alias(f"g{a}") for a in "xyz")).distinct()
    return g.withColumn("code", G.hilbert(F.col("gx"), F.col("gy"), F.col("gz"), 6))


@query()
def registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SOL01, GRF04: each object's points, of one frame and class, against a shifted copy, and whether the result is accepted."""
    pair = F.col("frame").cast("long") * 16 + F.col("cls")
    p = points(spark, sf_dir).select(pair.alias("pair"), *((F.col(f"{a}_mm") / 1000.0).alias(a) for a in "xyz"))
    both = p.withColumn("side", F.lit(0)).unionByName(p.withColumns({"x": F.col("x") + 0.3, "y": F.col("y") - 0.2, "side": F.lit(1)}))
    found = objects.registered(both)
    return found.select("pair", "shift", "fitness", "error", objects.accepted(0.6, 0.3, 2.0).alias("accepted"))


@query()
def greedy_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN18: detections linked frame by frame to the nearest open track, in logs of twenty frames."""
    d = points(spark, sf_dir).groupBy("frame", "cls").agg(F.avg("x_mm").alias("x"), F.avg("y_mm").alias("y"))
    d = d.withColumns({"k": F.pmod("cls", F.lit(4)), "log": F.floor(F.col("frame") / 20)})
    return objects.greedy_tracks(d.select("log", "k", "frame", F.col("cls").alias("id"), "x", "y"), ["log", "k"], 9000.0).select("log", "k", "frame", "id", "track")


@query(f"""WITH {TICKS}, o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) - 1 AS version FROM ticks)
SELECT CAST(user_id AS BIGINT) AS user_id, version, NOT (user_id % 5 = 0 AND version >= 7) AS accepted FROM o""")
def revision_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-06: revisions accepted while versions grow and times extend; a broken one rejects all after it."""
    t = ordered.argsorted(ticks(spark, sf_dir), ["user_id"], ["t_us"], "version")
    v, late = F.col("version").cast("long"), F.when((F.pmod("user_id", F.lit(5)) == 0) & (F.col("version") == 7), 1).otherwise(0)
    rows = t.select(F.col("user_id").cast("long").alias("user_id"), "version", v.alias("n_old"), (F.shiftright(v * (v - 1), 1) + v * late).alias("sum_old"), (v + late).alias("time"))
    return ordered.revisions_accepted(rows, ["user_id"]).select("user_id", "version", "accepted")


@query()
def packet_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-07: packets claimed once by the graph that covers them; the oldest are evicted beyond a number or an age of five days."""
    t = ticks(spark, sf_dir).where("event_type IN ('view', 'signup')").withColumn("kind", F.when(F.col("event_type") == "signup", "graph").otherwise("packet"))
    rows = t.select("user_id", "t_us", F.floor(F.col("t_us") / 1_000_000).alias("stamp"), "kind")
    return machines.fold(rows, ["user_id"], ["t_us"], lambda: machines.Claims("user_id", 3, 432_000), "user_id long, claimed array<long>, evicted array<long>")
