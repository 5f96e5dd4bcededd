"""Queries of the perception operators over the driver's tables, each with the DuckDB SQL that states its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.functions import arrays as A
from pointweave.functions import geometry as G
from pointweave.operators import fusion, joins, ordered, scoring, selection
from pointweave.plans.adapters import POINTS, TICKS, TRACKS, key_sql, points, table, ticks, tracks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
VOXEL = 2000


def query(sql: str | None = None):
    """Registers a query by its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _key(size: int = VOXEL):
    return G.voxel_key(F.col("x_mm"), F.col("y_mm"), F.col("z_mm"), size)


KEY_SQL = key_sql("x_mm", "y_mm", "z_mm", VOXEL)
VOTES = f"{POINTS}, votes AS (SELECT {KEY_SQL} AS key, cls, sum(w_micro) AS w, count(*) AS n FROM points GROUP BY ALL)"
MAP = f"""{VOTES}, best AS (
  SELECT key, cls, w, sum(w) OVER (PARTITION BY key) AS total, row_number() OVER (PARTITION BY key ORDER BY w DESC, cls) AS place FROM votes),
fused AS (SELECT key, cls, CAST(w AS DOUBLE) / greatest(total, 1) AS share FROM best WHERE place = 1)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.vote_map(points(spark, sf_dir), _key())


# Maps -------------------------------------------------------------------------------------------------------------


@query(f"""WITH {MAP}, sums AS (
  SELECT {KEY_SQL} AS key, count(*) AS n_obs, sum(x_mm) AS sx, sum(y_mm) AS sy, sum(z_mm) AS sz FROM points GROUP BY 1)
SELECT s.key, CAST(n_obs AS BIGINT) AS n_obs, CAST(sx AS DOUBLE) / n_obs AS x, CAST(sy AS DOUBLE) / n_obs AS y, CAST(sz AS DOUBLE) / n_obs AS z, f.cls, f.share
FROM sums s JOIN fused f ON s.key = f.key""")
def voxel_vote_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG01, AGG02, PRJ01."""
    return _fused(spark, sf_dir)


@query(f"""WITH {MAP}, looked AS (
  SELECT p.gt, CASE WHEN f.key IS NULL THEN -1 WHEN f.cls = 11 THEN -2 ELSE f.cls % 9 END AS pred
  FROM points p LEFT JOIN fused f ON {KEY_SQL} = f.key AND f.share >= 0.15)
SELECT gt, CAST(pred AS INTEGER) AS pred, count(*) AS n FROM looked WHERE gt <> -1 GROUP BY ALL""")
def map_lookup_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN02, AGG07: points look their voxel up; voxels under the share gate are unknown, so points abstain."""
    sure = _fused(spark, sf_dir).where("share >= 0.15").select("key", F.when(F.col("cls") == 11, -2).otherwise(F.pmod("cls", F.lit(9))).cast("int").alias("pred"))
    looked = joins.lookup_or_abstain(points(spark, sf_dir).select("gt", _key().alias("key")), sure, "key", "pred")
    return scoring.confusion(looked)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with 0.2 m cells, tile and local code, as keyframe packets."""
    gx, gy, gz = (G.cell(c, VOXEL) for c in ("x_mm", "y_mm", "z_mm"))
    tx, ty, tz, code = G.tile_and_local(gx, gy, gz, 20, 16, F.lit(0))
    return points(spark, sf_dir).select(F.col("frame").alias("stamp"), F.col("cls").alias("label"), F.col("w_micro").alias("w"), tx.alias("tx"), ty.alias("ty"), tz.alias("tz"), code.alias("cell"))


def _parts_sql(shift: str = "0") -> str:
    g = [f"CAST(floor(({c}) / 2000.0) AS BIGINT)" for c in (f"x_mm + {shift}", "y_mm", "z_mm")]
    t = [f"CAST(floor({v} / 20.0) AS BIGINT)" for v in g]
    local = [f"({v} - 20 * {u})" for v, u in zip(g, t, strict=True)]
    return f"SELECT frame AS stamp, cls AS label, w_micro AS w, {t[0]} AS tx, {t[1]} AS ty, {t[2]} AS tz, (({local[0]} * 20 + {local[1]}) * 20 + {local[2]}) * 16 AS cell FROM points"


EXCLUDED = [1, 2, 3, 4, 5, 6, 8, 9]
TILE_SQL = """SELECT tx, ty, tz, cell, label, confidence, CAST(point_count AS BIGINT) AS point_count, keyframe_count FROM (
  SELECT tx, ty, tz, cell, label, CAST(w AS DOUBLE) / sum(w) OVER c AS confidence, sum(n) OVER c AS point_count,
         row_number() OVER (PARTITION BY tx, ty, tz, cell ORDER BY w DESC, label) AS place
  FROM (SELECT tx, ty, tz, cell, label, sum(w) AS w, sum(n) AS n FROM {0} GROUP BY ALL) WINDOW c AS (PARTITION BY tx, ty, tz, cell))
JOIN (SELECT tx, ty, tz, cell, count(DISTINCT stamp) AS keyframe_count FROM {0} GROUP BY ALL) USING (tx, ty, tz, cell) WHERE place = 1"""


def _contribution_sql(name: str, shift: str = "0") -> str:
    bad = ", ".join(map(str, EXCLUDED))
    return f"""{name} AS (SELECT tx, ty, tz, stamp, cell, label, sum(w) AS w, count(*) AS n FROM ({_parts_sql(shift)})
  WHERE label NOT IN ({bad}) AND w > 0 AND w >= 930000 GROUP BY ALL)"""


@query(f"WITH {POINTS}, {_contribution_sql('c')} {TILE_SQL.format('c')}")
def tile_contribution_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT06, PRJ05, AGG03, AGG04."""
    return fusion.tile_map(fusion.contributions(_parts(spark, sf_dir), EXCLUDED, 930_000))


def _revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packets after a pose revision moved the keyframes of one frame in seven by 8 m."""
    moved = F.col("x_mm") + F.when(F.pmod("frame", F.lit(7)) == 3, 8000).otherwise(0)
    gx, gy, gz = G.cell(moved, VOXEL), G.cell("y_mm", VOXEL), G.cell("z_mm", VOXEL)
    tx, ty, tz, code = G.tile_and_local(gx, gy, gz, 20, 16, F.lit(0))
    return points(spark, sf_dir).select(F.col("frame").alias("stamp"), F.col("cls").alias("label"), F.col("w_micro").alias("w"), tx.alias("tx"), ty.alias("ty"), tz.alias("tz"), code.alias("cell"))


@query(f"WITH {POINTS}, {_contribution_sql('c', 'CASE WHEN frame % 7 = 3 THEN 8000 ELSE 0 END')} {TILE_SQL.format('c')}")
def reversible_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-05 in batch: only tiles that the revision touches are fused again; the result equals a rebuild."""
    old, new = (fusion.contributions(p, EXCLUDED, 930_000) for p in (_parts(spark, sf_dir), _revised(spark, sf_dir)))
    return fusion.refreshed_map(fusion.tile_map(old), new, fusion.revised_tiles(old, new))


VISIT = f"""{POINTS}, v AS (SELECT CAST(frame % 2 AS INTEGER) AS visit, {key_sql('x_mm', 'y_mm', 'z_mm', 8000)} AS key, CAST(floor(frame / 5) AS INTEGER) AS grp, frame, cls, w_micro FROM points),
fn AS (SELECT visit, key, grp, frame, count(*) AS n FROM v GROUP BY ALL),
fr AS (SELECT visit, key, grp, frame, cls, CAST(floor(sum(w_micro) / any_value(n)) AS BIGINT) AS s FROM v JOIN fn USING (visit, key, grp, frame) GROUP BY ALL),
gn AS (SELECT visit, key, grp, count(*) AS frames FROM fn GROUP BY ALL),
gr AS (SELECT visit, key, grp, cls, CAST(floor(sum(s) / any_value(frames)) AS BIGINT) AS s FROM fr JOIN gn USING (visit, key, grp) GROUP BY ALL),
vn AS (SELECT visit, key, count(*) AS groups FROM gn GROUP BY ALL),
vs AS (SELECT visit, key, cls, CAST(floor(sum(s) / any_value(groups)) AS BIGINT) AS score, any_value(groups) AS groups FROM gr JOIN vn USING (visit, key) GROUP BY ALL)"""


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select(F.pmod("frame", F.lit(2)).alias("visit"), _key(8000).alias("key"), "frame", "cls", "w_micro")
    return fusion.visit_summary(rows)


@query(f"WITH {VISIT} SELECT visit, key, cls, groups, score FROM vs")
def visit_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG06: nested means per frame, group and visit."""
    return _visits(spark, sf_dir)


@query(f"""WITH {VISIT}, r AS (SELECT visit, key, cls, score, groups, sum(score) OVER k AS total, row_number() OVER (PARTITION BY visit, key ORDER BY score DESC, cls) AS place,
  max(CASE WHEN cls IN (1, 2, 3) THEN score ELSE 0 END) OVER k AS guarded FROM vs WINDOW k AS (PARTITION BY visit, key)),
t AS (SELECT visit, key, max(CASE WHEN place = 1 THEN cls END) AS cls, max(CASE WHEN place = 1 THEN score END) AS s1, coalesce(max(CASE WHEN place = 2 THEN score END), 0) AS s2,
  max(total) AS total, max(groups) AS groups, max(guarded) AS guarded FROM r GROUP BY ALL)
SELECT a.key, a.cls AS cls_a, b.cls AS cls_b,
  least(a.groups, b.groups) >= 2 AND a.guarded = 0 AND b.guarded = 0 AND b.s1 * 2 >= b.total AND (b.s1 - b.s2) * 10 >= b.total AS eligible
FROM t a JOIN t b ON a.key = b.key AND a.visit = 0 AND b.visit = 1""")
def visit_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN04, FLT11, ARR03: two visits' summaries meet; enough groups, no guarded class, share and margin decide."""
    v = _visits(spark, sf_dir).groupBy("visit", "key").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "cls"))).alias("r"),  # at most one entry per class
        F.sum("score").alias("total"), F.max("groups").alias("groups"), F.max(F.when(F.col("cls").isin(1, 2, 3), F.col("score")).otherwise(0)).alias("guarded"),
    )
    v = v.select("visit", "key", "total", "groups", "guarded", F.col("r")[0]["cls"].alias("cls"), (-F.col("r")[0]["s"]).alias("s1"), F.coalesce(-F.get("r", F.lit(1))["s"], F.lit(0)).alias("s2"))
    a, b = (v.where(F.col("visit") == k).alias(n) for k, n in enumerate("ab"))
    ok = (F.least("a.groups", "b.groups") >= 2) & (F.col("a.guarded") == 0) & (F.col("b.guarded") == 0) & (F.col("b.s1") * 2 >= F.col("b.total")) & ((F.col("b.s1") - F.col("b.s2")) * 10 >= F.col("b.total"))
    return a.join(b, F.col("a.key") == F.col("b.key")).select("a.key", F.col("a.cls").alias("cls_a"), F.col("b.cls").alias("cls_b"), ok.alias("eligible"))


@query(f"""WITH {POINTS}, o AS (SELECT {key_sql('x_mm', 'y_mm', 'z_mm', 500)} AS key, frame, cls, count(*) AS own FROM points GROUP BY ALL),
t AS (SELECT key, cls, sum(own) AS n FROM o GROUP BY ALL), f AS (SELECT DISTINCT key, frame FROM o),
p AS (SELECT f.key, f.frame, t.cls, t.n - coalesce(o.own, 0) AS rest FROM f JOIN t ON f.key = t.key LEFT JOIN o ON o.key = f.key AND o.frame = f.frame AND o.cls = t.cls),
r AS (SELECT *, sum(rest) OVER (PARTITION BY key, frame) AS n, row_number() OVER (PARTITION BY key, frame ORDER BY rest DESC, cls) AS place FROM p)
SELECT frame, key, cls, CAST(n AS BIGINT) AS n FROM r WHERE place = 1 AND n >= 1 AND 3 * rest >= 2 * n""")
def leave_own_frame_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG31."""
    return fusion.leave_own_frame_out(points(spark, sf_dir), _key(500), 1)


@query(f"""WITH {POINTS}, k AS (SELECT *, {key_sql('x_mm', 'y_mm', 'z_mm', 8000)} AS key FROM points)
SELECT frame, key, pt, x_mm, y_mm, z_mm, n FROM (SELECT *, count(*) OVER (PARTITION BY frame, key) AS n, row_number() OVER (PARTITION BY frame, key ORDER BY pt) AS place FROM k) WHERE place = 1""")
def first_point_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG36, AGG37, WIN03."""
    return fusion.first_per_cell(points(spark, sf_dir), _key(8000))


@query(f"""WITH {POINTS}, c AS (SELECT DISTINCT CAST(floor(x_mm / 2000.0) AS BIGINT) AS x, CAST(floor(y_mm / 2000.0) AS BIGINT) AS y, CAST(floor(z_mm / 2000.0) AS BIGINT) AS z FROM points),
f AS (SELECT DISTINCT factor, CAST(floor(x / factor) AS BIGINT) AS x, CAST(floor(y / factor) AS BIGINT) AS y, CAST(floor(z / factor) AS BIGINT) AS z FROM c, (SELECT unnest(range(1, 65)) AS factor)),
n AS (SELECT CAST(factor AS INTEGER) AS factor, count(*) AS cells FROM f GROUP BY ALL)
SELECT factor, cells, factor = coalesce((SELECT min(factor) FROM n WHERE cells <= 500), 64) AS chosen FROM n""")
def coarsened_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP03, PRJ02, PRJ35: distinct cells at every factor in one pass, and the least factor that fits."""
    return fusion.coarsened(points(spark, sf_dir).select(_key().alias("key")).distinct(), 500)


# Scores -----------------------------------------------------------------------------------------------------------

CONFUSION = f"{POINTS}, c AS (SELECT frame % 3 AS arm, gt, pred, count(*) AS n FROM points WHERE gt <> -1 GROUP BY ALL)"
SCORES = f"""{CONFUSION}, u AS (
  SELECT arm, gt AS cls, CASE WHEN gt = pred THEN n ELSE 0 END AS tp, CASE WHEN gt <> pred THEN n ELSE 0 END AS fn, 0 AS fp FROM c
  UNION ALL SELECT arm, pred, 0, 0, n FROM c WHERE pred >= 0 AND gt <> pred),
s AS (SELECT arm, cls, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(fp) AS BIGINT) AS fp FROM u GROUP BY ALL)"""


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.confusion(points(spark, sf_dir).withColumn("arm", F.pmod("frame", F.lit(3))), ["arm"])


@query(f"""WITH {SCORES} SELECT arm, cls, tp, fn, fp, CASE WHEN tp + fn + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fn + fp) END AS iou,
  CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END AS accuracy FROM s""")
def class_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG08, EVL05, SET06."""
    return scoring.class_scores(_arms(spark, sf_dir), 9, ["arm"])


@query(f"""WITH {CONFUSION}, t AS (SELECT arm, CAST(sum(n) AS BIGINT) AS evaluated, CAST(sum(CASE WHEN pred = -1 THEN n ELSE 0 END) AS BIGINT) AS abstained,
  CAST(sum(CASE WHEN pred = -2 THEN n ELSE 0 END) AS BIGINT) AS unmapped, CAST(sum(CASE WHEN gt = pred THEN n ELSE 0 END) AS BIGINT) AS correct FROM c GROUP BY ALL)
SELECT *, evaluated - abstained AS answered, (evaluated - abstained) / evaluated AS coverage, correct / (evaluated - abstained) AS acc_answered, correct / evaluated AS acc_strict FROM t""")
def arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG07, EVL04, EVL05: coverage and both accuracies."""
    return scoring.summary(_arms(spark, sf_dir), ["arm"])


@query(f"""WITH {SCORES}, i AS (SELECT arm, tp + fn > 0 AS present, CASE WHEN tp + fn > 0 THEN CAST(floor(CAST(tp AS DOUBLE) / (tp + fn + fp) * 1000000 + 0.5) AS BIGINT) ELSE 0 END AS m FROM s)
SELECT arm, CAST(sum(m) AS DOUBLE) / (sum(CASE WHEN present THEN 1 ELSE 0 END) * 1000000) AS miou, CAST(sum(CASE WHEN present THEN 1 ELSE 0 END) AS BIGINT) AS n_present FROM i GROUP BY arm""")
def mean_class_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG08, AGG10: mean over present classes."""
    return scoring.mean_iou(scoring.class_scores(_arms(spark, sf_dir), 9, ["arm"]), 9, ["arm"])


@query(f"""WITH {SCORES}, i AS (SELECT arm, tp + fn > 0 AS present, CASE WHEN tp + fn + fp > 0 THEN CAST(floor(CAST(tp AS DOUBLE) / (tp + fn + fp) * 1000000 + 0.5) AS BIGINT) ELSE 0 END AS m FROM s)
SELECT arm, CAST(sum(m) AS DOUBLE) / 9000000 AS miou, CAST(sum(CASE WHEN present THEN 1 ELSE 0 END) AS BIGINT) AS n_present FROM i GROUP BY arm""")
def fixed_class_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG09, AGG10: mean over a fixed set of classes."""
    return scoring.mean_iou(scoring.class_scores(_arms(spark, sf_dir), 9, ["arm"]), 9, ["arm"], fixed=True)


GT_MAJOR = f"""{POINTS}, m AS (SELECT {KEY_SQL} AS key, gt, count(*) AS n FROM points WHERE gt >= 0 GROUP BY ALL),
major AS (SELECT key, gt, n AS votes, total FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY key) AS BIGINT) AS total, row_number() OVER (PARTITION BY key ORDER BY n DESC, gt) AS place FROM m) WHERE place = 1)"""


@query(f"WITH {GT_MAJOR} SELECT key, gt, votes, total FROM major")
def majority_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG05."""
    return scoring.majority(points(spark, sf_dir).withColumn("key", _key()), "key", "gt", 9)


@query(f"""WITH {GT_MAJOR}, r AS (SELECT p.gt, p.pred, m.gt AS major FROM points p JOIN major m ON {KEY_SQL} = m.key WHERE p.gt >= 0)
SELECT count(*) AS points, count(*) FILTER (pred < 0) AS no_voxel, count(*) FILTER (pred >= 0 AND gt <> major) AS mixed, count(*) FILTER (pred >= 0 AND pred <> major) AS voxel_wrong,
  count(*) FILTER (pred >= 0 AND pred <> gt AND pred = major) AS floor, count(*) FILTER (pred >= 0 AND pred = gt) AS "right", count(*) FILTER (pred >= 0 AND pred <> gt) AS wrong, true AS consistent FROM r""")
def residual_anatomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12, AGG28."""
    return scoring.anatomy(points(spark, sf_dir).select("gt", "pred", _key().alias("key")), 9)


@query(f"""WITH {POINTS}, r AS (SELECT frame % 3 AS arm, gt, pred AS base, CAST(cls % 9 AS INTEGER) AS other FROM points WHERE gt <> -1)
SELECT arm, count(*) AS total, count(*) FILTER (base <> gt AND other = gt) AS rescued, count(*) FILTER (base = gt AND other <> gt) AS harmed, count(*) FILTER (base = gt AND other = gt) AS both,
  count(*) FILTER (base <> gt AND other <> gt AND base <> other) AS wrong_to_wrong, count(*) FILTER (base <> gt AND other = gt) - count(*) FILTER (base = gt AND other <> gt) AS net FROM r GROUP BY arm""")
def paired_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG27, AGG28, EVL08."""
    rows = points(spark, sf_dir).select(F.pmod("frame", F.lit(3)).alias("arm"), "gt", F.col("pred").alias("base"), F.pmod("cls", F.lit(9)).alias("other"))
    return scoring.paired(rows, ["arm"])


@query(f"""WITH {POINTS}, v AS (SELECT {KEY_SQL} AS key, CAST(max(frame) - min(frame) AS INTEGER) AS n_free, bool_or(cls IN (1, 2)) AS moving, count(*) AS weight FROM points GROUP BY 1),
k AS (SELECT unnest([1, 2, 4, 8, 16, 32]) AS k),
s AS (SELECT k, CAST(coalesce(sum(weight) FILTER (moving), 0) AS BIGINT) AS moving, CAST(coalesce(sum(weight) FILTER (NOT moving), 0) AS BIGINT) AS static,
  CAST(coalesce(sum(weight) FILTER (moving AND n_free >= k), 0) AS BIGINT) AS moving_gone, CAST(coalesce(sum(weight) FILTER (NOT moving AND n_free >= k), 0) AS BIGINT) AS static_gone FROM v, k GROUP BY k)
SELECT *, moving_gone / greatest(moving, 1) AS recall, static_gone / greatest(static, 1) AS false_kill, static_gone / greatest(moving_gone, 1) AS damage FROM s""")
def removal_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG24, AGG25, JOIN29, FLT10."""
    v = points(spark, sf_dir).groupBy(_key().alias("key")).agg((F.max("frame") - F.min("frame")).alias("n_free"), F.bool_or(F.col("cls").isin(1, 2)).alias("moving"), F.count("*").alias("weight"))
    return scoring.removal_curve(v, [1, 2, 4, 8, 16, 32])


@query("""WITH o AS (SELECT o_orderpriority AS cls, c_mktsegment AS scene, o_totalprice > 50000 AS seen, o_orderstatus <> 'P' AS tracked, c_acctbal > 0 AS labelled FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT scene, cls, count(*) AS total, count(*) FILTER (seen) AS upto_seen, count(*) FILTER (NOT seen) AS lost_seen, count(*) FILTER (seen AND tracked) AS upto_tracked, count(*) FILTER (seen AND NOT tracked) AS lost_tracked,
  count(*) FILTER (seen AND tracked AND labelled) AS upto_labelled, count(*) FILTER (seen AND tracked AND NOT labelled) AS lost_labelled
FROM o GROUP BY GROUPING SETS ((), (scene), (cls))""")
def evidence_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG32, AGG33: stage funnel with first losses, in all, by scene and by class."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select(F.col("o_orderpriority").alias("cls"), F.col("c_mktsegment").alias("scene"), (F.col("o_totalprice") > 50000).alias("seen"), (F.col("o_orderstatus") != "P").alias("tracked"), (F.col("c_acctbal") > 0).alias("labelled"))
    # The full cube of stages is aggregated once; marginals are taken from its few rows.
    fine = scoring.funnel(o, ["seen", "tracked", "labelled"], ["scene", "cls"])
    sums = [F.sum(c).alias(c) for c in fine.columns if c not in ("scene", "cls")]
    return fine.groupingSets([[], [F.col("scene")], [F.col("cls")]], F.col("scene"), F.col("cls")).agg(*sums)


@query("""SELECT event_type, count(*) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, min(value) AS low, max(value) AS high FROM events GROUP BY 1""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG16: exact, linear percentiles of groups of any size, by refined histograms."""
    return scoring.latency(table(spark, sf_dir, "events"), ["event_type"], "value")


@query(f"""WITH {TICKS}, r AS (SELECT user_id, event_type, sum(v_cent) AS v FROM ticks GROUP BY ALL)
SELECT event_type, count(v) AS n, CAST(sum(v) AS DOUBLE) / count(v) AS mean, coalesce(floor(stddev_samp(CAST(v AS DOUBLE)) * 1000 + 0.5), 0) / 1000 AS sd, (max(v) - min(v)) / 2 AS half_range FROM r GROUP BY event_type""")
def repeat_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG17, AGG18."""
    r = ticks(spark, sf_dir).groupBy("user_id", "event_type").agg(F.sum("v_cent").alias("v"))
    out = scoring.spread(r, ["event_type"], "v")
    return out.withColumn("sd", F.floor(F.col("sd") * 1000 + 0.5) / 1000).withColumn("half_range", F.col("half_range").cast("double"))


@query(f"""WITH {POINTS}, j AS (SELECT CAST(cls % 9 AS INTEGER) AS teacher, gt, pred = gt AS agree, CAST(floor(w_micro / 25000) AS BIGINT) AS conf_bin, CAST(floor(sqrt(x_mm * x_mm + y_mm * y_mm) / 10000) AS BIGINT) AS range_bin FROM points)
SELECT teacher, gt, agree, conf_bin, range_bin, count(*) AS n FROM j GROUP BY ALL""")
def joint_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG30, AGG13, AGG21, PRJ20."""
    r = F.sqrt(F.col("x_mm") * F.col("x_mm") + F.col("y_mm") * F.col("y_mm"))
    p = points(spark, sf_dir).select(F.pmod("cls", F.lit(9)).alias("teacher"), "gt", (F.col("pred") == F.col("gt")).alias("agree"), F.floor(F.col("w_micro") / 25000).alias("conf_bin"), F.floor(r / 10000).alias("range_bin"))
    return p.groupBy("teacher", "gt", "agree", "conf_bin", "range_bin").agg(F.count("*").alias("n"))


@query(f"""WITH {POINTS}, t AS (SELECT CAST(floor(x_mm / 10000.0) AS BIGINT) * 100000 + CAST(floor(y_mm / 10000.0) AS BIGINT) AS tile, cls, pred FROM points),
c AS (SELECT tile, cls, pred, count(*) AS n FROM t WHERE cls <> pred GROUP BY ALL)
SELECT tile, cls, pred, n FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY n DESC, cls, pred) AS place FROM c) WHERE place <= 5""")
def top_changes_per_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG29, PRJ06, TOP13."""
    t = points(spark, sf_dir).where("cls <> pred").select(G.bev_tile(F.col("x_mm"), F.col("y_mm"), 10000).alias("tile"), "cls", "pred")
    return selection.top(t.groupBy("tile", "cls", "pred").agg(F.count("*").alias("n")), ["tile"], [F.desc("n"), "cls", "pred"], 5)


@query(f"""WITH {POINTS}, m AS (SELECT CAST(floor(x_mm / 16000.0) AS BIGINT) AS gx, CAST(floor(y_mm / 16000.0) AS BIGINT) AS gy, count(*) AS n, sum(x_mm) AS sx, sum(y_mm) AS sy, sum(z_mm) AS sz,
  sum(x_mm * x_mm) AS xx, sum(x_mm * y_mm) AS xy, sum(x_mm * z_mm) AS xz, sum(y_mm * y_mm) AS yy, sum(y_mm * z_mm) AS yz, sum(z_mm * z_mm) AS zz FROM points GROUP BY ALL)
SELECT gx, gy, n, CAST(n * xx - sx * sx AS DOUBLE) / (n * n) AS cxx, CAST(n * xy - sx * sy AS DOUBLE) / (n * n) AS cxy, CAST(n * xz - sx * sz AS DOUBLE) / (n * n) AS cxz,
  CAST(n * yy - sy * sy AS DOUBLE) / (n * n) AS cyy, CAST(n * yz - sy * sz AS DOUBLE) / (n * n) AS cyz, CAST(n * zz - sz * sz AS DOUBLE) / (n * n) AS czz FROM m""")
def cell_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG14: integer moments per cell, divided once."""
    from pointweave.operators.solvers import cell_covariances

    return cell_covariances(points(spark, sf_dir), 16000)


@query(f"""WITH {POINTS}, c AS (SELECT CAST(floor(x_mm / 4000.0) AS BIGINT) AS gx, CAST(floor(y_mm / 4000.0) AS BIGINT) AS gy, z_mm FROM points),
l AS (SELECT gx, gy, quantile_cont(z_mm, 0.05) AS low FROM c GROUP BY ALL HAVING count(*) >= 5),
b AS (SELECT c.gx, c.gy, z_mm FROM c JOIN l ON c.gx = l.gx AND c.gy = l.gy WHERE z_mm BETWEEN low - 300 AND low + 1500),
m AS (SELECT gx, gy, median(z_mm) AS mid FROM b GROUP BY ALL)
SELECT b.gx, b.gy, count(*) AS n, 1.4826 * median(abs(z_mm - mid)) AS thickness FROM b JOIN m ON b.gx = m.gx AND b.gy = m.gy GROUP BY ALL""")
def ground_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15: low percentile, band, scaled median deviation per column."""
    from pointweave.operators.solvers import ground_thickness as thickness

    return thickness(points(spark, sf_dir), 4000, 5, 300, 1500)


@query(f"""WITH {POINTS}, a AS (SELECT DISTINCT {KEY_SQL} AS key FROM points WHERE frame % 2 = 0), b AS (SELECT DISTINCT {KEY_SQL} AS key FROM points WHERE frame % 2 = 1),
i AS (SELECT count(*) AS n FROM a JOIN b USING (key)), na AS (SELECT count(*) AS n FROM a), nb AS (SELECT count(*) AS n FROM b)
SELECT na.n AS in_a, nb.n AS in_b, i.n AS shared, na.n + nb.n - i.n AS either, i.n / greatest(na.n + nb.n - i.n, 1) AS share FROM na, nb, i""")
def key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG22, SET02, SET03."""
    p = points(spark, sf_dir).select("frame", _key().alias("key"))
    return selection.overlap(p.where("frame % 2 = 0"), p.where("frame % 2 = 1"), "key").withColumns({c: F.col(c).cast("long") for c in ("in_a", "in_b", "shared")})


@query(f"""WITH {POINTS}, v AS (SELECT {KEY_SQL} AS key, count(*) AS n, count(*) FILTER (abs(y_mm) < x_mm) AS covered FROM points GROUP BY 1)
SELECT count(*) AS voxels, count(*) FILTER (covered > 0) AS ever, count(*) FILTER (covered > 0) / count(*) AS ever_share, CAST(sum(covered * 1000000 // n) AS DOUBLE) / (count(*) * 1000000) AS mean_share FROM v""")
def camera_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG23: voxels ever in view, and the mean share of their points in view."""
    v = points(spark, sf_dir).groupBy(_key().alias("key")).agg(F.count("*").alias("n"), F.count_if(F.abs("y_mm") < F.col("x_mm")).alias("covered"))
    ever = F.count_if(F.col("covered") > 0)
    share = F.sum(F.floor(F.col("covered") * 1_000_000 / F.col("n")).cast("long")) / (F.count("*") * 1_000_000)
    return v.agg(F.count("*").alias("voxels"), ever.alias("ever"), (ever / F.count("*")).alias("ever_share"), share.alias("mean_share"))


@query(f"""WITH {POINTS}, f AS (SELECT frame, cls, count(*) AS n FROM points GROUP BY ALL)
SELECT cls, count(*) AS frames, CAST(sum(n) AS BIGINT) AS points, count(*) FILTER (n < 60) AS rare FROM f GROUP BY cls""")
def frame_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG34."""
    f = points(spark, sf_dir).groupBy("frame", "cls").agg(F.count("*").alias("n"))
    return f.groupBy("cls").agg(F.count("*").alias("frames"), F.sum("n").alias("points"), F.count_if(F.col("n") < 60).alias("rare"))


@query(f"""WITH {POINTS}, g AS (SELECT {KEY_SQL} AS key, gt, count(*) AS n FROM points WHERE gt >= 0 GROUP BY ALL), t AS (SELECT key, sum(n) AS total FROM g GROUP BY key),
w AS (SELECT gt, n * 1000000 // total AS m FROM g JOIN t USING (key)) SELECT gt, CAST(sum(m) AS DOUBLE) / 1000000 AS weight FROM w GROUP BY gt""")
def weighted_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG11: every voxel weighs 1, spread over its points."""
    g = points(spark, sf_dir).where("gt >= 0").groupBy(_key().alias("key"), "gt").agg(F.count("*").alias("n"))
    t = g.groupBy("key").agg(F.sum("n").alias("total"))
    m = F.floor(F.col("n") * 1_000_000 / F.greatest("total", F.lit(1))).cast("long")
    return g.join(t, "key").groupBy("gt").agg((F.sum(m) / 1_000_000).alias("weight"))


@query("""WITH c AS (SELECT 'coverage' AS gate, count(*) > 0 AS ok FROM lineitem UNION ALL SELECT 'keys', count(*) = count(DISTINCT o_orderkey) FROM orders
  UNION ALL SELECT 'stamps', min(ts) >= TIMESTAMP '2024-01-01' FROM events UNION ALL SELECT 'values', count(*) FILTER (value < 0) = 0 FROM events)
SELECT gate, ok, bool_and(ok) OVER () AS admitted FROM c""")
def admission_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG44: named checks, and all of them."""
    from pyspark.sql import Window as W

    o, e = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    checks = [
        table(spark, sf_dir, "lineitem").agg((F.count("*") > 0).alias("ok")).withColumn("gate", F.lit("coverage")),
        o.agg((F.count("*") == F.countDistinct("o_orderkey")).alias("ok")).withColumn("gate", F.lit("keys")),
        e.agg((F.min(F.col("ts").cast("timestamp")) >= F.lit("2024-01-01").cast("timestamp")).alias("ok")).withColumn("gate", F.lit("stamps")),
        e.agg((F.count_if(F.col("value") < 0) == 0).alias("ok")).withColumn("gate", F.lit("values")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.select("gate", "ok", F.bool_and("ok").over(W.partitionBy()).alias("admitted"))
