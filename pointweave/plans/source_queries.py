"""Queries of parsing, decoding and writing operators, over text and bytes that Spark derives from the driver's tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.functions import geometry as G
from pointweave.operators import filters, joins, ordered
from pointweave.operators.tables import new_path
from pointweave.plans.adapters import PLACES, POINTS, TICKS, places, points, table, ticks
from pointweave.plans.queries import query
from pointweave.sources import readers, sinks
from pointweave.sources.json_arrays import json_array, write_json_arrays
from pointweave.sources.recorded_log import recorded_log, write_log


@query(f"WITH {TICKS} SELECT event_id, t_us * 1000 + 123 AS stamp_ns, CAST(floor((t_us * 1000 + 123) / 1000000000) AS BIGINT) AS sec, (t_us * 1000 + 123) % 1000000000 AS nsec FROM ticks")
def timestamp_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC07, DAT01, PRJ31: text with nanoseconds to a long, and to seconds and nanoseconds."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("123"))
    ns = e.select("event_id", readers.time_ns(text).alias("stamp_ns"))
    return ns.select("event_id", "stamp_ns", F.expr("stamp_ns div 1000000000").alias("sec"), (F.col("stamp_ns") % 1_000_000_000).alias("nsec"))


@query(f"WITH {POINTS}, r AS (SELECT frame, pt, CAST(cls AS BIGINT) | (CAST(pt AS BIGINT) << 16) AS raw FROM points) SELECT frame, pt, raw, CAST(raw & 65535 AS INTEGER) AS semantic, CAST(raw >> 16 AS INTEGER) AS instance FROM r")
def label_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC03, SRC04: words of a semantic and an instance half, encoded as file bytes per frame and decoded by the reader."""
    raw = points(spark, sf_dir).select("frame", "pt", F.col("cls").cast("long").bitwiseOR(F.shiftleft(F.col("pt").cast("long"), 16)).alias("raw"))
    # A frame is a bounded unit of the sensor; its file's bytes are what the reader's decoder gets.
    files = raw.groupBy("frame").applyInPandas(
        lambda pdf: pd.DataFrame({"frame": [pdf["frame"].iloc[0]], "content": [pdf.sort_values("pt")["raw"].to_numpy().astype("<u4").tobytes()]}), "frame int, content binary"
    )
    words = readers.decoded(files, "frame int, pt int, raw long", np.dtype([("raw", "<u4")]), {"raw": "int64"})
    words = words.withColumn("pt", F.col("pt") + 1)
    return words.select("frame", "pt", "raw", F.col("raw").bitwiseAND(F.lit(65535).cast("long")).cast("int").alias("semantic"), F.shiftright("raw", 16).cast("int").alias("instance"))


@query("""WITH f AS (SELECT DISTINCT CAST(floor(l_orderkey / 250) AS INTEGER) AS frame FROM lineitem)
SELECT 'all' AS spec, frame FROM f UNION ALL SELECT 'stride:7', frame FROM f WHERE frame % 7 = 0 UNION ALL SELECT '5:40:3', frame FROM f WHERE frame >= 5 AND frame < 40 AND (frame - 5) % 3 = 0 UNION ALL SELECT 'list:1,4,999999', frame FROM f WHERE frame IN (1, 4, 999999)""")
def frame_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC19."""
    f = points(spark, sf_dir).select("frame").distinct()
    out = None
    for spec in ("all", "stride:7", "5:40:3", "list:1,4,999999"):
        part = readers.frame_list(spec, f).select(F.lit(spec).alias("spec"), "frame")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {TICKS}, l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t_us) AS line, event_type, v_cent FROM ticks),
s AS (SELECT *, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS stage FROM l)
SELECT user_id AS source, line, stage, event_type AS name, CAST(v_cent AS DOUBLE) AS value FROM s WHERE event_type NOT IN ('signup', 'purchase')""")
def scraped_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC16: coloured log lines, the stage carried on, counters read."""
    t = ordered.argsorted(ticks(spark, sf_dir), ["user_id"], ["t_us"], "line").withColumn("line", (F.col("line") + 1).cast("long"))
    esc = F.lit("\x1b[32m")
    text = F.when(F.col("event_type").isin("signup", "purchase"), F.concat(esc, F.lit("== stage "), F.col("event_type"), F.lit("\x1b[0m"))).otherwise(F.concat(F.lit("  "), F.col("event_type"), F.lit(": "), esc, F.col("v_cent").cast("string"), F.lit("\x1b[0m")))
    lines = t.select(F.col("user_id").alias("source"), "line", text.alias("text"))
    return readers.scraped_log(lines, r"== stage (\w+)", r"^\s+(\w+): (\d+)")


@query("""WITH c AS (SELECT conv_id, turn, text FROM conversations), m AS (SELECT conv_id || '/' || turn AS path, sha256(text) AS want FROM c WHERE turn <> 3 OR conv_id % 5 <> 0),
f AS (SELECT conv_id || '/' || turn AS path, sha256(CASE WHEN conv_id % 11 = 2 THEN text || '!' ELSE text END) AS got FROM c WHERE conv_id % 7 <> 3)
SELECT path, CASE WHEN got IS NULL THEN 'missing' WHEN want IS NULL THEN 'extra' ELSE 'changed' END AS fault FROM m FULL OUTER JOIN f USING (path) WHERE got IS NULL OR want IS NULL OR got <> want""")
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC17, SRC18, STR03: content hashes against a manifest."""
    c = table(spark, sf_dir, "conversations").withColumn("path", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    want = c.where("turn <> 3 OR conv_id % 5 <> 0").select("path", F.sha2("text", 256).alias("sha256"))
    text = F.when(F.col("conv_id") % 11 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    got = c.where("conv_id % 7 <> 3").select("path", F.sha2(text, 256).alias("sha256"))
    return readers.manifest_faults(want, got)


@query()
def cloud_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK03, SNK04, SNK05, AGG43: packed records of each frame and their hash; the layout is tested byte by byte."""
    p = points(spark, sf_dir)
    rows = p.select("frame", "pt", *((F.col(f"{a}_mm") / 1000).cast("float").alias(a) for a in "xyz"), G.pack_rgb(F.col("cls") * 15, F.lit(0), F.lit(48)).alias("rgb"), "cls", (F.col("w_micro") / 1e6).cast("float").alias("conf"), F.lit(1).alias("has"))
    return sinks.cloud_records(rows).select("frame", "n", "sha256")


@query(f"""WITH {POINTS}, h AS (SELECT frame, sha256(string_agg(sha256(frame || ':' || pt || ':' || cls), '' ORDER BY pt)) AS digest FROM points GROUP BY frame) SELECT frame, digest FROM h""")
def ordered_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG43: an order-sensitive digest per frame from the hashes of its rows."""
    rows = points(spark, sf_dir).select("frame", "pt", F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in ("frame", "pt", "cls"))), 256).alias("h"))
    hashes = rows.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("pt", "h"))).alias("h"))  # a frame is bounded
    return hashes.select("frame", F.sha2(F.array_join(F.transform("h", lambda x: x["h"]), ""), 256).alias("digest"))


@query(f"""WITH {POINTS}, b AS (SELECT frame FROM points WHERE w_micro >= 930000 GROUP BY frame HAVING count(*) >= 700),
s AS (SELECT p.frame, pt, x_mm, y_mm FROM points p JOIN b ON p.frame = b.frame WHERE w_micro >= 930000) SELECT frame, pt FROM s WHERE x_mm * x_mm + y_mm * y_mm BETWEEN 4000000 AND 900000000""")
def sweep_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT02, FLT07, FLT08: whole-sweep gate, then the range gate."""
    kept = filters.complete_frames(points(spark, sf_dir), F.col("w_micro") >= 930_000, 700)
    return kept.where(filters.spherical(F.col("x_mm"), F.col("y_mm"), F.lit(0), 2000, 30000)).select("frame", "pt")


@query(f"""WITH {POINTS}, {PLACES}, d AS (SELECT frame, CAST(least(greatest(ceil(sqrt(CAST(x_mm * x_mm + y_mm * y_mm AS DOUBLE)) / 60000 * 20) - 1, 0), 19) AS INTEGER) AS ring, max(z_mm + 3000) AS h FROM points WHERE x_mm * x_mm + y_mm * y_mm <= 3600000000 GROUP BY ALL),
pr AS (SELECT a.frame AS i, b.frame AS j, sum(a.h * b.h) AS ab FROM d a JOIN loops ON a.frame = loops.i JOIN d b ON b.frame = loops.j AND a.ring = b.ring GROUP BY ALL), n AS (SELECT frame, sum(h * h) AS hh FROM d GROUP BY frame)
SELECT i, j, CAST(floor((1 - ab / (sqrt(CAST(x.hh AS DOUBLE)) * sqrt(CAST(y.hh AS DOUBLE)))) * 1000000 + 0.5) AS BIGINT) AS distance FROM (SELECT pr.*, row_number() OVER (PARTITION BY j ORDER BY ab / sqrt(CAST(x.hh AS DOUBLE)) / sqrt(CAST(y.hh AS DOUBLE)) DESC, i) AS place FROM pr JOIN n x ON x.frame = i JOIN n y ON y.frame = j) q JOIN n x ON x.frame = i JOIN n y ON y.frame = j WHERE place <= 10""")
def descriptor_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG20, TOP08, ARR10 (ring key): ten most similar earlier scans near in place, by the cosine of their ring heights."""
    p = points(spark, sf_dir).where("x_mm * x_mm + y_mm * y_mm <= 3600000000")
    ring = F.least(F.greatest(F.ceil(F.sqrt((F.col("x_mm") * F.col("x_mm") + F.col("y_mm") * F.col("y_mm")).cast("double")) / 60000 * 20) - 1, F.lit(0)), F.lit(19)).cast("int")
    d = p.groupBy("frame", ring.alias("ring")).agg(F.max(F.col("z_mm") + 3000).alias("h"))
    n = d.groupBy("frame").agg(F.sum(F.col("h") * F.col("h")).alias("hh"))
    a, b = d.select(F.col("frame").alias("i"), "ring", F.col("h").alias("ha")), d.select(F.col("frame").alias("j"), "ring", F.col("h").alias("hb"))
    loops = joins.loop_candidates(places(spark, sf_dir), 30_000, 3, 900_000_000).select("i", "j")
    pairs = loops.join(a, "i").join(b, ["j", "ring"]).groupBy("i", "j").agg(F.sum(F.col("ha") * F.col("hb")).alias("ab"))
    pairs = pairs.join(n.toDF("i", "ni"), "i").join(n.toDF("j", "nj"), "j")
    ni, nj = F.sqrt(F.col("ni").cast("double")), F.sqrt(F.col("nj").cast("double"))
    order = W.partitionBy("j").orderBy(F.desc(F.col("ab") / ni / nj), "i")
    best = pairs.withColumn("place", F.row_number().over(order)).where("place <= 10")
    return best.select("i", "j", F.floor((1 - F.col("ab") / (ni * nj)) * 1_000_000 + 0.5).cast("long").alias("distance"))


@query(f"""WITH {POINTS}, {PLACES}, c AS (SELECT frame, CAST(least(greatest(ceil(sqrt(CAST(x_mm * x_mm + y_mm * y_mm AS DOUBLE)) / 60000 * 20) - 1, 0), 19) AS INTEGER) AS ring,
  CAST(least(greatest(ceil((atan2(CAST(y_mm AS DOUBLE), CAST(x_mm AS DOUBLE)) + pi()) / (2 * pi()) * 60) - 1, 0), 59) AS INTEGER) AS sector, max(z_mm + 3000) AS h FROM points WHERE x_mm * x_mm + y_mm * y_mm <= 3600000000 GROUP BY ALL),
k AS (SELECT frame, ring, CAST(sum(h) AS BIGINT) AS s FROM c GROUP BY ALL), n AS (SELECT frame, CAST(sum(s * s) AS BIGINT) AS ss FROM k GROUP BY frame),
ab AS (SELECT loops.i, loops.j, CAST(sum(a.s * b.s) AS BIGINT) AS ab FROM loops JOIN k a ON a.frame = loops.i JOIN k b ON b.frame = loops.j AND b.ring = a.ring GROUP BY ALL),
d AS (SELECT i, j, x.ss + y.ss - 2 * coalesce(ab, 0) AS d2 FROM loops LEFT JOIN ab USING (i, j) JOIN n x ON x.frame = i JOIN n y ON y.frame = j)
SELECT i, j, d2, CAST(row_number() OVER (PARTITION BY j ORDER BY d2, i) AS INTEGER) AS place FROM d QUALIFY row_number() OVER (PARTITION BY j ORDER BY d2, i) <= 10""")
def ring_key_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP08: ten earlier scans near in place by the distance of their ring keys, the mean over 60 sectors of the greatest heights.

    Sums stand for means, as the number of sectors is fixed, so squared distances are whole numbers; ties take the earlier scan.
    """
    p = points(spark, sf_dir).where("x_mm * x_mm + y_mm * y_mm <= 3600000000")
    x, y = F.col("x_mm").cast("double"), F.col("y_mm").cast("double")
    ring = F.least(F.greatest(F.ceil(F.sqrt((F.col("x_mm") * F.col("x_mm") + F.col("y_mm") * F.col("y_mm")).cast("double")) / 60000 * 20) - 1, F.lit(0)), F.lit(19)).cast("int")
    sector = F.least(F.greatest(F.ceil((F.atan2(y, x) + F.pi()) / (2 * F.pi()) * 60) - 1, F.lit(0)), F.lit(59)).cast("int")
    cells = p.groupBy("frame", ring.alias("ring"), sector.alias("sector")).agg(F.max(F.col("z_mm") + 3000).alias("h"))
    # A scan's key is one row: 20 numbers, and 0 for a ring without returns.
    rings = cells.groupBy("frame").agg(*(F.sum(F.when(F.col("ring") == k, F.col("h")).otherwise(0)).cast("long").alias(f"r{k}") for k in range(20)))
    keys = rings.select("frame", F.array(*(f"r{k}" for k in range(20))).alias("key"))
    loops = joins.loop_candidates(places(spark, sf_dir), 30_000, 3, 900_000_000).select("i", "j")
    pairs = loops.join(keys.toDF("i", "a"), "i").join(keys.toDF("j", "b"), "j")
    squares = F.zip_with("a", "b", lambda a, b: (a - b) * (a - b))
    d = pairs.select("i", "j", F.aggregate(squares, F.lit(0).cast("long"), lambda s, v: s + v).alias("d2"))
    return d.withColumn("place", F.row_number().over(W.partitionBy("j").orderBy("d2", "i"))).where("place <= 10")


@query("""WITH t AS (SELECT l_orderkey % 100 AS frame, sum(l_quantity) AS a, sum(l_linenumber) AS b FROM lineitem GROUP BY ALL)
SELECT quantile_cont(a + b, 0.5) AS serial_p50, quantile_cont(a + b, 0.95) AS serial_p95, quantile_cont(greatest(a, b), 0.5) AS parallel_p50, quantile_cont(greatest(a, b), 0.95) AS parallel_p95 FROM t""")
def latency_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL11: the sum and the maximum of two stages per frame first, percentiles after."""
    t = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("frame")).agg(F.sum("l_quantity").alias("a"), F.sum("l_linenumber").alias("b"))
    q = lambda c, p, n: F.percentile(c, F.lit(p)).alias(n)
    serial, parallel = F.col("a") + F.col("b"), F.greatest("a", "b")
    return t.agg(q(serial, 0.5, "serial_p50"), q(serial, 0.95, "serial_p95"), q(parallel, 0.5, "parallel_p50"), q(parallel, 0.95, "parallel_p95"))


@query(f"""WITH {POINTS}, r AS (SELECT frame % 3 AS seed, frame % 2 AS arm, gt, pred FROM points WHERE gt <> -1), s AS (SELECT arm, seed, count(*) FILTER (gt = pred) * 1000000 // count(*) AS m FROM r GROUP BY ALL),
a AS (SELECT arm, CAST(sum(m) AS DOUBLE) / count(*) AS mean, max(m) - min(m) AS width FROM s GROUP BY arm), p AS (SELECT x.mean AS base, y.mean AS other, greatest(x.width, y.width) AS width FROM a x, a y WHERE x.arm = 0 AND y.arm = 1)
SELECT base, other, other - base AS gain, CASE WHEN other - base > width THEN 'better' WHEN base - other > width THEN 'worse' ELSE 'open' END AS verdict FROM p""")
def arm_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL07, AGG17: two arms over repeats, called only beyond their spread."""
    r = points(spark, sf_dir).where("gt <> -1").groupBy(F.pmod("frame", F.lit(2)).alias("arm"), F.pmod("frame", F.lit(3)).alias("seed"))
    s = r.agg(F.expr("count_if(gt = pred) * 1000000 div count(*)").alias("m"))
    a = s.groupBy("arm").agg((F.sum("m") / F.count("*")).alias("mean"), (F.max("m") - F.min("m")).alias("width"))
    one = a.agg(*(F.max(F.when(F.col("arm") == k, F.col("mean"))).alias(n) for k, n in enumerate(("base", "other"))), F.max("width").alias("width"))
    gain = F.col("other") - F.col("base")
    verdict = F.when(gain > F.col("width"), "better").when(-gain > F.col("width"), "worse").otherwise("open")
    return one.select("base", "other", gain.alias("gain"), verdict.alias("verdict"))


EVAL = f"""{POINTS}, e AS (SELECT frame, gt, pred, CASE WHEN pred >= 0 AND abs(y_mm) < x_mm THEN pred ELSE CAST(cls % 9 AS INTEGER) END AS hybrid, abs(y_mm) < x_mm AS frustum, x_mm * x_mm + y_mm * y_mm < 625000000 AS near FROM points WHERE gt <> -1)"""


@query(f"""WITH {EVAL}, s AS (SELECT 'global' AS subset, * FROM e UNION ALL SELECT 'frustum', * FROM e WHERE frustum UNION ALL SELECT 'outside', * FROM e WHERE NOT frustum UNION ALL SELECT 'near', * FROM e WHERE near)
SELECT subset, count(*) AS n, count(*) FILTER (pred = gt) AS scan_right, count(*) FILTER (hybrid = gt) AS hybrid_right FROM s GROUP BY subset""")
def evaluation_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL01, EVL02, EVL03: subset masks as an exploded array, arms as columns: one scan, one aggregate."""
    p = points(spark, sf_dir).where("gt <> -1")
    frustum = F.abs("y_mm") < F.col("x_mm")
    hybrid = F.when((F.col("pred") >= 0) & frustum, F.col("pred")).otherwise(F.pmod("cls", F.lit(9)))
    near = F.col("x_mm") * F.col("x_mm") + F.col("y_mm") * F.col("y_mm") < 625_000_000
    subsets = F.array_compact(F.array(F.lit("global"), F.when(frustum, "frustum").otherwise("outside"), F.when(near, "near")))
    rows = p.select("gt", "pred", hybrid.alias("hybrid"), F.explode(subsets).alias("subset"))
    return rows.groupBy("subset").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("gt")).alias("scan_right"), F.count_if(F.col("hybrid") == F.col("gt")).alias("hybrid_right"))


@query(f"""WITH {POINTS}, g AS (SELECT DISTINCT gt FROM points WHERE gt >= 0), r AS (SELECT DISTINCT pred FROM points WHERE pred >= 0), c AS (SELECT gt, count(*) AS n FROM points WHERE gt >= 0 GROUP BY gt)
SELECT c.gt, n, c.gt IN (SELECT pred FROM r) AS reachable FROM c""")
def taxonomy_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL13: which ground-truth classes any prediction can reach."""
    p = points(spark, sf_dir)
    reached = p.where("pred >= 0").select(F.col("pred").alias("gt")).distinct().withColumn("reachable", F.lit(True))
    c = p.where("gt >= 0").groupBy("gt").agg(F.count("*").alias("n"))
    return c.join(reached, "gt", "left").withColumn("reachable", F.coalesce("reachable", F.lit(False)))


@query(f"""WITH {TICKS}, m AS (SELECT event_type AS topic, user_id AS frame, t_us * 1000 AS stamp_ns, CAST(event_id AS VARCHAR) || ':' || CAST(v_cent AS VARCHAR) AS body FROM ticks),
r AS (SELECT *, (topic = 'click' AND frame >= 20 AND frame < 60) OR (topic IN ('error', 'purchase') AND stamp_ns <= 1705276800000000000) AS in_range FROM m)
SELECT topic, frame, count(*) AS n, sum(length(body)) AS bytes, min(stamp_ns) AS first_ns, md5(string_agg(body, ',' ORDER BY body)) AS digest, count(*) FILTER (in_range) AS in_range FROM r GROUP BY topic, frame""")
def recorded_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC10: all events written as a log of topics and read again, whole and by two ranges that the index answers."""
    path = new_path(spark, "log")
    body = F.concat_ws(":", "event_id", "v_cent")
    messages = ticks(spark, sf_dir).select(F.col("event_type").alias("topic"), F.col("user_id").alias("frame"), (F.col("t_us") * 1000).alias("stamp_ns"), F.encode(body, "UTF-8").alias("data"))
    write_log(messages, path, files=8)
    log = recorded_log(spark, path)
    whole = log.withColumn("body", F.decode("data", "UTF-8")).groupBy("topic", "frame").agg(
        F.count("*").alias("n"), F.sum(F.length("data")).alias("bytes"), F.min("stamp_ns").alias("first_ns"), F.md5(F.array_join(F.sort_array(F.collect_list("body")), ",").cast("binary")).alias("digest")
    )
    ranges = recorded_log(spark, path, ["click"], (20, 60)).unionByName(recorded_log(spark, path, ["error", "purchase"], stamps_ns=(0, 1_705_276_800_000_000_001)))
    found = ranges.groupBy("topic", "frame").agg(F.count("*").alias("in_range"))
    return whole.join(found, ["topic", "frame"], "left").withColumn("in_range", F.coalesce("in_range", F.lit(0).cast("long")))


@query(f"WITH {TICKS} SELECT t.event_id, t.user_id, t.event_type, t.t_us, t.v_cent, e.props FROM ticks t JOIN events e USING (event_id)")
def json_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC13: all events as JSON arrays, texts with quotes and brackets included, read by byte ranges."""
    e = ticks(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "props"), "event_id")
    files = write_json_arrays(e, new_path(spark, "arrays"))
    return json_array(files, "event_id long, user_id long, event_type string, t_us long, v_cent long, props string", range_bytes=1 << 18)
