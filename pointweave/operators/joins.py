"""Joins that Spark has no operator for, as equi-joins: brackets in time, nearest rows, grid neighbours, visibility."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.functions.geometry import neighbour_key
from pointweave.operators.tiles import nearest_within, windows


def lookup_or_abstain(rows: DataFrame, table: DataFrame, on: str | list[str], value: str, miss: int = -1) -> DataFrame:
    """rows plus the table's value, ``miss`` where it has none."""
    return rows.join(table, on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(miss)))


def compare_maps(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, a, b, side of two maps(key, cls): shared keys, and those of only one."""
    both = a.select("key", F.col("cls").alias("a")).join(b.select("key", F.col("cls").alias("b")), "key", "full_outer")
    side = F.when(F.col("a").isNull(), "b_only").when(F.col("b").isNull(), "a_only").otherwise("shared")
    return both.withColumn("side", side)


def bracket(rows: DataFrame, poses: DataFrame, time: str, by: list[str], width: int, clamp: bool = False) -> DataFrame:
    """rows plus t0, t1, v0, v1: the poses(by, t, v) before and after each row's time, the last interval closed.

    Pose intervals are exploded over the time buckets of ``width`` that they meet, so the range condition becomes an
    equi-join on by and bucket with a local remainder. Rows outside the span have none (they are kept, with nulls);
    with clamp their time is moved to the span's nearest end first, which is kept in ``time``.
    """
    w = W.partitionBy(*by).orderBy("t")
    spans = poses.select(*by, F.col("t").alias("t0"), F.col("v").alias("v0"), F.lead("t").over(w).alias("t1"), F.lead("v").over(w).alias("v1"), F.lead("t", 2).over(w).alias("t2"))
    spans = spans.where("t1 IS NOT NULL AND t1 > t0")
    if clamp:
        ends = poses.groupBy(*by).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
        rows = rows.join(ends, by, "left").withColumn(time, F.least(F.greatest(time, "first_t"), "last_t")).drop("first_t", "last_t")
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    spans = spans.withColumn("bucket", F.explode(F.sequence(bucket(F.col("t0")), bucket(F.col("t1")))))
    rows = rows.withColumn("bucket", bucket(F.col(time)))
    inside = (F.col("t0") <= F.col(time)) & ((F.col(time) < F.col("t1")) | (F.col("t2").isNull() & (F.col(time) == F.col("t1"))))
    keyed = rows.alias("r").join(spans.alias("s"), [F.col(f"r.{c}") == F.col(f"s.{c}") for c in [*by, "bucket"]] + [inside], "left")
    return keyed.select(*(f"r.{c}" for c in rows.columns if c != "bucket"), "s.t0", "s.t1", "s.v0", "s.v1")


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_id: str, left_t: str, right_t: str, reach: int) -> DataFrame:
    """Each left row with the nearest right row within ``reach`` in time, the earliest on ties; unmatched rows go.

    Left rows are exploded to the two or three buckets of width ``reach`` that can hold a match.
    """
    bucket = F.floor(F.col(right_t) / F.lit(reach)).cast("long")
    at = F.floor(F.col(left_t) / F.lit(reach)).cast("long")
    spread = left.withColumn("bucket", F.explode(F.array(at - 1, at, at + 1)))
    near = spread.join(right.withColumn("bucket", bucket), [*by, "bucket"]).where(F.abs(F.col(left_t) - F.col(right_t)) <= reach)
    order = W.partitionBy(left_id).orderBy(F.abs(F.col(left_t) - F.col(right_t)), right_t)
    return near.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place", "bucket")


def recent(left: DataFrame, right: DataFrame, by: list[str], left_t: str, right_t: str, reach: int) -> DataFrame:
    """Pairs of left rows and the right rows before them by at most ``reach``: an equi-join on by and time bucket."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(reach)).cast("long")
    spread = left.withColumn("bucket", F.explode(F.array(bucket(left_t) - 1, bucket(left_t))))
    pairs = spread.join(right.withColumn("bucket", bucket(right_t)), [*by, "bucket"]).drop("bucket")
    return pairs.where((F.col(right_t) < F.col(left_t)) & (F.col(left_t) - F.col(right_t) <= reach))


def latest_before(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str, reach: int) -> DataFrame:
    """left plus value: that of the newest right row not after it and at most ``reach`` old; null if there is none.

    Both sides are merged in time order and the last value carried forward, one sort of the union per key.
    """
    a = left.select(*left.columns, F.lit(1).alias("side"), F.lit(None).cast("long").alias("seen_t"), F.lit(None).alias("seen"))
    b = right.select(*by, F.col(time), F.lit(0).alias("side"), F.col(time).alias("seen_t"), F.col(value).alias("seen"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = W.partitionBy(*by).orderBy(time, "side").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("last", F.last(F.when(F.col("side") == 0, F.struct("seen_t", "seen")), ignorenulls=True).over(w))
    fresh = F.col(time) - F.col("last.seen_t") <= reach
    return both.where("side = 1").select(*left.columns, F.when(fresh, F.col("last.seen")).alias(value), F.when(fresh, F.col("last.seen_t")).alias(f"{value}_t"))


def delivery(published: DataFrame, received: DataFrame) -> DataFrame:
    """published(id, hash, ready) matched with received(hash, received): each takes the earliest unused one not before it is ready.

    Publications go in the order of readiness. The greedy choice has a closed form: with c_i receptions before
    readiness i, publication k takes reception k + 1 + max(-1, max over i <= k of (c_i - i)), counted from 1; so both
    sides are ranked by windows and joined on the rank. Unmatched publications are left out.
    """
    events = published.select("hash", F.col("ready").alias("t"), F.lit(0).alias("side"), "id").unionByName(
        received.select("hash", F.col("received").alias("t"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("id"))
    )
    order = W.partitionBy("hash").orderBy("t", "side", "id").rowsBetween(W.unboundedPreceding, 0)
    counted = events.withColumns({"before": F.sum("side").over(order), "k": F.sum(1 - F.col("side")).over(order)})
    turns = counted.where("side = 0").withColumn("slip", F.max(F.col("before") - F.col("k")).over(order))
    p = turns.select("id", "hash", F.col("t").alias("ready"), (F.col("k") + F.greatest(F.col("slip"), F.lit(-1)) + 1).alias("take"))
    r = counted.where("side = 1").select("hash", F.col("t").alias("received"), F.col("before").alias("take"))
    return p.join(r, ["hash", "take"]).select("id", "hash", "ready", "received")


def _offsets(reach: int = 1) -> Column:
    side = range(-reach, reach + 1)
    return F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz")) for a in side for b in side for c in side)))


def _in_cells(points: DataFrame, radius2: int) -> DataFrame:
    """points with cells as wide as the radius, from their coordinates, so none wraps as a key's may."""
    width = max(1, math.isqrt(math.ceil(radius2)))
    width += width * width < radius2
    return points.withColumns({f"c{a}": F.floor(F.col(a) / F.lit(width)).cast("long") for a in "xyz"}).drop("key")


def grid_neighbours(left: DataFrame, right: DataFrame, radius2: int, by: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of left and right points (by, id, key, x, y, z) within a radius; the key's cells are as wide as the radius.

    Each left point looks into its 27 cells: an equi-join on by and the key, never a pairing of all points. With a frame
    in ``by`` the work grows with the number of frames, not with its square.
    """
    spread = left.select("*", _offsets().alias("o")).withColumn("key", neighbour_key("key", F.col("o.dx"), F.col("o.dy"), F.col("o.dz"))).drop("o")
    a, b = spread.alias("a"), right.alias("b")
    d2 = sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in "yz"), (F.col("a.x") - F.col("b.x")) * (F.col("a.x") - F.col("b.x")))
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*by, "key")]
    near = a.join(b, on).withColumn("d2", d2).where(F.col("d2") <= radius2)
    named = lambda side, d: (F.col(f"{side}.{c}").alias(f"{c}_{side}") for c in d.columns if c not in ("key", *by))
    return near.select(*(F.col(f"a.{c}") for c in by), *named("a", left), *named("b", right), "d2")


def reciprocal(left: DataFrame, right: DataFrame, radius2: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of points that are each other's nearest within the radius, ties to the smaller id; with both points' columns.

    Ids are unique over all frames. Points are shuffled once and meet tile by tile; no pairs are.
    """
    near = nearest_within(_in_cells(left, radius2), _in_cells(right, radius2), radius2, 1, by, reciprocal=True)
    return near.select("id_a", "d2", "id_b", *(c for c in near.columns if c not in ("id_a", "id_b", "d2", "place")))


def moved(points: DataFrame, relative: DataFrame, by: str | list[str] = "frame") -> DataFrame:
    """points with x, y, z turned and shifted by relative(by, r11 .. r33, tx, ty, tz), which are kept as tx, ty, tz."""
    turned = {c: sum((F.col(f"r{k}{j}") * F.col(v) for j, v in ((2, "y"), (3, "z"))), F.col(f"r{k}1") * F.col("x")) + F.col(f"t{c}") for k, c in ((1, "x"), (2, "y"), (3, "z"))}
    return points.join(relative, by).withColumns(turned).drop(*(f"r{k}{j}" for k in (1, 2, 3) for j in (1, 2, 3)))


def associate(current: DataFrame, previous: DataFrame, radius2: int, radial: int, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Reciprocal pairs of current points and previous ones moved into their frame, within a bound along both rays.

    A current ray starts at the sensor, a previous one at where the sensor was, tx, ty, tz of previous. Pairs are chosen
    among all points before the gates, so that no farther match takes the place of one that a gate rejects.
    """
    pairs = reciprocal(current, previous, radius2, by)
    delta = {c: F.col(f"{c}_a") - F.col(f"{c}_b") for c in "xyz"}
    good = F.lit(True)
    for ray in ({c: F.col(f"{c}_a") for c in "xyz"}, {c: F.col(f"{c}_b") - F.col(f"t{c}_b") for c in "xyz"}):
        length2 = ray["x"] * ray["x"] + ray["y"] * ray["y"] + ray["z"] * ray["z"]
        along = delta["x"] * ray["x"] + delta["y"] * ray["y"] + delta["z"] * ray["z"]
        good &= (length2 > 1e-12) & (F.abs(along) <= F.lit(radial) * F.sqrt(length2))
    return pairs.where(good)


def nearest_neighbours(left: DataFrame, right: DataFrame, radius2: int, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest right points of each left point within the radius, ties to the smaller id; place counts from 1."""
    return nearest_within(_in_cells(left, radius2), _in_cells(right, radius2), radius2, k, by)


def z_buffer(pixels: DataFrame, reach: int, tolerance: int) -> DataFrame:
    """pixels(frame, id, u, v, z) plus visible and edge, against the nearest and farthest depth within ``reach`` pixels.

    Pixels are shuffled once, by tiles of the image with a border as wide as the reach.
    """
    out = windows(pixels, ["z"], reach)
    return out.select(*pixels.columns, (F.col("z") <= F.col("lo_z") + tolerance).alias("visible"), (F.col("hi_z") - F.col("lo_z") > tolerance).alias("edge"))


def ray_visibility(memory: DataFrame, returns: DataFrame, margin: int) -> DataFrame:
    """memory(id, ray, r) plus state against the nearest return of its ray: 0 unknown, 1 surface, 2 occluded, 3 free."""
    front = returns.groupBy("ray").agg(F.min("r").alias("front"))
    state = F.when(F.col("front").isNull(), 0).when(F.abs(F.col("r") - F.col("front")) <= margin, 1).when(F.col("r") > F.col("front"), 2).otherwise(3)
    return memory.join(front, "ray", "left").withColumn("state", state)


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: int, slack: float = 0.01, least_annotated: int = 5) -> DataFrame:
    """points(frame, id, x, y, z, cls) plus owner: the only box that holds it, -2 if several do, null if none.

    A box(frame, box, label, annotated, cx, cy, cz, qw, qx, qy, qz, length, width, height) is turned by its quaternion: a
    point lies in it if, turned back into the box's own axes, it is within the three half sizes, and its class is the
    box's label. Boxes with fewer than least_annotated annotated points own nothing. Boxes are spread over the cells of
    a ground grid that their radius meets: an equi-join on frame, cell and label with a local condition.
    """
    q = {c: F.col(f"q{c}") for c in "wxyz"}
    rows = [
        [1 - 2 * (q["y"] * q["y"] + q["z"] * q["z"]), 2 * (q["x"] * q["y"] - q["z"] * q["w"]), 2 * (q["x"] * q["z"] + q["y"] * q["w"])],
        [2 * (q["x"] * q["y"] + q["z"] * q["w"]), 1 - 2 * (q["x"] * q["x"] + q["z"] * q["z"]), 2 * (q["y"] * q["z"] - q["x"] * q["w"])],
        [2 * (q["x"] * q["z"] - q["y"] * q["w"]), 2 * (q["y"] * q["z"] + q["x"] * q["w"]), 1 - 2 * (q["x"] * q["x"] + q["y"] * q["y"])],
    ]
    radius = F.sqrt(F.col("length") * F.col("length") + F.col("width") * F.col("width") + F.col("height") * F.col("height")) / 2 + slack
    grid = lambda v: F.floor(v / F.lit(cell)).cast("long")
    spread = boxes.where(F.col("annotated") >= least_annotated).withColumn("gx", F.explode(F.sequence(grid(F.col("cx") - radius), grid(F.col("cx") + radius))))
    spread = spread.withColumn("gy", F.explode(F.sequence(grid(F.col("cy") - radius), grid(F.col("cy") + radius)))).withColumnRenamed("label", "cls")
    tagged = points.withColumns({"gx": grid(F.col("x")), "gy": grid(F.col("y"))})
    d = [F.col(v) - F.col(f"c{v}") for v in "xyz"]
    inside = F.lit(True)
    for axis, size in enumerate(("length", "width", "height")):
        local = d[0] * rows[0][axis] + d[1] * rows[1][axis] + d[2] * rows[2][axis]
        inside &= F.abs(local) <= F.col(size) / 2 + slack
    hits = tagged.join(spread, ["frame", "gx", "gy", "cls"]).where(inside).groupBy("frame", "id").agg(F.count("*").alias("n"), F.min("box").alias("box"))
    owner = F.when(F.col("n") > 1, F.lit(-2)).otherwise(F.col("box"))
    return points.join(hits, ["frame", "id"], "left").select(*points.columns, owner.alias("owner"))


def box_groups(owned: DataFrame, least: int = 5) -> DataFrame:
    """frame, owner, n: boxes that alone own at least so many points."""
    return owned.where("owner IS NOT NULL AND owner <> -2").groupBy("frame", "owner").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def loop_candidates(keyframes: DataFrame, cell: int, least_gap: int, reach2: int) -> DataFrame:
    """Pairs of keyframes(id, t, x, y) far apart in time and near in place: neighbours in a grid as wide as the reach."""
    grid = lambda c: F.floor(F.col(c) / F.lit(cell)).cast("long")
    k = keyframes.withColumns({"gx": grid("x"), "gy": grid("y")})
    side = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    spread = k.select("id", "t", "x", "y", "gx", "gy", side.alias("o")).select("id", "t", "x", "y", (F.col("gx") + F.col("o.a")).alias("gx"), (F.col("gy") + F.col("o.b")).alias("gy"))
    i, j = k.alias("i"), spread.alias("j")
    d2 = (F.col("i.x") - F.col("j.x")) * (F.col("i.x") - F.col("j.x")) + (F.col("i.y") - F.col("j.y")) * (F.col("i.y") - F.col("j.y"))
    near = i.join(j, (F.col("i.gx") == F.col("j.gx")) & (F.col("i.gy") == F.col("j.gy"))).where(F.col("j.t") - F.col("i.t") > least_gap)
    return near.withColumn("d2", d2).where(F.col("d2") < reach2).select(F.col("i.id").alias("i"), F.col("j.id").alias("j"), "d2")


def keep_unmatched(expected: DataFrame, found: DataFrame, on: str) -> DataFrame:
    """Missing and extra values of two sets, with their kind."""
    missing = expected.select(on).distinct().join(found, on, "left_anti").select(on, F.lit("missing").alias("kind"))
    return missing.unionByName(found.select(on).distinct().join(expected, on, "left_anti").select(on, F.lit("extra").alias("kind")))
