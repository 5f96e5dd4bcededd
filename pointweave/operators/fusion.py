"""Voxel maps from labelled points: votes, reduction, tiles, reversible fusion, visit voting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.operators.tiles import whole_groups


def votes(points: DataFrame, key: Column, label: str = "cls", weight: str = "w_micro") -> DataFrame:
    """key, label, w, n: summed weight and count of each label in each voxel; partial sums combine map-side."""
    return points.withColumn("key", key).groupBy("key", F.col(label).alias("cls")).agg(F.sum(weight).alias("w"), F.count("*").alias("n"))


def vote_map(points: DataFrame, key: Column, classes: int = 16) -> DataFrame:
    """key, n_obs, centroid x, y, z, cls, share: a fused voxel per key, from points(cls, w_micro, x_mm, y_mm, z_mm).

    One shuffle by key: the label space is fixed, so each class's weight is a conditional sum beside the moments, and
    all of them combine map-side. A class that does not occur has no sum, so it cannot win; ties go to the smallest.
    """
    w = {k: F.sum(F.when(F.col("cls") == k, F.col("w_micro"))).alias(f"w{k}") for k in range(classes)}
    sums = points.withColumn("key", key).groupBy("key").agg(F.count("*").alias("n_obs"), F.sum("x_mm").alias("sx"), F.sum("y_mm").alias("sy"), F.sum("z_mm").alias("sz"), *w.values())
    some = [F.when(F.col(f"w{k}").isNotNull(), F.struct(F.col(f"w{k}").alias("w"), F.lit(-k).alias("low"))) for k in range(classes)]
    total = F.coalesce(F.col("w0"), F.lit(0))
    for k in range(1, classes):
        total = total + F.coalesce(F.col(f"w{k}"), F.lit(0))
    out = sums.withColumns({"best": F.greatest(*some), "total": total})
    return out.select("key", "n_obs", *((F.col(f"s{a}") / F.col("n_obs")).alias(a) for a in "xyz"), (-F.col("best.low")).cast("int").alias("cls"), (F.col("best.w") / F.greatest("total", F.lit(1))).alias("share"))


def contributions(packets: DataFrame, excluded: list[int], least_weight: int) -> DataFrame:
    """Weights and counts by tile, stamp, cell code: what one keyframe adds to the map, and can take back."""
    kept = packets.where(~F.col("label").isin(excluded) & (F.col("w") > 0) & (F.col("w") >= least_weight))
    return kept.groupBy("tx", "ty", "tz", "stamp", "cell", "label").agg(F.sum("w").alias("w"), F.count("*").alias("n"))


def tile_map(contribution: DataFrame) -> DataFrame:
    """tx, ty, tz, cell, label, confidence, point_count, keyframe_count of every voxel of every tile."""
    stamps = contribution.groupBy("tx", "ty", "tz", "cell").agg(F.countDistinct("stamp").alias("keyframe_count"))
    labels = contribution.groupBy("tx", "ty", "tz", "cell", "label").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    best = F.max(F.struct("w", (-F.col("label")).alias("low"))).alias("best")
    cells = labels.groupBy("tx", "ty", "tz", "cell").agg(best, F.sum("w").alias("total"), F.sum("n").alias("point_count"))
    return cells.join(stamps, ["tx", "ty", "tz", "cell"]).select(
        "tx", "ty", "tz", "cell", (-F.col("best.low")).cast("int").alias("label"), (F.col("best.w") / F.col("total")).alias("confidence"), "point_count", "keyframe_count"
    )


def revised_tiles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tiles that a pose revision touches: those in which any keyframe's contribution changed, came, or went."""
    on = ["tx", "ty", "tz", "stamp", "cell", "label"]
    both = old.select(*on, F.col("w").alias("w0"), F.col("n").alias("n0")).join(new.select(*on, "w", "n"), on, "full_outer")
    return both.where(~F.col("w").eqNullSafe(F.col("w0")) | ~F.col("n").eqNullSafe(F.col("n0"))).select("tx", "ty", "tz").distinct()


def refreshed_map(current: DataFrame, new: DataFrame, dirty: DataFrame) -> DataFrame:
    """current with its dirty tiles recomputed from the new contributions; equals a full rebuild."""
    tile = ["tx", "ty", "tz"]
    return current.join(dirty, tile, "left_anti").unionByName(tile_map(new.join(dirty, tile, "left_semi")))


def visit_summary(rows: DataFrame, group_frames: int = 5) -> DataFrame:
    """visit, key, cls -> score: mean per frame, of frames per group, of groups per visit; groups counts groups.

    Each level is a mean over records, so a dense frame weighs no more than a sparse one. Scores are micro-units.
    """
    rows = rows.withColumn("grp", F.floor(F.col("frame") / group_frames).cast("int"))
    frame_n = rows.groupBy("visit", "key", "grp", "frame").agg(F.count("*").alias("n"))
    frame = rows.groupBy("visit", "key", "grp", "frame", "cls").agg(F.sum("w_micro").alias("w")).join(frame_n, ["visit", "key", "grp", "frame"])
    group_n = frame_n.groupBy("visit", "key", "grp").agg(F.count("*").alias("frames"))
    # Integer division at every level keeps the result independent of the order of summing.
    frame = frame.withColumn("s", F.floor(F.col("w") / F.col("n")).cast("long"))
    group = frame.groupBy("visit", "key", "grp", "cls").agg(F.sum("s").alias("s")).join(group_n, ["visit", "key", "grp"])
    group = group.withColumn("s", F.floor(F.col("s") / F.col("frames")).cast("long"))
    visit_n = group_n.groupBy("visit", "key").agg(F.count("*").alias("groups"))
    return group.groupBy("visit", "key", "cls").agg(F.sum("s").alias("s")).join(visit_n, ["visit", "key"]).withColumn("score", F.floor(F.col("s") / F.col("groups")).cast("long")).drop("s")


def leave_own_frame_out(points: DataFrame, key: Column, least: int) -> DataFrame:
    """frame, key, cls: the majority of the other frames' votes in a cell, if it has two thirds of at least ``least``."""
    own = points.withColumn("key", key).groupBy("key", "frame", "cls").agg(F.count("*").alias("own"))
    total = own.groupBy("key", "cls").agg(F.sum("own").alias("all"))
    frames = own.select("key", "frame").distinct()
    pairs = frames.join(total, "key").join(own, ["key", "frame", "cls"], "left").withColumn("rest", F.col("all") - F.coalesce("own", F.lit(0)))
    best = F.max(F.struct("rest", (-F.col("cls")).alias("low"))).alias("best")
    out = pairs.groupBy("key", "frame").agg(best, F.sum("rest").alias("n"))
    return out.where((F.col("n") >= least) & (3 * F.col("best.rest") >= 2 * F.col("n"))).select("frame", "key", (-F.col("best.low")).cast("int").alias("cls"), "n")


def first_per_cell(points: DataFrame, key: Column) -> DataFrame:
    """The first point, in order, of every cell of every frame, and how many the cell has."""
    cells = points.withColumn("key", key).groupBy("frame", "key").agg(F.min(F.struct("pt", "x_mm", "y_mm", "z_mm")).alias("p"), F.count("*").alias("n"))
    return cells.select("frame", "key", "p.*", "n")


def coarsened(map_keys: DataFrame, limit: int, most: int = 64) -> DataFrame:
    """factor, cells: distinct cells at every coarsening factor up to ``most``, and whether it is the least that fits the limit.

    A cell goes to the tile of 128 cells a side in which it lies, and to those before it in which a coarser cell that holds
    it may begin. A coarser cell is counted where it begins, so tiles add up, and a cell is shuffled two or three times
    instead of once for every factor. Within a tile, a factor starts from the distinct cells of its largest divisor.
    """
    from pointweave.functions.geometry import decode_key

    side = 128
    while side < 2 * most:
        side *= 2
    cells = map_keys.select(*(c.cast("long").alias(a) for a, c in zip("xyz", decode_key("key"), strict=True)))
    tile = lambda c: F.floor(c / F.lit(side)).cast("long")
    ends = [(F.col(a), F.col(a) - (most - 1)) for a in "xyz"]
    near = F.array_distinct(F.array(*(F.struct(tile(x).alias("tx"), tile(y).alias("ty"), tile(z).alias("tz")) for x in ends[0] for y in ends[1] for z in ends[2])))
    keys = ["tx", "ty", "tz"]
    rows = cells.where("x IS NOT NULL").select("*", F.explode(near).alias("t")).select("t.*", *"xyz").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(most + 1, np.int64)
        for table, code in whole_groups(batches, keys):
            # Places count from a tile's cells before it, so that they are small and can be packed.
            p = [table.column(a).to_numpy() for a in "xyz"]
            t = [table.column(k).to_numpy() * side for k in keys]
            at = np.flatnonzero(np.diff(code, prepend=-1))
            base = [x[at] for x in t]
            distinct = {}
            for factor in range(1, most + 1):
                divisor = next((factor // q for q in range(2, factor + 1) if factor % q == 0), 0)
                if divisor:
                    g, q = distinct[divisor]
                    q = [(v // (factor // divisor)) for v in q]
                else:
                    g, q = code, p
                # Relative to the coarse cell of the tile's first corner, a coarse cell lies within -64 .. 128.
                low = [b // factor for b in base]
                packed = g
                for v, b in zip(q, low, strict=True):
                    packed = (packed << 10) | (v - b[g] + most)
                packed = np.unique(packed)
                g = packed >> 30
                q = [((packed >> s) & 1023) - most + b[g] for s, b in zip((20, 10, 0), low, strict=True)]
                distinct[factor] = g, q
                begins = np.ones(len(g), bool)
                for v, b in zip(q, base, strict=True):
                    begins &= (v * factor >= b[g]) & (v * factor < b[g] + side)
                total[factor] += int(begins.sum())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["factor", "cells"])

    counts = rows.mapInArrow(run, "factor int, cells long").groupBy("factor").agg(F.sum("cells").alias("cells"))
    return counts.withColumn("chosen", F.col("factor") == F.coalesce(F.min(F.when(F.col("cells") <= limit, F.col("factor"))).over(W.partitionBy()), F.lit(most)))
