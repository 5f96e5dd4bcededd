"""A bounded memory of observations in space: records per cell, how long they live, retrieval by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.operators.tiles import CELLS, nearest_within

CELL = ("gx", "gy", "gz")


def _grid(size: int) -> dict[str, Column]:
    return {f"g{a}": F.floor(F.col(a) / F.lit(size)).cast("long") for a in "xyz"}


def records(points: DataFrame, size: int, order: list[str], columns: list[str]) -> DataFrame:
    """frame, gx, gy, gz and columns: one point per cell and frame, the first in order, so that a dense sweep is one vote."""
    first = points.withColumns(_grid(size)).groupBy("frame", *CELL).agg(F.min(F.struct(*order, F.struct(*columns).alias("own"))).alias("first"))
    return first.select("frame", *CELL, "first.own.*")


def alive(recorded: DataFrame, per_cell: int, most_age: int) -> DataFrame:
    """recorded rows for every later frame ``at`` in which memory still holds them.

    A cell keeps its per_cell newest records, so one goes when that many newer have been written; what is written in a
    frame is read from the next on. No record is older than most_age frames, so each has most_age rows at most.
    """
    newer = F.lead("frame", per_cell).over(W.partitionBy(*CELL).orderBy("frame"))
    last = F.least(F.col("frame") + most_age, F.coalesce(newer, F.col("frame") + most_age))
    return recorded.withColumn("last", last).withColumn("at", F.explode(F.sequence(F.col("frame") + 1, F.col("last")))).drop("last")


def retrieved(queries: DataFrame, held: DataFrame, radius2: int, k: int) -> DataFrame:
    """The k nearest held records within the radius of each query(frame, cell, id, x, y, z, ...), from its 27 cells."""
    side = range(-1, 2)
    offsets = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in side for b in side for c in side)))
    spread = queries.withColumn("o", offsets).withColumns({g: F.col(g) + F.col(f"o.{c}") for g, c in zip(CELL, "abc", strict=True)}).drop("o")
    a, b = spread.withColumnsRenamed({c: f"{c}_a" for c in queries.columns if c not in CELL}), held.withColumnsRenamed({c: f"{c}_b" for c in held.columns if c not in (*CELL, "at")})
    near = a.join(b, [*CELL]).where("frame_a = at")
    d2 = sum(((F.col(f"{c}_a") - F.col(f"{c}_b")) * (F.col(f"{c}_a") - F.col(f"{c}_b")) for c in "yz"), (F.col("x_a") - F.col("x_b")) * (F.col("x_a") - F.col("x_b")))
    near = near.withColumn("d2", d2).where(F.col("d2") <= radius2)
    best = near.withColumn("place", F.row_number().over(W.partitionBy("id_a").orderBy("d2", "id_b"))).where(F.col("place") <= k)
    return best.withColumn("age", (F.col("frame_a") - F.col("frame_b")).cast("int")).drop("place", "at", *CELL)


#: Frames of a block: a record is sent once to each block whose frames may read it.
BLOCK = 16


def retrieved_alive(recorded: DataFrame, per_cell: int, most_age: int, radius2: int, k: int) -> DataFrame:
    """retrieved(recorded, alive(recorded, per_cell, most_age), radius2, k), without a row for every frame that reads a record.

    A record goes to the tiles around it once for each block of frames, with the frames in which it is held.
    """
    newer = F.lead("frame", per_cell).over(W.partitionBy(*CELL).orderBy("frame"))
    last = F.least(F.col("frame") + most_age, F.coalesce(newer, F.col("frame") + most_age))
    cells = recorded.withColumnsRenamed(dict(zip(CELL, CELLS, strict=True)))
    block = lambda c: F.floor(c / F.lit(BLOCK)).cast("long")
    held = recorded.withColumn("last", last).where("last > frame").withColumnsRenamed(dict(zip(CELL, CELLS, strict=True)))
    held = held.withColumn("_block", F.explode(F.sequence(block(F.col("frame") + 1), block(F.col("last")))))

    def reads(a, i, b, j):
        at, since, until = a.column("frame").to_numpy()[i], b.column("frame").to_numpy()[j], b.column("last").to_numpy()[j]
        return (at > since) & (at <= until)

    near = nearest_within(cells.withColumn("_block", block(F.col("frame"))), held, radius2, k, ("_block",), reads)
    return near.withColumn("age", (F.col("frame_a") - F.col("frame_b")).cast("int")).drop("place", "_block", "last_b")


def kept_until(recorded: DataFrame, fronts: DataFrame, margin: int, per_cell: int, most_age: int) -> DataFrame:
    """recorded(frame, cell, id, ray, r, ...) plus revoked_at and last: memory holds a record in the frames after its own up to ``last``.

    A record that lies in front of the nearest return of its ray (fronts: at, ray, front) by more than the margin was
    seen through: it is revoked in that frame, before the frame writes, and frees its place. It also goes after most_age
    frames, or when a frame writes into its cell and per_cell newer records are there that have neither been revoked nor
    expired; that frame still reads it. An older record never stays where a newer one had to go, so the count needs no
    simulation: of each record, only those of its cell in the most_age frames after it matter. revoked_at is null for a
    record that was gone before. A ray without a return tells nothing.
    """
    life = recorded.select("id", "frame", "ray", "r", F.explode(F.sequence(F.col("frame") + 1, F.col("frame") + most_age)).alias("at"))
    seen = life.join(fronts, ["at", "ray"]).where(F.col("r") < F.col("front") - margin)
    through = seen.groupBy("id").agg(F.min("at").alias("through"))
    own = recorded.join(through, "id", "left").withColumn("ends", F.least(F.col("frame") + most_age, F.coalesce(F.col("through") - 1, F.col("frame") + most_age)))
    after = W.partitionBy(*CELL).orderBy("frame").rowsBetween(1, most_age)
    own = own.withColumn("newer", F.collect_list(F.struct("frame", "ends")).over(after))
    full = lambda w: F.size(F.filter("newer", lambda n: (n["frame"] <= w["frame"]) & (n["ends"] >= w["frame"]))) >= per_cell
    evicted = F.array_min(F.transform(F.filter("newer", lambda w: (w["frame"] <= F.col("ends")) & full(w)), lambda w: w["frame"]))
    own = own.withColumn("evicted", evicted)
    return own.withColumns({"revoked_at": F.when(F.col("evicted").isNull(), F.col("through")), "last": F.least("ends", F.coalesce("evicted", "ends"))}).drop("newer", "evicted", "ends", "through")


def evidence(recorded: DataFrame, fronts: DataFrame, margin: int, per_cell: int, most_age: int) -> DataFrame:
    """recorded's columns, at, readable, revoked: a row for each frame that holds a record, and one where it is revoked.

    A held record that lies behind the nearest return of its ray by more than the margin is occluded: not readable then.
    """
    own = kept_until(recorded, fronts, margin, per_cell, most_age)
    until = F.coalesce("revoked_at", "last")
    rows = own.where(until > F.col("frame")).withColumn("at", F.explode(F.sequence(F.col("frame") + 1, until)))
    rows = rows.withColumn("revoked", F.col("at") > F.col("last")).join(fronts, ["at", "ray"], "left")
    hidden = F.coalesce(F.col("r") > F.col("front") + margin, F.lit(False))
    return rows.withColumn("readable", ~F.col("revoked") & ~hidden).drop("front", "last", "revoked_at")
