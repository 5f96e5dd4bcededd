"""Operators over ordered rows: runs, episodes, carried signs, unwrapped angles, previous observations, sequential picks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def runs(rows: DataFrame, by: list[str], frame: str) -> DataFrame:
    """rows plus run: maximal stretches of consecutive frames, named by the first one's distance to its rank."""
    order = W.partitionBy(*by).orderBy(frame)
    return rows.withColumn("run", (F.col(frame) - F.row_number().over(order)).cast("int"))


def episodes(rows: DataFrame, by: list[str], frame: str, stamp: str, right: str) -> DataFrame:
    """Stretches of errors within runs of consecutive frames, and how each ends.

    by, run, start and recovered stamps, length, first_observed (the track's first frame is wrong), reappearance (a
    later run starts wrong), censored (the run ends before it recovers).
    """
    rows = runs(rows, by, frame)
    in_run = W.partitionBy(*by, "run").orderBy(frame)
    rows = rows.withColumn("first_run", F.min("run").over(W.partitionBy(*by)))
    rows = rows.withColumn("island", F.sum(F.when(F.col(right), 1).otherwise(0)).over(in_run)).withColumn("at", F.row_number().over(in_run))
    rows = rows.withColumn("next_stamp", F.lead(stamp).over(in_run)).withColumn("next_right", F.lead(right).over(in_run))
    out = rows.where(~F.col(right)).groupBy(*by, "run", "island").agg(
        F.min(stamp).alias("start"), F.count("*").alias("length"), F.max(F.when(F.col("next_right"), F.col("next_stamp"))).alias("recovered"), F.min("at").alias("at"), F.min("first_run").alias("first_run")
    )
    first = F.col("at") == 1
    return out.withColumns({
        "first_observed": first & (F.col("run") == F.col("first_run")),
        "reappearance": first & (F.col("run") != F.col("first_run")),
        "censored": F.col("recovered").isNull(),
    }).drop("island", "at", "first_run")


def delay_to_success(rows: DataFrame, by: list[str], stamp: str, right: str, extra: int) -> DataFrame:
    """by, start, delay to the first right row, capped at the common horizon: the last stamp - start + extra."""
    out = rows.groupBy(*by).agg(F.min(stamp).alias("start"), F.max(stamp).alias("last"), F.min(F.when(F.col(right), F.col(stamp))).alias("hit"))
    horizon = F.col("last") - F.col("start") + extra
    return out.select(*by, "start", F.least(F.coalesce(F.col("hit") - F.col("start"), horizon), horizon).alias("delay"), F.col("hit").isNull().alias("censored"))


def previous(rows: DataFrame, by: list[str], frame: str, columns: list[str], most_age: int | None = None, stamp: str | None = None) -> DataFrame:
    """rows plus prev_* of the row exactly one frame before, null otherwise or if older than most_age."""
    order = W.partitionBy(*by).orderBy(frame)
    fits = F.lag(frame).over(order) == F.col(frame) - 1
    if most_age is not None:
        fits = fits & (F.col(stamp) - F.lag(stamp).over(order) <= most_age)
    return rows.withColumns({f"prev_{c}": F.when(fits, F.lag(c).over(order)) for c in columns})


def carried_sign(rows: DataFrame, by: list[str], order_by: str, q: list[str]) -> DataFrame:
    """rows plus sign: 1 or -1, so that each quaternion lies on its corrected predecessor's side.

    The sign is the parity of the negative products of raw neighbours so far; a product of exactly 0 starts afresh.
    """
    w = W.partitionBy(*by).orderBy(order_by)
    dot = sum((F.col(c) * F.lag(c).over(w) for c in q[1:]), F.col(q[0]) * F.lag(q[0]).over(w))
    rows = rows.withColumn("_dot", dot)
    rows = rows.withColumn("_part", F.sum(F.when(F.col("_dot") == 0, 1).otherwise(0)).over(w))
    flips = F.sum(F.when(F.col("_dot") < 0, 1).otherwise(0)).over(W.partitionBy(*by, "_part").orderBy(order_by))
    return rows.withColumn("sign", F.when(F.pmod(flips, F.lit(2)) == 1, -1).otherwise(1)).drop("_dot", "_part")


def unwrapped_rings(rows: DataFrame, by: list[str], order_by: str, angle: str, turn: int) -> DataFrame:
    """rows plus swept, ring and phase of an angle in units of ``turn`` per revolution that only grows.

    Differences are wrapped to the half-open half turn and clipped at 0, then summed.
    """
    w = W.partitionBy(*by).orderBy(order_by)
    d = F.col(angle) - F.lag(angle).over(w)
    wrapped = F.pmod(d + turn // 2 - 1, F.lit(turn)) - (turn // 2 - 1)
    rows = rows.withColumn("_step", F.greatest(F.coalesce(wrapped, F.lit(0)), F.lit(0)))
    rows = rows.withColumn("swept", F.sum("_step").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_step")
    return rows.withColumns({"ring": F.floor(F.col("swept") / turn).cast("long"), "phase": F.pmod(F.col("swept"), F.lit(turn))})


def ring_breaks(rows: DataFrame, by: list[str], order_by: str, angle: str, drop: int) -> DataFrame:
    """rows plus ring: it grows where the angle falls by more than ``drop``."""
    w = W.partitionBy(*by).orderBy(order_by)
    rows = rows.withColumn("_break", F.when(F.lag(angle).over(w) - F.col(angle) > drop, 1).otherwise(0))
    return rows.withColumn("ring", F.sum("_break").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_break")


def kinematics(rows: DataFrame, by: list[str], stamp: str, x: str, y: str) -> DataFrame:
    """by, n, path2 (sum of squared steps), displacement2, duration: of each track's positions in time."""
    w = W.partitionBy(*by).orderBy(stamp)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    rows = rows.withColumn("_step", F.coalesce(dx * dx + dy * dy, F.lit(0)))
    ends = lambda f: f(F.struct(stamp, x, y))
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("_step").alias("path2"), ends(F.min).alias("a"), ends(F.max).alias("b"))
    ax, ay, bx, by_ = (F.col(c) for c in (f"a.{x}", f"a.{y}", f"b.{x}", f"b.{y}"))
    return out.select(*by, "n", "path2", ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)).alias("displacement2"), (F.col(f"b.{stamp}") - F.col(f"a.{stamp}")).alias("duration"))


def velocity(rows: DataFrame, by: list[str], stamp: str, x: str, most: float) -> DataFrame:
    """rows plus v and predicted: from the last two earlier observations; no velocity beyond ``most``."""
    w = W.partitionBy(*by).orderBy(stamp)
    dt = F.lag(stamp, 1).over(w) - F.lag(stamp, 2).over(w)
    v = (F.lag(x, 1).over(w) - F.lag(x, 2).over(w)) / F.when(dt > 0, dt)
    rows = rows.withColumn("v", F.when(F.abs(v) <= most, v))
    return rows.withColumn("predicted", F.lag(x, 1).over(w) + F.coalesce(F.col("v"), F.lit(0.0)) * (F.col(stamp) - F.lag(stamp, 1).over(w)))


def baseline(rows: DataFrame, by: list[str], stamp: str, least: int) -> DataFrame:
    """rows plus base: the newest earlier stamp at least ``least`` before, by a value-range frame."""
    w = W.partitionBy(*by).orderBy(stamp).rangeBetween(W.unboundedPreceding, -least)
    return rows.withColumn("base", F.max(stamp).over(w))


def history_weights(rows: DataFrame, by: list[str], stamp: str, value: str, scale: float, depth: int = 4) -> DataFrame:
    """rows plus history: the age-weighted mean of up to ``depth`` earlier values, weights over at least 1 in all."""
    w = W.partitionBy(*by).orderBy(stamp).rowsBetween(-depth, -1)
    rows = rows.withColumn("_past", F.collect_list(F.struct(F.col(stamp).alias("t"), F.col(value).alias("v"))).over(w))
    weight = lambda x: F.exp(-(F.col(stamp) - x["t"]) / scale)
    total = F.aggregate("_past", F.lit(0.0), lambda a, x: a + weight(x))
    mean = F.aggregate("_past", F.lit(0.0), lambda a, x: a + weight(x) * x["v"]) / F.greatest(total, F.lit(1.0))
    return rows.withColumn("history", mean).drop("_past")


def quarters(rows: DataFrame, by: list[str], stamp: str) -> DataFrame:
    """rows plus quarter 0..3 of the elapsed time of its group."""
    w = W.partitionBy(*by)
    share = (F.col(stamp) - F.min(stamp).over(w)) / F.greatest(F.max(stamp).over(w) - F.min(stamp).over(w), F.lit(1))
    return rows.withColumn("quarter", F.least(F.floor(share * 4), F.lit(3)).cast("int"))


def thinned(rows: DataFrame, by: list[str], stamp: str, interval: int) -> DataFrame:
    """Rows at least ``interval`` after the last accepted one: a fold over each group's sorted stamps.

    Which row is accepted depends on the one accepted before, so no window frame expresses it. A group's stamps,
    two columns, are folded together; groups are independent.
    """
    schema = rows.select(*by, stamp).schema

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(stamp)
        keep, last = [], None
        for t in group[stamp]:
            take = last is None or t - last >= interval
            keep.append(take)
            last = t if take else last
        return group[keep]

    return rows.select(*by, stamp).groupBy(*by).applyInPandas(fold, schema)


def argsorted(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "place") -> DataFrame:
    """rows plus their stable place in an order, from 0."""
    return rows.withColumn(name, (F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1).cast("int"))


def revisions_accepted(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows(version, n_old, sum_old, time) plus accepted: machines.Revisions without arrays, as a running window.

    A revision adds one time and tells number and sum of its old times. It is good if its version grows, its old times
    are the last revision's, and its time is later; the first bad one rejects all after it.
    """
    w = W.partitionBy(*by).orderBy("version")
    last = lambda c: F.lag(c).over(w)
    first = F.row_number().over(w) == 1
    grows = (F.col("version") > last("version")) & (F.col("n_old") == last("n_old") + 1) & (F.col("sum_old") == last(F.col("sum_old") + F.col("time"))) & (F.col("time") > last("time"))
    good = F.when(first, F.col("n_old") == 0).otherwise(grows)
    running = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("good", good).withColumn("accepted", F.min("good").over(running)).drop("good")
