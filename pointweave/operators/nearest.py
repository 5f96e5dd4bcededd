"""Nearest neighbours without a radius: groups that fit a task by a tree of boxes, larger ones by cells that widen from level to level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.operators.joins import _offsets
from pointweave.operators.tables import release, stored
from pointweave.operators.tiles import gathered, ranks, sides, whole_groups

#: Cells of a level are cut into 4 x 4 x 4 parts; the next level's cells are four times as wide.
CUT = 4
#: Points of both sides of a group that a task takes; a larger group goes by levels of joins.
IN_TASK = 1 << 20
#: Points of a leaf of the tree of boxes.
LEAF = 128


def _cell(axis: str, width: int) -> Column:
    return F.floor(F.col(axis) / F.lit(width)).cast("long")


class Boxes:
    """Points halved at the median of their widest axis down to leaves, in order of rank within a leaf."""

    def __init__(self, points: np.ndarray, rank: np.ndarray):
        self.points, self.rank = points, rank
        self.root = self._node(np.argsort(rank, kind="stable"))

    def _node(self, rows: np.ndarray) -> tuple:
        p = self.points[rows]
        low, high = p.min(0), p.max(0)
        axis = int((high - low).argmax())
        if len(rows) <= LEAF or low[axis] == high[axis]:
            # Of points in one place only the first by rank can be nearest.
            return low, high, rows[:1] if low[axis] == high[axis] else rows, None
        middle = np.partition(p[:, axis], len(rows) // 2)[len(rows) // 2]
        below = p[:, axis] < middle if middle > low[axis] else p[:, axis] <= middle
        return low, high, None, (self._node(rows[below]), self._node(rows[~below]))

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, squared distance) of the nearest point of each query, ties to the smaller rank."""
        self.queries = queries
        self.best = np.full(len(queries), np.iinfo(np.int64).max)
        self.row = np.full(len(queries), -1)
        self._visit(self.root, np.arange(len(queries)), self._least(self.root, np.arange(len(queries))))
        return self.row, self.best

    def _least(self, node: tuple, at: np.ndarray) -> np.ndarray:
        q = self.queries[at]
        d = np.maximum(np.maximum(node[0] - q, q - node[1]), 0)
        return (d * d).sum(1)

    def _visit(self, node: tuple, at: np.ndarray, least: np.ndarray) -> None:
        at = at[least <= self.best[at]]
        if not len(at):
            return
        if node[3] is None:
            rows = node[2]
            for lo in range(0, len(at), 4096):
                some = at[lo : lo + 4096]
                q, p = self.queries[some], self.points[rows]
                d2 = np.zeros((len(some), len(rows)), np.int64)
                for k in range(3):
                    d = q[:, k, None] - p[None, :, k]
                    d *= d
                    d2 += d
                k = d2.argmin(1)
                near = d2[np.arange(len(some)), k]
                held = self.row[some]
                better = (near < self.best[some]) | ((near == self.best[some]) & ((held < 0) | (self.rank[rows[k]] < self.rank[held])))
                self.best[some[better]], self.row[some[better]] = near[better], rows[k[better]]
            return
        least = [self._least(n, at) for n in node[3]]
        first = least[0] <= least[1]
        for side in (0, 1):
            for turn in (first, ~first):
                child = side if turn is first else 1 - side
                if turn.any():
                    self._visit(node[3][child], at[turn], least[child][turn])


def _in_tasks(left: DataFrame, right: DataFrame, keys: list[str], both: bool) -> DataFrame:
    schema = left.select(*keys, F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.lit(0).cast("long").alias("d2"), F.lit(False).alias("back")).schema
    one = [*keys, "_one"]
    placed = F.expr(" AND ".join(f"{c} IS NOT NULL" for c in (*keys, *"xyz"))).alias("_placed")
    rows = gathered(*(d.select(*keys, F.lit(0).alias("_one"), "id", *"xyz", placed) for d in (left, right)), one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, code in whole_groups(batches, one):
            (a, ga, rows), (b, gb, other) = sides(table, code)
            place = [np.stack([t.column(c).to_numpy().astype(np.int64) for c in "xyz"], 1) for t in (a, b)]
            rank = [ranks(t.column("id")) for t in (a, b)]
            ends = [np.append(np.flatnonzero(np.diff(g, prepend=-1)), len(g)) for g in (ga, gb)]
            start = [dict(zip(g[e[:-1]].tolist(), zip(e[:-1].tolist(), e[1:].tolist()), strict=True)) for g, e in zip((ga, gb), ends, strict=True)]
            out = {False: ([], [], []), True: ([], [], [])}
            for g, (lo, hi) in start[0].items():
                if g not in start[1]:
                    continue
                span = [(lo, hi), start[1][g]]
                for back in (False, True)[: 1 + both]:
                    (q0, q1), (p0, p1) = span[::-1] if back else span
                    of, to = (1, 0) if back else (0, 1)
                    row, d2 = Boxes(place[to][p0:p1], rank[to][p0:p1]).nearest(place[of][q0:q1])
                    for held, x in zip(out[back], (np.arange(q0, q1), row + p0, d2), strict=True):
                        held.append(x)
            for back, parts in out.items():
                if parts[0]:
                    i, j, d2 = (np.concatenate(x) for x in parts)
                    t, u, at = (b, a, other) if back else (a, b, rows)
                    columns = [table.column(c).take(pa.array(at[i])) for c in keys]
                    columns += [t.column("id").take(pa.array(i)), u.column("id").take(pa.array(j)), pa.array(d2), pa.array(np.full(len(i), back))]
                    yield from pa.Table.from_arrays(columns, names=schema.names).combine_chunks().to_batches(1 << 16)

    return rows.mapInArrow(run, schema)


def nearest(left: DataFrame, right: DataFrame, by: tuple[str, ...] = (), width: int = 1_000, both: bool = False) -> DataFrame:
    """by, id_a, id_b, d2: the nearest of all right points (by, id, x, y, z) for every left point with the same ``by``.

    Coordinates are integers. Groups are counted first. One of at most IN_TASK points, of both sides, is shuffled once and
    searched in its task by a tree of boxes. Of larger ones no task holds all: a loop of joins takes them, see by_levels().
    With ``both``, rows of the right points' nearest left ones follow, with ``back`` true (then a column of all rows).

    Ties go to the smaller id, right points of equal place count once. Left points without any right point of their
    ``by`` have no row. Null coordinates are in no place; such points have no row and are nobody's neighbour, nor do
    nulls in ``by`` equal each other.
    """
    keys = list(by)
    known = " AND ".join(f"{c} IS NOT NULL" for c in (*keys, *"xyz"))
    left, right = (d.select(*keys, "id", *"xyz") for d in (left, right))
    sizes = left.select(*keys).unionByName(right.select(*keys)) if keys else left.select("id").union(right.select("id"))
    large = sizes.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > IN_TASK).select(*keys, F.lit(0).alias("_large"))
    large = stored(large, "nearest-large")
    columns = [*keys, "id_a", "id_b", "d2", *(["back"] if both else [])]
    if not large.head(1):
        release(large)
        return _in_tasks(left, right, keys, both).select(*columns)
    pick = lambda d, how: d.join(large, keys, how) if keys else d.join(large, F.lit(True), how)
    out = _in_tasks(pick(left, "left_anti"), pick(right, "left_anti"), keys, both)
    far_left, far_right = (pick(d.where(known), "left_semi") for d in (left, right))
    levels = by_levels(far_left, far_right, by, width).withColumn("back", F.lit(False))
    if both:
        levels = levels.unionByName(by_levels(far_right, far_left, by, width).withColumn("back", F.lit(True)))
    return out.unionByName(levels).select(*columns)


def by_levels(left: DataFrame, right: DataFrame, by: tuple[str, ...] = (), width: int = 1_000) -> DataFrame:
    """nearest() of groups of any size, by joins.

    On a level, a left point looks into its 27 cells of ``width``; there, it bounds its
    distance by one right point for each part of a cell, and meets the points of only those parts that can hold a nearer
    one. It is settled if the nearest is within the cells' width, as no point of another cell is nearer then. All others go
    to the next level, with wider cells; few do if the first width suits the points' density. Every level is an
    equi-join, so a far point costs some more levels, never a pairing of all points.
    """
    keys = list(by)
    known = " AND ".join(f"{a} IS NOT NULL" for a in "xyz")
    right = right.where(known).groupBy(*keys, *"xyz").agg(F.min("id").alias("id"))
    right = stored(right, "nearest-right")
    some = right.select(*keys).distinct() if keys else right.select(F.lit(1)).limit(1)
    left = left.where(known).select(*keys, "id", *"xyz")
    open_left = stored(left.join(some, keys, "left_semi") if keys else left.join(some, F.lit(True), "left_semi"), "nearest-open")
    found = []
    while open_left.head(1):
        part = max(1, width // CUT)
        wide = part * CUT
        cells = right.groupBy(*keys, *(_cell(a, part).alias(f"p{a}") for a in "xyz")).agg(F.min(F.struct("id", *"xyz")).alias("one"))
        cells = cells.withColumns({f"c{a}": F.floor(F.col(f"p{a}") / CUT).cast("long") for a in "xyz"})
        looks = open_left.withColumns({f"c{a}": _cell(a, wide) for a in "xyz"}).select("*", _offsets().alias("o"))
        looks = looks.withColumns({f"c{a}": F.col(f"c{a}") + F.col(f"o.d{a}") for a in "xyz"}).drop("o")
        seen = looks.join(cells, [*keys, "cx", "cy", "cz"])
        square = lambda deltas: sum((d * d for d in deltas[1:]), deltas[0] * deltas[0])
        least = [F.greatest(F.col(f"p{a}") * part - F.col(a), F.col(a) - (F.col(f"p{a}") * part + part - 1), F.lit(0)) for a in "xyz"]
        seen = seen.select(*keys, "id", *"xyz", "px", "py", "pz", square(least).alias("least"), square([F.col(a) - F.col(f"one.{a}") for a in "xyz"]).alias("most"))
        seen = stored(seen, "nearest-parts")
        bound = seen.groupBy(*keys, "id").agg(F.min("most").alias("bound"))
        near = seen.join(bound, [*keys, "id"]).where("least <= bound")
        held = right.select(*keys, F.col("id").alias("id_b"), *(F.col(a).alias(f"{a}_b") for a in "xyz"), *(_cell(a, part).alias(f"p{a}") for a in "xyz"))
        met = near.join(held, [*keys, "px", "py", "pz"]).select(*keys, "id", "id_b", square([F.col(a) - F.col(f"{a}_b") for a in "xyz"]).alias("d2"))
        best = stored(met.groupBy(*keys, "id").agg(F.min(F.struct("d2", "id_b")).alias("m")).select(*keys, F.col("id").alias("id_a"), "m.id_b", "m.d2"), "nearest-found")
        release(seen)
        settled = best.where(F.col("d2") <= F.lit(min(wide * wide, 2**63 - 1)).cast("long"))
        found.append(settled)
        before = open_left
        open_left = stored(before.join(settled.select(*keys, F.col("id_a").alias("id")), [*keys, "id"], "left_anti"), "nearest-open")
        release(before)
        width = wide * CUT
    release(open_left, right)
    if not found:
        return left.select(*keys, F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.lit(None).cast("long").alias("d2")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
