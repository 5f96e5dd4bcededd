"""Grid neighbours tile by tile: points are shuffled once, with a thin border, and meet by cells within a task.

A join on 27 cells for each point shuffles a point 27 times. Here a point goes to its tile of 64 cells a side once, and a
point of the other side also to the tiles that its neighbour cells touch, about a tenth more. Rows are sorted by tile, so
a task holds the tiles of one block of rows, never a frame, and looks cells up there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Cells on a side of a tile, as a power of two.
TILE = 6
#: Rows that a task gathers before it works on their whole groups, and candidate pairs that it holds at a time.
ROWS, PAIRS = 1 << 17, 1 << 20
CELLS = ("cx", "cy", "cz")


def codes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Numbers of the groups of a table that is sorted by its keys."""
    fresh = np.zeros(max(0, table.num_rows), bool)
    for k in keys:
        c = table.column(k).combine_chunks()
        fresh[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False)
    return np.cumsum(fresh)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the groups' numbers, of batches that are sorted by their keys."""
    held, n, enough = [], 0, ROWS
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= enough:
            table = pa.Table.from_batches(held).combine_chunks()
            code = codes(table, keys)
            cut = int(np.searchsorted(code, code[-1]))
            if cut:
                yield table.slice(0, cut), code[:cut]
                table = table.slice(cut)
            held, n = table.to_batches(), table.num_rows
            enough = max(ROWS, 2 * n)
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, codes(table, keys)


def sides(table: pa.Table, code: np.ndarray, drop: tuple[str, ...] = ("_a", "_b")) -> list[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(columns, group numbers, rows) of the two sides of a table that gathered() made; unplaced rows of some sides go.

    They go here and not by a filter before the shuffle: filters differ by side, and two sides that come from one table
    would then read and shuffle it twice.
    """
    out = []
    for name in ("_a", "_b"):
        rows = np.flatnonzero(table.column(name).is_valid().to_numpy())
        part = table.column(name).combine_chunks().take(pa.array(rows))
        if name in drop:
            placed = np.flatnonzero(part.field("_placed").to_numpy(zero_copy_only=False))
            part, rows = part.take(pa.array(placed)), rows[placed]
        out.append((pa.Table.from_arrays(part.flatten(), names=[f.name for f in part.type]), code[rows], rows))
    return out


def gathered(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides by the same keys, shuffled and sorted by them; the other columns are in the structs _a and _b."""
    own = {s: F.struct(*(c for c in d.columns if c not in keys)) for s, d in (("_a", left), ("_b", right))}
    kind = {s: d.select(own[s].alias("s")).schema["s"].dataType for s, d in (("_a", left), ("_b", right))}
    a = left.select(*keys, own["_a"].alias("_a"), F.lit(None).cast(kind["_b"]).alias("_b"))
    b = right.select(*keys, F.lit(None).cast(kind["_a"]).alias("_a"), own["_b"].alias("_b"))
    return a.union(b).repartition(*keys).sortWithinPartitions(*keys)


def _tile_of(cells: list[Column]) -> Column:
    x, y, z = (F.shiftright(c, TILE).bitwiseAND(F.lit((1 << 21) - 1).cast("long")) for c in cells)
    return F.shiftleft(x, 42).bitwiseOR(F.shiftleft(y, 21)).bitwiseOR(z)


def bordered(rows: DataFrame, reach: int) -> DataFrame:
    """rows(cx, cy, cz) once for each tile that is within ``reach`` cells of them, in _tile; _own marks their own tile."""
    own = _tile_of([F.col(c) for c in CELLS])
    if not reach:
        return rows.withColumns({"_tile": own, "_own": F.lit(True)})
    ends = [(F.col(c) - reach, F.col(c) + reach) for c in CELLS]
    near = F.array_distinct(F.array(*(_tile_of([x, y, z]) for x in ends[0] for y in ends[1] for z in ends[2])))
    return rows.withColumn("_tile", F.explode(near)).withColumn("_own", F.col("_tile") == own)


def _mixed(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class Columns:
    """Rows in the order of group and cell, so that the cells of a group above each other are one range of rows."""

    def __init__(self, group: np.ndarray, cells: list[np.ndarray]):
        self.order = np.lexsort((*cells[::-1], group))
        g, (x, y, z) = group[self.order], (c[self.order] for c in cells)
        fresh = np.ones(len(g), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        first = np.flatnonzero(fresh)
        column = np.cumsum(fresh) - 1
        self.low = z[first]
        self.span = int((z - self.low[column]).max(initial=0)) + 3
        self.place = column * self.span + (z - self.low[column] + 1)
        salt = 0
        while True:
            self.salt = np.full(1, salt, np.int64)
            self.at = (g[first], x[first], y[first])
            keys = _mixed(np.broadcast_to(self.salt, len(first)), *self.at)
            self.by_key = np.argsort(keys)
            self.keys = keys[self.by_key]
            if not (self.keys[1:] == self.keys[:-1]).any():
                break
            salt += 1

    def ranges(self, group: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """First and end of the rows in the column of cells x, y that are within ``reach`` of z."""
        start, end = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        if len(self.keys) and len(group):
            keys = _mixed(np.broadcast_to(self.salt, len(group)), group, x, y)
            at = self.by_key[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)]
            some = np.flatnonzero((self.at[0][at] == group) & (self.at[1][at] == x) & (self.at[2][at] == y))
            column, up = at[some], z[some] - self.low[at[some]] + 1
            start[some] = np.searchsorted(self.place, column * self.span + np.clip(up - reach, 0, self.span - 1))
            end[some] = np.searchsorted(self.place, column * self.span + np.clip(up + reach, 0, self.span - 1), "right")
        return start, np.maximum(start, end)

    def pairs(self, group: np.ndarray, cells: list[np.ndarray], reach: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of rows and of all those in the cells around them; all pairs of one row come together."""
        side = range(-reach, reach + 1)
        found = [self.ranges(group, cells[0] + dx, cells[1] + dy, cells[2], reach) for dx in side for dy in side]
        start, count = np.stack([s for s, _ in found], 1), np.stack([e - s for s, e in found], 1)
        upto = np.cumsum(count.sum(1))
        lo = 0
        while lo < len(group):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
            n, s = count[lo:hi].ravel(), start[lo:hi].ravel()
            total = int(n.sum())
            if total:
                at = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(total)
                yield np.repeat(np.arange(lo, hi), count[lo:hi].sum(1)), self.order[at]
            lo = hi


def ranks(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of a column's values."""
    if pa.types.is_integer(column.type):
        return pc.fill_null(column, 0).to_numpy()
    return np.unique(np.asarray(column.to_pylist(), dtype=object), return_inverse=True)[1]


def _cells(table: pa.Table) -> list[np.ndarray]:
    return [pc.fill_null(table.column(c), 0).to_numpy() for c in CELLS]


def _xyz(table: pa.Table) -> list[np.ndarray]:
    return [pc.fill_null(table.column(a), 0).to_numpy() for a in "xyz"]


Allowed = Callable[[pa.Table, np.ndarray, pa.Table, np.ndarray], np.ndarray]


def _best(a: pa.Table, ga: np.ndarray, rows: np.ndarray, b: pa.Table, gb: np.ndarray, radius2: float, k: int, allowed: Allowed | None) -> tuple[np.ndarray, ...]:
    """(places in a, places in b, squared distance, place) of the k nearest of b for the given rows of a, ties to the smaller id."""
    pa_, pb, ids = _xyz(a), _xyz(b), ranks(b.column("id"))
    columns, ca = Columns(gb, _cells(b)), _cells(a)
    out = []
    for i, j in columns.pairs(ga[rows], [c[rows] for c in ca]):
        i = rows[i]
        d = [p[i] - q[j] for p, q in zip(pa_, pb, strict=True)]
        d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
        ok = d2 <= radius2
        if allowed is not None:
            some = np.flatnonzero(ok)
            ok[some] = allowed(a, i[some], b, j[some])
        i, j, d2 = i[ok], j[ok], d2[ok]
        order = np.lexsort((ids[j], d2, i))
        i, j, d2 = i[order], j[order], d2[order]
        fresh = np.ones(len(i), bool)
        fresh[1:] = i[1:] != i[:-1]
        first = np.flatnonzero(fresh)
        place = np.arange(len(i)) - first[np.cumsum(fresh) - 1] + 1 if len(i) else np.zeros(0, np.int64)
        near = place <= k
        out.append((i[near], j[near], d2[near], place[near]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _schema(left: DataFrame, right: DataFrame, by: list[str], more: str) -> tuple[StructType, list[str], list[str]]:
    inner = {s: [c for c in d.columns if c not in (*by, *CELLS)] for s, d in (("a", left), ("b", right))}
    out = left.select(*by, *(F.col(c).alias(f"{c}_a") for c in inner["a"])).schema
    out = StructType(list(out) + [f for f in right.select(*(F.col(c).alias(f"{c}_b") for c in inner["b"])).schema] + list(StructType.fromDDL(more)))
    return StructType([type(f)(f.name, f.dataType, True) for f in out]), inner["a"], inner["b"]


def nearest_within(left: DataFrame, right: DataFrame, radius2: float, k: int, by: tuple[str, ...] = (), allowed: Allowed | None = None, reciprocal: bool = False, keep: bool = False) -> DataFrame:
    """by, left's columns with _a, right's with _b, d2, place: the k nearest right points of each left point within the radius.

    Both have by, id, x, y, z and, as cx, cy, cz, the cells they are in, which are as wide as the radius. ``allowed``
    judges candidate pairs, before the nearest are chosen. With ``reciprocal`` (k is 1) only pairs stay in which each is the
    other's nearest, ties to the smaller id on both sides; left points then come from two cells around a tile, as whoever
    is nearest to a border point has to be known. With ``keep`` left points without a match stay, with nulls. Ids are
    unique. Points without a place, and those with a null in ``by``, match nothing.
    """
    keys = [*by, "_tile"]
    placed = " AND ".join(f"{c} IS NOT NULL" for c in (*by, *CELLS, *"xyz"))
    whole = "long" if all(t in ("int", "bigint", "smallint", "tinyint") for d in (left, right) for c, t in d.dtypes if c in tuple("xyz")) else "double"
    schema, of_a, of_b = _schema(left, right, list(by), f"d2 {whole}, place int")
    known = {"_placed": F.coalesce(F.expr(placed), F.lit(False)), **{c: F.coalesce(c, F.lit(0).cast("long")) for c in CELLS}}
    left, right = left.withColumns(known), right.withColumns(known)
    both = gathered(bordered(left, 2 if reciprocal else 0), bordered(right, 1).drop("_own"), keys)
    kind = np.int64 if whole == "long" else np.float64
    by = list(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, code in whole_groups(batches, keys):
            (a, ga, rows), (b, gb, _) = sides(table, code, ("_b",) if keep else ("_a", "_b"))
            own, known = (a.column(c).to_numpy() for c in ("_own", "_placed"))
            i, j, d2, place = _best(a, ga, np.flatnonzero(own & known), b, gb, radius2, k, allowed)
            if reciprocal and len(i):
                back = None if allowed is None else lambda b, j, a, i: allowed(a, i, b, j)
                there = np.flatnonzero(known)
                first, mine, _, _ = _best(b, gb, np.unique(j), a.take(pa.array(there)), ga[there], radius2, 1, back)
                chosen = np.full(len(gb), -1)
                chosen[first] = there[mine]
                ok = chosen[j] == i
                i, j, d2, place = i[ok], j[ok], d2[ok], place[ok]
            alone = np.setdiff1d(np.flatnonzero(own), i) if keep else i[:0]
            n, at = len(i), pa.array(np.concatenate([i, alone]))
            none = np.arange(n + len(alone)) >= n
            other = pa.array(np.concatenate([j, alone * 0]), mask=none)
            out = [table.column(c).take(pa.array(rows[np.concatenate([i, alone])])) for c in by]
            out += [a.column(c).take(at) for c in of_a] + [b.column(c).take(other) for c in of_b]
            out += [pa.array(np.concatenate([d2, alone * 0]).astype(kind), mask=none), pa.array(np.concatenate([place, alone * 0]).astype(np.int32), mask=none)]
            yield from pa.Table.from_arrays(out, names=schema.names).combine_chunks().to_batches(1 << 16)

    return both.mapInArrow(run, schema)


def windows(pixels: DataFrame, values: list[str], reach: int) -> DataFrame:
    """pixels(frame, u, v, ...) plus lo and hi of each value, as lo_{value} and hi_{value}: the least and greatest one of all
    pixels of the frame within ``reach`` in u and in v.

    Pixels are shuffled once by tile, with a border as wide as the reach. Values are whole numbers. Nulls in frame, u or v
    are in no place: such rows go. A null value is not counted; lo and hi are null where there is no other.
    """
    cells = {"cx": F.col("u").cast("long"), "cy": F.lit(1 << TILE - 1).cast("long"), "cz": F.col("v").cast("long")}
    rows = pixels.where("frame IS NOT NULL AND u IS NOT NULL AND v IS NOT NULL").withColumns(cells)
    rows = bordered(rows, reach).repartition("frame", "_tile").sortWithinPartitions("frame", "_tile")
    ends = [f"{end}_{v}" for v in values for end in ("lo", "hi")]
    schema = StructType(list(pixels.schema) + list(StructType.fromDDL(", ".join(f"`{c}` long" for c in ends))))
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, code in whole_groups(batches, ["frame", "_tile"]):
            u, v = (table.column(c).to_numpy() for c in ("cx", "cz"))
            order = np.lexsort((v, u, code))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (np.diff(code[order]) != 0) | (np.diff(u[order]) != 0) | (np.diff(v[order]) != 0)
            first = np.flatnonzero(fresh)
            at = order[first]
            cell = np.empty(len(order), np.int64)
            cell[order] = np.cumsum(fresh) - 1
            flat = np.zeros(len(at), np.int64)
            columns = Columns(code[at], [u[at], flat, v[at]])
            held = {}
            for name in values:
                z = table.column(name)
                for end, none, low in (("lo", most, np.minimum), ("hi", least, np.maximum)):
                    held[f"{end}_{name}"] = low.reduceat(pc.fill_null(z.cast(pa.int64()), none).to_numpy()[order], first), none, low
            own = np.flatnonzero(table.column("_own").to_numpy())
            wanted = np.unique(cell[own])
            found = {c: np.full(len(wanted), none) for c, (_, none, _) in held.items()}
            for du in range(-reach, reach + 1):
                start, end = columns.ranges(code[at][wanted], u[at][wanted] + du, flat[wanted], v[at][wanted], reach)
                for step in range(int((end - start).max(initial=0))):
                    some = np.flatnonzero(start + step < end)
                    other = columns.order[start[some] + step]
                    for c, (ends_, _, low) in held.items():
                        found[c][some] = low(found[c][some], ends_[other])
            place = np.searchsorted(wanted, cell[own])
            out = [table.column(c).take(pa.array(own)) for c in pixels_columns]
            out += [pa.array(found[c][place], mask=found[c][place] == held[c][1]) for c in ends]
            yield from pa.Table.from_arrays(out, names=schema.names).combine_chunks().to_batches(1 << 16)

    pixels_columns = pixels.columns
    return rows.mapInArrow(run, schema)
