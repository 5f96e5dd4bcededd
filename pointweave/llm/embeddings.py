"""Embedding near-duplicates by collision-counting projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointweave.llm.graph import connected_components
from pointweave.llm.shared import materialise

#: Projections in which a vector is entered: those where it is most extreme.
ENTRIES = 12
#: Entries of a projection's list that one task compares with as many others, and those it compares at a time.
BLOCK, TILE = 8192, 512
#: Half width of a query's window, in standard deviations of a linked pair's difference at the least cosine.
WINDOW = 3.0


def projections_for(vectors: int) -> int:
    """Projections for so many vectors: about 32 for each of their square root, a power of two.

    Work is vectors x projections to project, and vectors**2 / projections to compare, so both grow as the power 1.5.
    """
    return 1 << max(6, int(np.ceil(np.log2(32 * np.sqrt(max(vectors, 1))))))


def directions(dims: int, n: int) -> np.ndarray:
    """n / 2 fixed random directions; with their opposites they give n one-dimensional projections."""
    return np.random.default_rng([dims, n]).standard_normal((dims, n // 2)).astype(np.float32)


def extremes(unit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ENTRIES projections in which each unit vector is largest, ascending, and its values there."""
    half = unit.astype(np.float32) @ directions(unit.shape[1], n)
    size = half.shape[1]
    best = min(ENTRIES, size)
    at = np.argpartition(-np.abs(half), best - 1, axis=1)[:, :best]
    value = np.take_along_axis(half, at, 1)
    place = np.where(value < 0, at + size, at).astype(np.int32)
    order = np.argsort(place, axis=1)
    return np.take_along_axis(place, order, 1), np.abs(np.take_along_axis(value, order, 1))


def window(least: float) -> float:
    return WINDOW * float(np.sqrt(2 - 2 * least))


def calibrated_count(dims: int, n: int, least: float, recall: float = 0.998, pairs: int = 2000) -> int:
    """The largest collision count that pairs of exactly the least cosine reach with the given recall, by simulation.

    Pairs of higher cosine collide more often. At least 1: a pair that never collides is not found.
    """
    rng = np.random.default_rng(11)
    x = rng.standard_normal((pairs, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = rng.standard_normal((pairs, dims))
    e -= (e * x).sum(1, keepdims=True) * x
    e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)
    counts = []
    for lo in range(0, pairs, 250):
        (pa, va), (pb, vb) = (extremes(v[lo : lo + 250], n) for v in (x, least * x + np.sqrt(1 - least**2) * e))
        hit = (pa[:, :, None] == pb[:, None, :]) & (np.abs(va[:, :, None] - vb[:, None, :]) <= window(least))
        counts.append(hit.sum((1, 2)))
    counts = np.sort(np.concatenate(counts))
    return max(1, int(counts[int((1 - recall) * pairs)]))


def _collisions(place: np.ndarray, value: np.ndarray, width: float, before: int | None = None) -> np.ndarray:
    """How often each two rows collide, as a square matrix: in how many common lists they are in each other's window.

    With ``before``, only lists below it count. Where all of a list's values lie within one window, two rows collide if
    both are in it, so such lists are counted by one product of incidence matrices; the others by sorted windows.
    """
    n = len(place)
    rows, lists, values = np.repeat(np.arange(n), place.shape[1]), place.ravel(), value.ravel()
    if before is not None:
        low = lists < before
        rows, lists, values = rows[low], lists[low], values[low]
    out = np.zeros((n, n), np.float32)
    if not len(rows):
        return out
    order = np.lexsort((values, lists))
    rows, lists, values = rows[order], lists[order], values[order]
    begins = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
    ends = np.r_[begins[1:], len(lists)]
    narrow = values[ends - 1] - values[begins] <= width
    several = ends - begins > 1
    number = np.repeat(np.cumsum(narrow & several) - 1, ends - begins)
    own = np.repeat(narrow & several, ends - begins)
    if own.any():
        inside = np.zeros((n, int(number[-1]) + 1), np.float32)
        inside[rows[own], number[own]] = 1
        out += inside @ inside.T
    for lo, hi in zip(begins[~narrow & several], ends[~narrow & several], strict=True):
        r, v = rows[lo:hi], values[lo:hi]
        out[np.ix_(r, r)] += np.abs(v[:, None] - v[None, :]) <= width
    return out


def _groups(linked: np.ndarray) -> np.ndarray:
    """The first row of each row's component in a square matrix of links."""
    top = np.full(len(linked), -1)
    for start in np.flatnonzero(linked.any(1)):
        if top[start] >= 0:
            continue
        front = np.zeros(len(linked), bool)
        front[start] = True
        while front.any():
            top[front] = start
            front = linked[front].any(0) & (top < 0)
    return top


def _links(least: float, least_count: int, kind: str):
    width = window(least)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        here = int(key[1])
        unit = unit_rows(np.stack([np.frombuffer(v, kind) for v in rows["vector"]]))
        place = np.stack([np.frombuffer(v, np.int32) for v in rows["places"]])
        value = np.stack([np.frombuffer(v, np.float32) for v in rows["values"]])
        ids, size, side = rows["rep"].to_numpy(), rows["size"].to_numpy(), rows["side"].to_numpy()
        degree, top = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def root(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        tiles = [t for s in (False, True) for of in [np.flatnonzero(side == s)] for t in np.split(of, range(TILE, len(of), TILE)) if len(t)]
        split = side.any() and not side.all()
        for i, left in enumerate(tiles):
            for right in tiles[i:]:
                if split and side[left[0]] == side[right[0]]:
                    continue
                at = left if right is left else np.concatenate([left, right])
                # A pair belongs to its first common list.
                fresh = _collisions(place[at], value[at], width, here) == 0
                if right is not left:
                    fresh[: len(left), : len(left)] = fresh[len(left) :, len(left) :] = False
                fresh[np.arange(len(at)), np.arange(len(at))] = False
                own = value[at][np.arange(len(at)), (place[at] == here).argmax(1)]
                fresh &= np.abs(own[:, None] - own[None, :]) <= width
                if fresh.any():
                    fresh &= _collisions(place[at], value[at], width) >= least_count
                if not fresh.any():
                    continue
                linked = np.triu(fresh & (unit[at] @ unit[at].T >= least))
                linked |= linked.T
                degree[at] += linked @ size[at]
                # Of the links only a spanning forest goes on: enough for components, and linear in the rows.
                first = _groups(linked)
                for x in np.flatnonzero(first >= 0):
                    a, b = root(at[x]), root(at[first[x]])
                    top[max(a, b)] = min(a, b)
        some = np.flatnonzero(degree)
        tops = np.array([root(x) for x in some], int)
        return pd.DataFrame({"a": ids[some], "b": ids[tops], "links": degree[some]})

    return run


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision; scaled first, so that no square overflows or vanishes."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def similar_vectors(table: DataFrame, least: float = 0.9, projections: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of table(vec_id, embedding), linked at cosine ``least`` or more.

    1. Equal vectors form a class; one of each, the class's smallest vec_id, goes on.
    2. A class is entered, by its value, in the sorted lists of the 12 of all projections in which it is most extreme;
       there lists are sparse, so that windows around a query hold few others. The number of projections grows with
       the square root of the classes, at every size.
    3. Within a list, pairs within each other's window are counted over all their common lists. Those that reach the
       count c calibrated for a recall of 0.998 at the least cosine are verified in double precision. A pair is
       handled in its first common list only, which is one of the first 13 - c of each, so an entry of the others is
       not sent. Lists over 8,192 entries are dealt to many tasks as pairs of blocks; a task works tile by tile.
    4. Verified links give each task's degrees and a spanning forest; degrees are summed, forests joined to
       components. No list of all links exists anywhere.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
    lengths never link. Repeated rows are vectors of their own, linked with each other. A vec_id with several vectors
    is one node of the components. A null vec_id gets the smallest vec_id of its component, null if it has none, and
    is kept only then. Other columns are ignored.
    """
    raw = F.col("embedding").cast("array<double>")
    valid = F.coalesce(F.size(raw) > 0, F.lit(False)) & F.coalesce(F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    valid = valid & F.coalesce(F.exists(raw, lambda x: x != 0), F.lit(False))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(valid, raw).alias("v"))
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.reverse("v"), F.size("v"))})
    good = rows.where("v IS NOT NULL")
    classes = materialise(good.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.max("v").alias("v")), "classes")
    members = materialise(rows.drop("v").join(classes.drop("v"), ["h1", "h2"], "left").select("vec_id", "rep", "size"), "members")

    shapes = classes.groupBy(F.size("v").alias("dims")).count().collect()  # one row per vector length
    kind = "f4" if table.schema["embedding"].dataType.elementType == T.FloatType() else "f8"
    parts = None
    for dims, count in shapes:
        n = projections or projections_for(count)
        least_count = calibrated_count(dims, n, least)
        sent = ENTRIES - least_count + 1

        def entered(batches, n=n, sent=sent):
            for pdf in batches:
                for lo in range(0, len(pdf), 512):
                    own = pdf.iloc[lo : lo + 512]
                    v = np.stack(own["v"].to_numpy())
                    place, value = extremes(unit_rows(v), n)
                    yield pd.DataFrame({
                        "rep": own["rep"].to_numpy(), "size": own["size"].to_numpy(), "vector": [x.tobytes() for x in v.astype(kind)],
                        "places": [x.tobytes() for x in place], "values": [x.tobytes() for x in value], "lists": list(place[:, :sent]),
                    })

        of_length = classes.where((F.size("v") == dims) & F.col("rep").isNotNull()).select("rep", "size", "v")
        vectors = materialise(of_length.mapInPandas(entered, "rep long, size long, vector binary, places binary, values binary, lists array<int>"), "vectors")
        entries = vectors.withColumn("list", F.explode("lists")).drop("lists")
        # Lists of one entry have no pairs; of the others only long ones need blocks. Both tables have a row per list.
        lists = vectors.select(F.explode("lists").alias("list")).groupBy("list").count().where("count > 1")
        entries = entries.join(lists.select("list", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "list")
        entries = entries.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = entries.select(F.least("own", "other").alias("x"), "list", F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).alias("side"), "rep", "size", "vector", "places", "values")
        found = dealt.groupBy("x", "list", "y").applyInPandas(_links(least, least_count, kind), "a long, b long, links long")
        parts = found if parts is None else parts.union(found)
    if parts is None:
        return members.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    parts = materialise(parts, "links")
    degrees = parts.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    forests = connected_components(parts.where("a <> b")).withColumnRenamed("node", "rep")
    out = members.join(degrees, "rep", "left").join(forests, "rep", "left")
    component = F.coalesce("component", "rep", "vec_id")
    n_links = F.coalesce(F.col("links"), F.lit(0)) + F.coalesce(F.col("size") - 1, F.lit(0))
    return out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    )
