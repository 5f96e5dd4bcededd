"""Small dense numerics on aggregated rows: covariances, plane thickness, principal extents, rigid alignment, pose graphs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.operators.positions import in_order


def cell_covariances(points: DataFrame, size: int) -> DataFrame:
    """gx, gy, n and the six entries of the covariance of each column cell, from ten integer sums."""
    from pointweave.functions.geometry import cell

    axes = "xyz"
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    sums = [F.sum(f"{a}_mm").alias(f"s{a}") for a in axes] + [F.sum(F.col(f"{a}_mm") * F.col(f"{b}_mm")).alias(f"{a}{b}") for a, b in pairs]
    m = points.groupBy(cell("x_mm", size).alias("gx"), cell("y_mm", size).alias("gy")).agg(F.count("*").alias("n"), *sums)
    cov = {f"c{a}{b}": (F.col("n") * F.col(f"{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}")).cast("double") / (F.col("n") * F.col("n")) for a, b in pairs}
    return m.select("gx", "gy", "n", *(c.alias(k) for k, c in cov.items()))


def eigenvalues(c: dict[str, Column]) -> list[Column]:
    """Eigenvalues, largest first, of a symmetric 3 x 3 matrix given as cxx, cxy, cxz, cyy, cyz, czz: the trigonometric closed form."""
    xx, xy, xz, yy, yz, zz = (c[k] for k in ("cxx", "cxy", "cxz", "cyy", "cyz", "czz"))
    q = (xx + yy + zz) / 3
    p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)
    p = F.sqrt(p2 / 6)
    a, b, d = (xx - q) / p, (yy - q) / p, (zz - q) / p
    e, f, g = xy / p, xz / p, yz / p
    half_det = (a * (b * d - g * g) - e * (e * d - g * f) + f * (e * g - b * f)) / 2
    angle = F.acos(F.least(F.greatest(half_det, F.lit(-1.0)), F.lit(1.0))) / 3
    big = F.when(p > 0, q + 2 * p * F.cos(angle)).otherwise(q)
    small = F.when(p > 0, q + 2 * p * F.cos(angle + 2 * math.pi / 3)).otherwise(q)
    return [big, 3 * q - big - small, small]


def interpolated(rows: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """by, n, name: the continuous percentile of each group, to the last bit as DuckDB computes it.

    Both weigh the two neighbours of a place, but DuckDB fuses one product with the sum. Spark's percentile rounds twice,
    which moves band limits that a value sits on. Equal values are counted first; places come from a window that sorts a
    group's distinct values, no task holds them. Null values are not counted, NaN is the greatest.
    """

    @F.pandas_udf("double")
    def fused(low: pd.Series, high: pd.Series, part: pd.Series) -> pd.Series:
        return pd.Series([math.fma(a, 1 - t, b * t) for a, b, t in zip(low, high, part, strict=True)], dtype=float)

    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*by)
    counts = counts.withColumns({"_upto": F.sum("_c").over(w.orderBy(value)), "_n": F.sum("_c").over(w)})
    at = (F.col("_n") - 1) * F.lit(q)
    ends = {"_low": F.floor(at), "_high": F.ceil(at)}
    firsts = [F.min(F.when(F.col("_upto") > e, F.col(value))).alias(k) for k, e in ends.items()]
    out = counts.groupBy(*by).agg(F.first("_n").alias("n"), *firsts)
    at = (F.col("n") - 1) * F.lit(q)
    low, high = (F.col(c).cast("double") for c in ("_low", "_high"))
    # At a half all products are exact.
    value = low * 0.5 + high * 0.5 if q == 0.5 else fused(low, high, at - F.floor(at))
    return out.select(*by, "n", F.when(F.col("_low") == F.col("_high"), low).when(at == F.floor(at), low).otherwise(value).alias(name))


def ground_thickness(points: DataFrame, size: int, least: int, below: int, above: int) -> DataFrame:
    """gx, gy, n, thickness: 1.4826 median deviations of the points in a band about the low percentile of each column.

    Percentiles interpolate as the SQL does, so a height on a limit of the band is judged alike.
    """
    from pointweave.functions.geometry import cell

    by = ["gx", "gy"]
    p = points.select(cell("x_mm", size).alias("gx"), cell("y_mm", size).alias("gy"), "z_mm")
    low = interpolated(p, by, "z_mm", 0.05, "low").where(F.col("n") >= least).drop("n")
    band = p.join(low, by).where(F.col("z_mm").between(F.col("low") - below, F.col("low") + above)).select(*by, "z_mm")
    mid = interpolated(band, by, "z_mm", 0.5, "mid").drop("n")
    off = band.join(mid, by).select(*by, F.abs(F.col("z_mm") - F.col("mid")).alias("off"))
    return interpolated(off, by, "off", 0.5, "mad").select(*by, "n", (1.4826 * F.col("mad")).alias("thickness"))


def alignment(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and translation that best map pairs' (ax, ay, az) onto (bx, by, bz): one row of sums, then a 3 x 3 SVD."""
    sums = [F.count("*").alias("n")] + [F.sum(f"{s}{a}").alias(f"{s}{a}") for s in "ab" for a in "xyz"]
    sums += [F.sum(F.col(f"a{i}") * F.col(f"b{j}")).alias(f"{i}{j}") for i in "xyz" for j in "xyz"]
    r = pairs.agg(*sums).first()
    if not r["n"]:
        raise ValueError("no pairs to align")
    ma, mb = (np.array([r[f"{s}{a}"] for a in "xyz"]) / r["n"] for s in "ab")
    h = np.array([[r[f"{i}{j}"] for j in "xyz"] for i in "xyz"]) / r["n"] - np.outer(ma, mb)
    u, _, vt = np.linalg.svd(h)
    d = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))])
    rotation = vt.T @ d @ u.T
    return rotation, mb - rotation @ ma


def trajectory_error(pairs: DataFrame) -> DataFrame:
    """One row: n, ate (root mean square distance after alignment), path (length of a in the order of t)."""
    rotation, shift = alignment(pairs)
    moved = [sum((float(rotation[k, j]) * F.col(f"a{a}") for j, a in enumerate("yz", 1)), float(rotation[k, 0]) * F.col("ax")) + float(shift[k]) for k in range(3)]
    d2 = sum(((m - F.col(f"b{a}")) * (m - F.col(f"b{a}")) for m, a in zip(moved[1:], "yz", strict=True)), (moved[0] - F.col("bx")) * (moved[0] - F.col("bx")))
    w = W.partitionBy("track").orderBy("t")
    step2 = sum(((F.col(f"a{a}") - F.lag(f"a{a}").over(w)) * (F.col(f"a{a}") - F.lag(f"a{a}").over(w)) for a in "yz"), (F.col("ax") - F.lag("ax").over(w)) * (F.col("ax") - F.lag("ax").over(w)))
    return pairs.select(d2.alias("d2"), F.sqrt(step2).alias("step")).agg(F.count("*").alias("n"), F.sqrt(F.avg("d2")).alias("ate"), F.sum("step").alias("path"))


def principal_extents(points: DataFrame, by: list[str]) -> DataFrame:
    """by, n, extent: length of each group along its principal axis.

    The axis comes from ten sums per group; the extent is a second aggregate over projections, so groups of any size
    stay spread over tasks.
    """
    axes = "xyz"
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    sums = [F.sum(F.col(f"{a}_mm").cast("double")).alias(f"s{a}") for a in axes] + [F.sum(F.col(f"{a}_mm") * F.col(f"{b}_mm").cast("double")).alias(f"{a}{b}") for a, b in pairs]
    moments = points.groupBy(*by).agg(F.count("*").alias("n"), *sums)

    @F.pandas_udf("array<double>")
    def axis(m: pd.DataFrame) -> pd.Series:
        out = []
        for r in m.to_numpy(float):
            n, s = r[0], r[1:4]
            c = np.zeros((3, 3))
            c[np.triu_indices(3)] = r[4:] / n
            c = c + np.triu(c, 1).T - np.outer(s, s) / (n * n)
            out.append(np.linalg.eigh(c)[1][:, 2].tolist())
        return pd.Series(out)

    columns = ["n", *(f"s{a}" for a in axes), *(a + b for a, b in pairs)]
    moments = moments.withColumn("axis", axis(F.struct(*columns))).select(*by, "n", "axis")
    along = sum((F.col("axis")[k] * F.col(f"{a}_mm") for k, a in enumerate("yz", 1)), F.col("axis")[0] * F.col("x_mm"))
    return points.join(moments, by).groupBy(*by).agg(F.first("n").alias("n"), (F.max(along) - F.min(along)).alias("extent"))


def pose_graph(n: int, edges: list[tuple[int, int, np.ndarray, float]], start: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Planar poses (x, y, angle) that fit relative measurements (i, j, z, weight), by damped Gauss-Newton; pose 0 stays.

    A solver of one small system (thousands of poses at most), for use within a task or on the driver.
    """

    at, to = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    z = np.array([e[2] for e in edges], float).reshape(-1, 3)
    root = np.sqrt(np.array([e[3] for e in edges], float))[:, None]

    def error(p: np.ndarray) -> tuple[np.ndarray, ...]:
        c, s, d = np.cos(p[at, 2]), np.sin(p[at, 2]), p[to] - p[at]
        turn = (d[:, 2] - z[:, 2] + math.pi) % (2 * math.pi) - math.pi
        return root * np.stack([c * d[:, 0] + s * d[:, 1] - z[:, 0], -s * d[:, 0] + c * d[:, 1] - z[:, 1], turn], 1), c, s, d

    p, damping = start.astype(float).copy(), 1e-6
    # Places of the blocks (at, at), (at, to), (to, at), (to, to) of every edge in the normal equations.
    ends = np.stack([at, to])
    rows = (3 * ends[:, None, :, None, None] + np.arange(3)[None, None, None, :, None]).repeat(2, 1).repeat(3, 4)
    cols = (3 * ends[None, :, :, None, None] + np.arange(3)[None, None, None, None, :]).repeat(2, 0).repeat(3, 3)
    place = (rows * (3 * n) + cols).ravel()
    r, c, s, d = error(p)
    for _ in range(rounds):
        block = np.zeros((2, len(at), 3, 3))
        block[0, :, 0, 0], block[0, :, 0, 1], block[0, :, 0, 2] = -c, -s, c * d[:, 1] - s * d[:, 0]
        block[0, :, 1, 0], block[0, :, 1, 1], block[0, :, 1, 2] = s, -c, -c * d[:, 0] - s * d[:, 1]
        block[1, :, 0, 0], block[1, :, 0, 1], block[1, :, 1, 0], block[1, :, 1, 1] = c, s, -s, c
        block[0, :, 2, 2], block[1, :, 2, 2] = -1, 1
        block *= root[None, :, :, None]
        turned = block.transpose(0, 1, 3, 2)
        h = np.bincount(place, (turned[:, None] @ block[None]).ravel(), 9 * n * n).reshape(3 * n, 3 * n)[3:, 3:]
        g = np.zeros((n, 3))
        for k in (0, 1):
            np.add.at(g, ends[k], (turned[k] @ r[:, :, None])[:, :, 0])
        step = np.linalg.solve(h + damping * np.eye(len(h)), -g[1:].ravel())
        trial = p.copy()
        trial[1:] += step.reshape(-1, 3)
        tried = error(trial)
        if (tried[0] ** 2).sum() <= (r**2).sum():
            p, damping, (r, c, s, d) = trial, damping / 4, tried
            if np.abs(step).max() < 1e-10:
                break
        else:
            damping *= 16
    return p


def _compose(p: np.ndarray, z: np.ndarray) -> np.ndarray:
    c, s = math.cos(p[2]), math.sin(p[2])
    return np.array([p[0] + c * z[0] - s * z[1], p[1] + s * z[0] + c * z[1], p[2] + z[2]])


def _inverse(p: np.ndarray) -> np.ndarray:
    c, s = math.cos(p[2]), math.sin(p[2])
    return np.array([-c * p[0] - s * p[1], s * p[0] - c * p[1], -p[2]])


def chained(steps: np.ndarray) -> np.ndarray:
    """Poses from odometry steps (x, y, angle), the first at the origin."""
    out = [np.zeros(3)]
    for z in steps:
        out.append(_compose(out[-1], z))
    return np.array(out)


def graph_corrections(edges: DataFrame, by: list[str], most: int = 1000, rounds: int = 15) -> DataFrame:
    """by, version, node, x, y, angle, dx, dy, da: each log's planar pose graph, solved anew whenever a loop closes.

    edges(by, i, j, x, y, angle, weight) are odometry where j = i + 1, else loops, i < j. Version 0 is before the first
    loop: raw odometry, no correction. Version k holds loops 1 .. k in the order of their later node and all odometry up
    to it; it tells that node's pose and the correction that takes its raw pose there. Odometry edges are always the raw
    ones, so a wrong loop never bends them. Logs are solved side by side; one of more than ``most`` poses is an error.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        odometry = pdf[pdf["j"] == pdf["i"] + 1].sort_values("i")
        loops = pdf[pdf["j"] != pdf["i"] + 1].sort_values(["j", "i"])
        if len(odometry) + 1 > most:
            raise ValueError(f"a log of {len(odometry) + 1} poses; split logs beyond {most}")
        if odometry["i"].tolist() != list(range(len(odometry))):
            raise ValueError("odometry must lead from each pose to the next")
        z = odometry[["x", "y", "angle"]].to_numpy(float)
        raw, w = chained(z), odometry["weight"].to_numpy(float)
        out, used, last = [(0, 0, *raw[0], 0.0, 0.0, 0.0)], [], None
        for version, r in enumerate(loops.itertuples(index=False), 1):
            used.append((int(r.i), int(r.j), np.array([r.x, r.y, r.angle]), float(r.weight)))
            n = int(r.j) + 1
            chain = [(k, k + 1, z[k], w[k]) for k in range(n - 1)]
            # The last solution is where the next one starts; newer poses follow it by odometry.
            start = raw[:n] if last is None else np.array([*last[:n], *(_compose(last[-1], _compose(_inverse(raw[len(last) - 1]), raw[k])) for k in range(len(last), n))])
            last = pose_graph(n, chain + used, start, rounds)
            change = _compose(last[-1], _inverse(raw[n - 1]))
            out.append((version, n - 1, *last[-1], *change))
        found = pd.DataFrame(out, columns=["version", "node", "x", "y", "angle", "dx", "dy", "da"])
        return pd.concat([pd.DataFrame({c: [pdf[c].iloc[0]] * len(found) for c in by}), found], axis=1)

    key = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.schema.fields if f.name in by)
    return edges.groupBy(*by).applyInPandas(solve, f"{key}, version int, node int, x double, y double, angle double, dx double, dy double, da double")


def resampled_rates(groups: DataFrame, by: list[str], hit: str, n: str, draws: int) -> DataFrame:
    """draw, rate: sum(hit) / sum(n) over as many groups as there are, drawn with replacement; hashes draw, so reruns agree."""
    placed = in_order(groups, by, "k")
    count = placed.count()
    drawn = placed.select(F.col("k").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    drawn = drawn.select("draw", F.pmod(F.xxhash64("draw", "i"), F.lit(max(1, count))).alias("k"))
    return drawn.join(placed.select("k", hit, n), "k").groupBy("draw").agg((F.sum(hit) / F.sum(n)).alias("rate"))
