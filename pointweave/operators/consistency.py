"""One-frame causal consistency: weak static points borrow a share of a confident match in the previous frame."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.functions.arrays import argmax, blend
from pointweave.operators.joins import moved
from pointweave.operators.tiles import nearest_within


@dataclass(frozen=True)
class ConsistencyRules:
    radius: float = 0.25
    radial: float = math.inf
    most_age: float = 1.5
    history_least: float = 0.8
    advantage: float = 0.1
    veto: float = 0.8
    weight: float = 0.35
    decay: float = 2.0
    excluded: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 8, 9)

    def __post_init__(self) -> None:
        if min(self.radius, self.radial, self.most_age, self.decay) <= 0 or not all(0 <= v <= 1 for v in (self.history_least, self.advantage, self.veto, self.weight)):
            raise ValueError("rules out of range")


def consistent(points: DataFrame, rules: ConsistencyRules = ConsistencyRules(), relative: DataFrame | None = None) -> DataFrame:
    """points(stream, frame, stamp, pt, x, y, z, p) plus label, raw, and weight of the previous frame.

    Points are in their own sensor's coordinates; relative(stream, frame, r11 .. r33, tx, ty, tz) moves the points of
    the frame before into those of a frame (None: the sensor stands still). A match may be apart by ``radial`` at most
    along either sensor's ray. Matches are reciprocal nearest neighbours between a frame and the one before, over all points, so that a mover
    cannot expose what lies behind it. Only then do the gates apply: static classes, confident history with an
    advantage, no confident present. Every frame is matched against raw posteriors, never against enhanced ones, so
    frames are independent of each other: the whole sequence is one plan, with one shuffle of the points, tile by tile.
    """
    cell = lambda c: F.floor(F.col(c) / rules.radius).cast("long")
    cells = lambda d: d.withColumns({f"c{c}": cell(c) for c in "xyz"})
    base = points.select("stream", "frame", "stamp", F.col("pt").alias("id"), "x", "y", "z", "p", F.array_max("p").alias("top"), argmax(F.col("p")).alias("raw"))
    past = base.withColumn("frame", F.col("frame") + 1)
    past = past.withColumns({c: F.lit(0.0) for c in ("tx", "ty", "tz")}) if relative is None else moved(past, relative, ["stream", "frame"])
    most_age = rules.most_age

    def young(a, i, b, j):
        return a.column("stamp").to_numpy()[i] - b.column("stamp").to_numpy()[j] <= most_age

    near = nearest_within(cells(base), cells(past), rules.radius**2, 1, ("stream", "frame"), young, reciprocal=True, keep=True)
    names = {"id_a": "pt", "raw_a": "raw", "p_a": "p", "top_a": "top", "p_b": "hp", "top_b": "htop", "raw_b": "hraw", **{f"{c}_a": f"{c}i" for c in "xyz"}, **{f"{c}_b": c for c in ("x", "y", "z", "tx", "ty", "tz")}}
    matched = near.withColumnsRenamed(names).withColumn("age", F.col("stamp_a") - F.col("stamp_b"))
    excluded = list(rules.excluded)
    allowed = within_rays(rules.radial) & ~F.col("raw").isin(excluded) & ~F.col("hraw").isin(excluded) & (F.col("htop") >= rules.history_least) & (F.col("htop") >= F.col("top") + rules.advantage) & (F.col("top") < rules.veto)
    weight = F.when(F.coalesce(allowed, F.lit(False)), rules.weight * F.exp(-F.col("age") / rules.decay)).otherwise(F.lit(0.0))
    out = matched.withColumn("weight", weight)
    mixed = F.when(F.col("weight") > 0, blend(F.col("p"), F.col("hp"), F.col("weight"))).otherwise(F.col("p"))
    return out.withColumn("mixed", mixed).select("stream", "frame", "pt", "raw", argmax(F.col("mixed")).alias("label"), "weight")


def within_rays(radial: float) -> Column:
    """Is the way from x, y, z to xi, yi, zi at most ``radial`` long along the rays from the origin and from tx, ty, tz."""
    if math.isinf(radial):
        return F.lit(True)
    good = F.lit(True)
    for ray in ({c: F.col(f"{c}i") for c in "xyz"}, {c: F.col(c) - F.col(f"t{c}") for c in "xyz"}):
        along = sum(((F.col(f"{c}i") - F.col(c)) * ray[c] for c in "yz"), (F.col("xi") - F.col("x")) * ray["x"])
        length = F.sqrt(ray["x"] * ray["x"] + ray["y"] * ray["y"] + ray["z"] * ray["z"])
        good &= (length > 1e-6) & (F.abs(along) <= F.lit(radial) * length)
    return good


def age_factor(rules: ConsistencyRules, age: float) -> float:
    return rules.weight * math.exp(-age / rules.decay)
