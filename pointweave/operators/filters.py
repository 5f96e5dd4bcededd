"""Filters built from specifications: switchable clauses, bit flags, validity gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compiled(spec: dict[str, object], clauses: dict[str, Column]) -> Column:
    """The conjunction of the clauses that a specification switches on; unknown names are an error."""
    if unknown := set(spec) - set(clauses):
        raise ValueError(f"no such clause: {sorted(unknown)}")
    out = F.lit(True)
    for name, on in spec.items():
        if on:
            out = out & F.coalesce(clauses[name], F.lit(False))
    return out


def bit_flags(clauses: list[Column]) -> Column:
    """Clause k as bit k."""
    out = F.lit(0)
    for k, c in enumerate(clauses):
        out = out.bitwiseOR(F.when(c, 1 << k).otherwise(0))
    return out


def complete_frames(points: DataFrame, valid: Column, least: int) -> DataFrame:
    """The valid points of frames that have at least ``least`` of them."""
    good = points.where(valid)
    return good.join(good.groupBy("frame").agg(F.count("*").alias("_n")).where(F.col("_n") >= least), "frame").drop("_n")


def spherical(x: Column, y: Column, z: Column, least: float, most: float) -> Column:
    """Inclusive range gate, with a box test first that needs no root."""
    box = (F.abs(x) <= most) & (F.abs(y) <= most) & (F.abs(z) <= most)
    r2 = x * x + y * y + z * z
    return box & r2.between(least * least, most * most)
