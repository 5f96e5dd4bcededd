"""Rows checked on the way in: strict JSON, poses from quaternions, sequences aligned to a registry, decimated beams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strict_json(text: Column, schema: str) -> Column:
    """The parsed text; null where it is no JSON object of the schema, repeats a key in any object, or holds NaN or infinities.

    A variant holds no key twice, so the parser of variants refuses such texts at every depth. It ignores what follows a
    value, so the text is followed by its own hash in an array, which must be the array's second value.
    """
    hashed = F.md5(text)
    array = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), hashed, F.lit('"]')))
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"})
    return F.when((F.try_variant_get(array, "$[1]", "string") == hashed) & F.json_object_keys(text).isNotNull(), parsed)


def same_values(a: Column, b: Column) -> Column:
    """Do two flat JSON objects hold the same keys with equal numbers, whatever the order and spelling."""
    entries = lambda t: F.array_sort(F.map_entries(F.from_json(t, "map<string,double>")))
    return F.coalesce(entries(a) == entries(b), F.lit(False))


def transform_of(q: dict[str, Column], tolerance: float = 1e-3) -> dict[str, Column]:
    """valid and r11 .. r33 of a quaternion w, x, y, z: null unless it is finite and of length 1 within the tolerance."""
    length = F.sqrt(q["w"] * q["w"] + q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"])
    valid = F.coalesce(F.abs(length - 1) <= tolerance, F.lit(False))
    w, x, y, z = (F.when(valid, q[c] / length) for c in "wxyz")
    rows = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    return {"valid": valid} | {f"r{i + 1}{j + 1}": rows[i][j] for i in range(3) for j in range(3)}


def aligned(raw: DataFrame, registry: DataFrame) -> DataFrame:
    """raw(drive, index, ...) plus sequence and frame, by registry(drive, sequence, first, last): frame 0 is index first.

    Rows of other drives, or outside the range, go. A drive may hold several sequences; their ranges do not overlap.
    """
    return raw.join(registry, "drive").where("index BETWEEN first AND last").withColumn("frame", F.col("index") - F.col("first")).drop("first", "last")


def decimated(points: DataFrame, elevation: Column, bins: int, step: int) -> DataFrame:
    """Points of every step-th elevation bin; elevation is 0 .. 1, the ends closed."""
    return points.where(F.pmod(F.least(F.greatest(F.floor(elevation * bins), F.lit(0)), F.lit(bins - 1)), F.lit(step)) == 0)


def ravel_keys(points: DataFrame, size: int, by: list[str]) -> DataFrame:
    """points(by, x, y, z) plus key: the cell's place in the box that a group's cells span, in mixed radix.

    Unlike a fixed-width key it is dense, and comparable within its group only.
    """
    cells = points.withColumns({f"_{a}": F.floor(F.col(a) / F.lit(size)).cast("long") for a in "xyz"})
    box = cells.groupBy(*by).agg(*(F.min(f"_{a}").alias(f"_lo{a}") for a in "xyz"), *((F.max(f"_{a}") - F.min(f"_{a}") + 1).alias(f"_n{a}") for a in "yz"))
    at = {a: F.col(f"_{a}") - F.col(f"_lo{a}") for a in "xyz"}
    return cells.join(box, by).withColumn("key", (at["x"] * F.col("_ny") + at["y"]) * F.col("_nz") + at["z"]).select(*points.columns, "key")
