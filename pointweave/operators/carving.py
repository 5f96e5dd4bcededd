"""Free-space carving: range images of sweeps, votes of candidates that a sweep sees through, withholding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SweepImage:
    """A range image in azimuth and elevation: cells, the sine of the lowest row and its span, ranges, cells of dilation."""

    columns: int = 360
    rows: int = 32
    low: float = -0.5
    span: float = 1.0
    least: float = 500.0
    most: float = 20_000.0
    margin: float = 500.0
    dilate: int = 1

    def cell(self, x: Column, y: Column, z: Column) -> dict[str, Column]:
        """range, row, col of a place in sensor coordinates; col wraps around, row may lie outside."""
        r = F.sqrt(x * x + y * y + z * z)
        row = F.floor((z / F.greatest(r, F.lit(1e-3)) - F.lit(self.low)) * F.lit(self.rows / self.span))
        col = F.least(F.floor((F.atan2(y, x) + F.lit(PI)) * F.lit(self.columns / (2 * PI))), F.lit(self.columns - 1))
        return {"range": r, "row": row.cast("int"), "col": col.cast("int")}


PI = 3.141592653589793


def sweep_image(points: DataFrame, image: SweepImage) -> DataFrame:
    """frame, row, col, here, near of raw points(frame, x, y, z) in sensor coordinates.

    here is the least range of the cell itself, null if it is empty; near that of the cell and its dilation.
    """
    cells = points.withColumns(image.cell(F.col("x"), F.col("y"), F.col("z"))).where(F.col("row").between(0, image.rows - 1))
    base = cells.groupBy("frame", "row", "col").agg(F.min("range").alias("here"))
    step = F.explode(F.sequence(F.lit(-image.dilate), F.lit(image.dilate)))
    spread = base.withColumn("i", step).withColumn("j", step).where(F.col("row") + F.col("i") >= 0)
    at = [(F.col("row") + F.col("i")).alias("row"), F.pmod(F.col("col") + F.col("j"), F.lit(image.columns)).alias("col")]
    own = F.when((F.col("i") == 0) & (F.col("j") == 0), F.col("here"))
    return spread.groupBy("frame", *at).agg(F.min(own).alias("here"), F.min("here").alias("near"))


def carve(candidates: DataFrame, origins: DataFrame, images: DataFrame, image: SweepImage, bins: int) -> DataFrame:
    """frame, key, free, seen: what each sweep says of the candidates(key, x, y, z) that it looked at.

    origins(frame, bin, ox, oy, oz, cos, sin) are the sensor's poses in world coordinates in each time bin of a sweep.
    Candidates come only from tiles within a sweep's reach: an equi-join on tile, then a box test, so that work grows
    with what sweeps can reach. A candidate's azimuth from the middle pose gives its bin; that bin's own pose then gives
    range and cell. A cell without a return says nothing; a return nearer than the candidate says nothing either.
    """
    reach = image.most
    tile = lambda c: F.floor(c / F.lit(reach)).cast("long")
    side = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    middle = origins.where(F.col("bin") == bins // 2).drop("bin")
    spread = middle.withColumn("i", side).withColumn("j", side).withColumns({"tx": tile(F.col("ox")) + F.col("i"), "ty": tile(F.col("oy")) + F.col("j")}).drop("i", "j")
    near = candidates.withColumns({"tx": tile(F.col("x")), "ty": tile(F.col("y"))}).join(spread, ["tx", "ty"])
    near = near.where(" AND ".join(f"abs({c} - o{c}) < {reach}" for c in "xyz"))
    turned = lambda p: (
        F.col(f"{p}cos") * (F.col("x") - F.col(f"{p}ox")) + F.col(f"{p}sin") * (F.col("y") - F.col(f"{p}oy")),
        F.col(f"{p}cos") * (F.col("y") - F.col(f"{p}oy")) - F.col(f"{p}sin") * (F.col("x") - F.col(f"{p}ox")),
    )
    x, y = turned("")
    time = F.least(F.floor((F.atan2(y, x) + F.lit(PI)) * F.lit(bins / (2 * PI))), F.lit(bins - 1)).cast("int")
    timed = near.select("key", "x", "y", "z", "frame", time.alias("bin")).join(origins, ["frame", "bin"])
    x, y = turned("")
    placed = timed.select("frame", "key", *(c.alias(n) for n, c in image.cell(x, y, F.col("z") - F.col("oz")).items())).where(F.col("range").between(image.least, image.most))
    looked = placed.join(images.where("here IS NOT NULL"), ["frame", "row", "col"])
    return looked.select("frame", "key", (F.col("near") > F.col("range") + image.margin).alias("free"), (F.abs(F.col("here") - F.col("range")) <= image.margin).alias("seen"))


def carve_votes(looks: DataFrame, reset_on_seen: bool = False) -> DataFrame:
    """key, n_free, n_seen, n_tested of carve(); with reset_on_seen only free votes after the last sighting count."""
    if reset_on_seen:
        seen = F.max(F.when(F.col("seen"), F.col("frame"))).over(W.partitionBy("key"))
        looks = looks.withColumn("free", F.col("free") & (F.coalesce(F.col("frame") > seen, F.lit(True))))
    return looks.groupBy("key").agg(F.count_if("free").alias("n_free"), F.count_if("seen").alias("n_seen"), F.count("*").alias("n_tested"))


def withheld(voxels: DataFrame, votes: DataFrame, k: int) -> DataFrame:
    """The map as published: voxels with k free votes or more are left out of the view, and stay in the map."""
    return voxels.join(votes.select("key", "n_free"), "key", "left").where(F.coalesce("n_free", F.lit(0)) < k).drop("n_free")
