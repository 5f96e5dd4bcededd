"""Places in a global order: ranges of rows, counted by range, and the counts before each range added to places within it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.operators.tables import stored


def numbered(rows: DataFrame, name: str = "position", codec: str = "snappy") -> DataFrame:
    """rows plus 0, 1, 2, ... as ``name``, in the order of partitions and of rows within them.

    Rows are written once, with their partition and place in it, so that numbers stay what they are when a task runs
    again; only a count for each partition passes the driver.
    """
    spark = rows.sparkSession
    kept = stored(rows.withColumn("_at", F.monotonically_increasing_id()), "numbered", codec)
    part = F.shiftright("_at", 33)
    counts = kept.groupBy(part.alias("part")).count().orderBy("part").collect()
    before, offsets = 0, []
    for r in counts:
        offsets.append((r["part"], before - (r["part"] << 33)))
        before += r["count"]
    known = spark.createDataFrame(offsets, "_part long, _offset long")
    out = kept.join(F.broadcast(known), part == F.col("_part")).withColumn(name, F.col("_at") + F.col("_offset")).drop("_at", "_part", "_offset")
    out.stored_path = kept.stored_path
    return out


def in_order(rows: DataFrame, order: list[Column | str], name: str = "position", parts: int | None = None) -> DataFrame:
    """rows plus each one's place, from 0, in a global order, which should have no ties: no window lacks a partition.

    Rows are dealt to ranges of the order, sorted within each, and numbered. Nulls come first as in any sort. An empty
    table stays empty.
    """
    dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    return numbered(dealt.sortWithinPartitions(*order), name)


def evenly_placed(rows: DataFrame, order: list[Column | str], most: int) -> DataFrame:
    """At most ``most`` of all rows, at the places i * n / most rounded down; all of them if they are no more."""
    placed = in_order(rows, order, "_i")
    n = placed.count()
    if n <= most:
        return placed.drop("_i")
    # Place p is chosen if the first j with floor(j n / most) not below p hits it.
    j = F.floor((F.col("_i") * most + n - 1) / n).cast("long")
    return placed.where((j < most) & (F.floor(j * n / most) == F.col("_i"))).drop("_i")
