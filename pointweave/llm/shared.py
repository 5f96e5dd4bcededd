"""What the operators of this folder have in common: the word contract, table reads, stable hashes, stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.operators.tables import release, shared_folder
from pointweave.operators.tables import stored as materialise

__all__ = ["GAP", "WORD", "materialise", "read", "release", "shared_folder", "stable_hash"]

#: The word separators of every text contract: space and \\t \\n \\v \\f \\r.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stable_hash(column, bits: int = 48):
    """Non-negative hash of a value's string, the same in Spark and in any SQL engine with md5."""
    digits = bits // 4
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit(""))), 1, digits), 16, 10).cast("long")
