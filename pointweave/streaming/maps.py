"""A map of sums kept up to date by micro-batches: changes by bucket of tiles, merged when read, compacted bucket by bucket."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.operators.tables import delete


class IncrementalMap:
    """A table of sums by keys, as changes under ``base`` in the shared folder.

    A batch writes the sums of its own rows only, in one file for each bucket of tiles that it touches, then a line into
    the log, which makes it count; a batch that is delivered again writes its own files again and nothing twice. A
    revision is the sums of the new rows less those of the old ones. Reading adds up a bucket's last compaction and the
    changes after it. A bucket with ``most`` changes is compacted by itself; others stay as they are. So what a batch
    writes follows what it touches, not the size of the map.
    """

    def __init__(self, spark: SparkSession, base: str, keys: list[str], sums: list[str], tile: str, buckets: int = 64, most: int = 8):
        self.spark, self.base, self.keys, self.sums, self.tile, self.buckets, self.most = spark, base, keys, sums, tile, buckets, most

    def _log(self, kind: str) -> list:
        """Lines (bucket, number, tiles) of one kind: changes, or compactions; one a bucket and batch since the last compaction."""
        try:
            return self.spark.read.parquet(f"{self.base}/log-{kind}").orderBy("number", "bucket").collect()
        except AnalysisException:
            return []  # nothing has been written yet

    def _state(self) -> tuple[dict[int, int], list[tuple[int, int]], int]:
        """The last compaction of each bucket, the (bucket, number) of changes after it, and the last number."""
        compacted: dict[int, int] = {}
        for r in self._log("compact"):
            compacted[r["bucket"]] = r["number"]
        log = self._log("changes")
        changes = [(r["bucket"], r["number"]) for r in log if r["number"] > compacted.get(r["bucket"], -1)]
        return compacted, changes, max((r["number"] for r in log), default=-1)

    def _write_log(self, kind: str, number: int, lines: list[tuple]) -> None:
        self.spark.createDataFrame(lines, "bucket int, number long, tiles long").coalesce(1).write.mode("overwrite").parquet(f"{self.base}/log-{kind}/at={number}")

    def add(self, rows: DataFrame, number: int) -> None:
        """Adds rows (keys, sums, tile); a number that has been added is replaced."""
        bucket = F.pmod(F.xxhash64(self.tile), F.lit(self.buckets)).cast("int")
        change = rows.groupBy(*self.keys, self.tile).agg(*(F.sum(c).alias(c) for c in self.sums)).where(" OR ".join(f"{c} <> 0" for c in self.sums))
        at = f"{self.base}/changes/{number}"
        change.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        try:
            touched = self.spark.read.parquet(at).groupBy("bucket").agg(F.countDistinct(self.tile).alias("tiles")).collect()  # a row a bucket at most
        except AnalysisException:
            touched = []  # a batch without rows
        self._write_log("changes", number, [(r["bucket"], number, r["tiles"]) for r in touched] or [(-1, number, 0)])

    def revise(self, old: DataFrame, new: DataFrame, number: int) -> None:
        """Takes the rows of ``old`` out, as they were added, and puts those of ``new`` in."""
        self.add(old.withColumns({c: -F.col(c) for c in self.sums}).unionByName(new), number)

    def snapshot(self) -> DataFrame:
        """keys, sums and tile of the map; groups whose sums are all zero are gone."""
        compacted, changes, _ = self._state()
        return self._merged([*((f"compact/{n}", b) for b, n in compacted.items()), *((f"changes/{n}", b) for b, n in changes if b >= 0)])

    def _merged(self, parts: list[tuple[str, int]]) -> DataFrame:
        if not parts:
            raise ValueError("the map has no rows yet")
        rows = self.spark.read.parquet(*(f"{self.base}/{at}/bucket={b}" for at, b in parts))
        return rows.groupBy(*self.keys, self.tile).agg(*(F.sum(c).alias(c) for c in self.sums)).where(" OR ".join(f"{c} <> 0" for c in self.sums))

    def compact(self) -> int:
        """Rewrites the buckets that have ``most`` changes or more, deletes what that replaces, and tells how many they were."""
        compacted, changes, number = self._state()
        full = {b for b, _ in changes if b >= 0 and sum(c == b for c, _ in changes) >= self.most}
        if not full:
            return 0
        parts = [*((f"compact/{n}", b) for b, n in compacted.items() if b in full), *((f"changes/{n}", b) for b, n in changes if b in full)]
        bucket = F.pmod(F.xxhash64(self.tile), F.lit(self.buckets)).cast("int")
        self._merged(parts).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.base}/compact/{number}")
        kept = {r["bucket"] for r in self.spark.read.parquet(f"{self.base}/compact/{number}").select("bucket").distinct().collect()}
        if full - kept:  # all that a bucket held is gone: an empty file stands for it
            for b in full - kept:
                self.spark.read.parquet(f"{self.base}/{parts[0][0]}/bucket={parts[0][1]}").limit(0).write.mode("overwrite").parquet(f"{self.base}/compact/{number}/bucket={b}")
        self._write_log("compact", number, [(b, number, 0) for b in sorted(full)])
        for at, b in parts:
            delete(self.spark, f"{self.base}/{at}/bucket={b}")
        return len(full)

    def versions(self) -> DataFrame:
        """bucket, changed, superseded, tiles: batches that changed a bucket, how many of these later ones replaced, tiles written in all."""
        lines = self.spark.read.parquet(f"{self.base}/log-changes").where("bucket >= 0")
        return lines.groupBy("bucket").agg(F.count("*").alias("changed"), (F.count("*") - 1).alias("superseded"), F.sum("tiles").alias("tiles"))


def follow(rows: DataFrame, kept: IncrementalMap) -> DataFrame:
    """Runs a stream of rows (keys, sums, tile) over all that is there into a map, and reads it. A later run goes on where it ended."""

    def step(batch: DataFrame, number: int) -> None:
        kept.add(batch, number)
        kept.compact()

    query = rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{kept.base}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return kept.snapshot()
