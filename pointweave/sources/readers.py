"""Readers of perception data: binary scans and labels, trajectories, calibrations, logs. Schemas are explicit, errors raise.

Binary files are read as rows of bytes by Spark's binaryFile source, whose splits are files, and decoded in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
    return raw.select(F.regexp_extract("path", r"(\d+)[^/]*$", 1).cast("int").alias("frame"), "content")


def decoded(files: DataFrame, schema: str, dtype: np.dtype, columns: dict[str, str]) -> DataFrame:
    """One row per record of each file, with its place as pt; a file that is no whole number of records is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, content in zip(batch.column("frame").to_pylist(), batch.column("content"), strict=True):
                body = content.as_buffer()
                if body.size % dtype.itemsize:
                    raise ValueError(f"frame {frame}: {body.size} bytes are not whole records of {dtype.itemsize}")
                rec = np.frombuffer(body, dtype)
                for lo in range(0, max(len(rec), 1), 100_000):
                    part = rec[lo : lo + 100_000]
                    if len(part):
                        arrays = [pa.array(np.full(len(part), frame, np.int32)), pa.array(np.arange(lo, lo + len(part), dtype=np.int32))]
                        arrays += [pa.array(np.ascontiguousarray(part[field]).astype(kind)) for field, kind in columns.items()]
                        yield pa.RecordBatch.from_arrays(arrays, names=["frame", "pt", *columns])

    return files.mapInArrow(run, schema)


def scans(spark: SparkSession, path: str, fields: tuple[str, ...] = ("x", "y", "z", "intensity")) -> DataFrame:
    """frame, pt and float32 fields of .bin scans; a fifth field (ring) makes the five-column variant."""
    dtype = np.dtype([(f, "<f4") for f in fields])
    schema = "frame int, pt int, " + ", ".join(f"{f} float" for f in fields)
    return decoded(_files(spark, path, ".bin"), schema, dtype, {f: "float32" for f in fields})


def labels(spark: SparkSession, path: str) -> DataFrame:
    """frame, pt, raw, semantic (low 16 bits), instance (high 16 bits) of .label files."""
    words = decoded(_files(spark, path, ".label"), "frame int, pt int, raw long", np.dtype([("raw", "<u4")]), {"raw": "int64"})
    return words.select("frame", "pt", "raw", F.col("raw").bitwiseAND(F.lit(65535).cast("long")).cast("int").alias("semantic"), F.shiftright("raw", 16).cast("int").alias("instance"))


def labelled_scans(points: DataFrame, words: DataFrame) -> DataFrame:
    """Scans with their labels by frame and place; a frame whose counts differ is an error."""
    both = points.groupBy("frame").agg(F.count("*").alias("n")).join(words.groupBy("frame").agg(F.count("*").alias("m")), "frame", "full_outer")
    checked = both.select("frame", F.when(F.col("n").eqNullSafe(F.col("m")), F.lit(True)).otherwise(F.raise_error(F.lit("scan and label lengths differ")).cast("boolean")).alias("ok"))
    return points.join(words, ["frame", "pt"]).join(checked, "frame").where("ok").drop("ok")


def restored_order(predictions: DataFrame) -> DataFrame:
    """predictions(frame, pt, order, ...) put back to the scan's order: the row at place k belongs to point order[k]."""
    return predictions.withColumn("pt", F.col("order")).drop("order")


def trajectory(spark: SparkSession, path: str, least_t: float | None = None) -> DataFrame:
    """t, px, py, pz, qx, qy, qz, qw of a space-separated trajectory; comments go, quaternions are normalised.

    In the order of t each quaternion is on its predecessor's side. A file is one trajectory, in one sort of its own.
    """
    from pointweave.operators.ordered import carried_sign

    names = ["t", "px", "py", "pz", "qx", "qy", "qz", "qw"]
    raw = spark.read.option("sep", " ").option("comment", "#").option("mode", "FAILFAST").schema(", ".join(f"{n} double" for n in names)).csv(path)
    norm = F.sqrt(sum((F.col(q) * F.col(q) for q in names[5:]), F.col("qx") * F.col("qx")))
    out = raw.select(F.input_file_name().alias("_file"), "t", "px", "py", "pz", *((F.col(q) / norm).alias(q) for q in names[4:]))
    out = out if least_t is None else out.where(F.col("t") >= least_t)
    signed = carried_sign(out, ["_file"], "t", names[4:])
    return signed.select("t", "px", "py", "pz", *((F.col(q) * F.col("sign")).alias(q) for q in names[4:]))


def time_ns(text: Column) -> Column:
    """Nanoseconds since 1970 of 'YYYY-MM-DD HH:MM:SS.fffffffff' in UTC, as a long; the fraction may be shorter."""
    whole = F.unix_seconds(F.to_timestamp(F.substring(text, 1, 19), "yyyy-MM-dd HH:mm:ss"))
    fraction = F.rpad(F.regexp_extract(text, r"\.(\d{1,9})", 1), 9, "0").cast("long")
    return whole * 1_000_000_000 + fraction


def timestamps(spark: SparkSession, path: str) -> DataFrame:
    """line text to stamp_ns of a file of one timestamp a line."""
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(time_ns(F.col("value")).alias("stamp_ns"))


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """key, value (array of doubles) of 'key: v1 v2 ...' lines; lines whose values are not numbers are left out."""
    line = spark.read.text(path).where(F.col("value").contains(":"))
    parts = F.split(F.trim(F.regexp_replace("value", "^[^:]*:", "")), r"\s+")
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    return line.select(F.trim(F.split("value", ":")[0]).alias("key"), numbers.alias("value")).where(~F.exists("value", lambda x: x.isNull()))


def inertial(spark: SparkSession, path: str, columns: int = 30) -> DataFrame:
    """c0... of space-separated rows of a fixed number of values."""
    return spark.read.option("sep", " ").option("mode", "FAILFAST").schema(", ".join(f"c{k} double" for k in range(columns))).csv(path)


def point_clouds(messages: DataFrame) -> DataFrame:
    """stamp_ns, pt, x, y, z of messages(stamp_ns, width, height, point_step, row_step, big_endian, ox, oy, oz, data).

    Field offsets, row padding and byte order are honoured; data shorter than its layout is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                rows, width, step, stride = m["height"], m["width"], m["point_step"], m["row_step"]
                if len(m["data"]) < rows * stride or width * step > stride:
                    raise ValueError("a cloud's data is shorter than its layout")
                grid = np.frombuffer(m["data"], np.uint8)[: rows * stride].reshape(rows, stride)[:, : width * step].reshape(-1, step)
                order = ">f4" if m["big_endian"] else "<f4"
                xyz = [np.ascontiguousarray(grid[:, o : o + 4]).view(order).ravel().astype(np.float32) for o in (m["ox"], m["oy"], m["oz"])]
                n = len(grid)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, m["stamp_ns"])), pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, xyz)], names=["stamp_ns", "pt", "x", "y", "z"])

    return messages.mapInArrow(run, "stamp_ns long, pt int, x float, y float, z float")


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON array file; malformed or truncated input is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def csv_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def scraped_log(lines: DataFrame, stage: str, counter: str) -> DataFrame:
    """line, stage, name, value of lines(line, text): colour codes go, the last stage named carries on, counters are read.

    ``stage`` has one group, ``counter`` two (name and number).
    """
    from pyspark.sql import Window as W

    plain = F.regexp_replace("text", "\\u001b\\[[0-9;]*[A-Za-z]", "")
    out = lines.select("line", "source", plain.alias("text"))
    named = F.nullif(F.regexp_extract("text", stage, 1), F.lit(""))
    w = W.partitionBy("source").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumn("stage", F.last(named, ignorenulls=True).over(w))
    return out.where(F.col("text").rlike(counter)).select("source", "line", "stage", F.regexp_extract("text", counter, 1).alias("name"), F.regexp_extract("text", counter, 2).cast("double").alias("value"))


def frame_list(spec: str, frames: DataFrame) -> DataFrame:
    """The frames that a specification names: all, stride:N, a:b:s, or list:i,j,k; only existing ones."""
    f = F.col("frame")
    if spec == "all":
        return frames
    if spec.startswith("stride:"):
        return frames.where(F.pmod(f, F.lit(int(spec[7:]))) == 0)
    if spec.startswith("list:"):
        return frames.where(f.isin([int(x) for x in spec[5:].split(",")]))
    start, stop, step = (int(x) for x in spec.split(":"))
    return frames.where((f >= start) & (f < stop) & (F.pmod(f - start, F.lit(step)) == 0))


def validated(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df, failing the query at the first row that breaks a rule; the rule's name is in the error."""
    ok = F.lit(True)
    for name, rule in rules.items():
        ok = ok & F.when(F.coalesce(rule, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(f"broken rule: {name}")).cast("boolean"))
    return df.where(ok)


def manifest_faults(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, fault: files that are missing, extra, or of another hash than the manifest(path, sha256) says."""
    both = manifest.select("path", F.col("sha256").alias("want")).join(files.select("path", F.col("sha256").alias("got")), "path", "full_outer")
    fault = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("got") != F.col("want"), "changed")
    return both.select("path", fault.alias("fault")).where("fault IS NOT NULL")
